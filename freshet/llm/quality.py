"""Quality rules on repetition: characters inside duplicated n-grams and lines of a text."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import WORD, fields, table

_WORD = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
#: Words of the windows that count as repeated, and the base rule's limits.
BASE_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Largest percentage of word characters inside n-grams that an earlier place of the text holds too.
NGRAM_PERCENT = {5: 18, 6: 17, 7: 16, 8: 15, 9: 15, 10: 15}
#: Largest percentage of a text's characters in lines that equal an earlier line.
LINE_PERCENT = 30

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Windows:
    """Rolling hashes of a text's word n-grams: a prefix sum of word hashes times powers of an odd base."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        n = len(ids)
        powers = np.ones(n + 1, np.uint64)
        inverse = np.ones(n + 1, np.uint64)
        powers[1:] = _BASE
        inverse[1:] = _INVERSE
        np.multiply.accumulate(powers, out=powers)
        self.inverse = np.multiply.accumulate(inverse)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(ids) * powers[:n], out=self.prefix[1:])

    def repeated(self, n: int, first: bool) -> np.ndarray:
        """A flag for each word: it lies in an n-gram found twice or more (first), or found earlier too (not first)."""
        count = len(self.ids) - n + 1
        inside = np.zeros(len(self.ids), bool)
        if count < 2:
            return inside
        key = (self.prefix[n:] - self.prefix[:count]) * self.inverse[:count]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if not same.any():
            return inside
        a, b = order[:-1][same], order[1:][same]
        span = np.arange(n)
        if (self.ids[a[:, None] + span] != self.ids[b[:, None] + span]).any():  # two n-grams share a hash
            _, group = np.unique(self.ids[np.arange(count)[:, None] + span], axis=0, return_inverse=True)
            order = np.argsort(group.ravel(), kind="stable")
            same = group.ravel()[order[1:]] == group.ravel()[order[:-1]]
            a, b = order[:-1][same], order[1:][same]
        starts = np.zeros(len(self.ids) + 1, np.int64)
        hit = np.zeros(count, bool)
        hit[b] = True
        if first:
            hit[a] = True
        starts[:count] += hit
        starts[n : n + count] -= hit
        return np.cumsum(starts[:-1]) > 0


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, then the n-gram characters."""
    words = _WORD.findall(text or "")
    if not words:
        return (0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0, 0, *repeat(0, len(NGRAM_PERCENT)))
    number = dict.fromkeys(words)
    number = dict(zip(number, range(len(number))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    chars = np.fromiter(map(len, words), np.int64, len(words))
    seen: set[str] = set()
    lines = line_chars = 0
    for line in text.split("\n"):
        if line in seen:
            lines += 1
            line_chars += len(line)
        elif _WORD.search(line):
            seen.add(line)
    windows = Windows(ids)
    return (
        len(words), int(chars.sum()), sum(map(text.count, SYMBOLS)), lines, int(windows.repeated(BASE_WINDOW, True).sum()), line_chars,
        *(int(chars[windows.repeated(n, False)].sum()) for n in NGRAM_PERCENT),
    )


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_PERCENT)]


@F.pandas_udf(fields(", ".join(f"{x} long" for x in FIELDS)))
def repetition(text: pd.Series) -> pd.DataFrame:
    """Whole texts' measures as a struct; a null text counts as an empty one."""
    return pd.DataFrame([measure(t) for t in text], columns=FIELDS, dtype="int64")


def base_failed(m) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def kept(m, text: Column) -> Column:
    """Not failed by the base rule, nor by the shares of characters in repeated lines or n-grams."""
    good = ~base_failed(m) & (100 * m["dup_line_chars"] <= LINE_PERCENT * F.coalesce(F.length(text), F.lit(0)))
    for n, percent in NGRAM_PERCENT.items():
        good &= 100 * m[f"dup_{n}gram_chars"] <= percent * m["word_chars"]
    return good


def judged(docs: DataFrame, text: str = "text", out: str = "_quality") -> DataFrame:
    """docs with the struct column `out`: the measures, base_failed and kept. No shuffle; other columns stay."""
    m = docs.withColumn(out, repetition(F.col(text)))
    measures = F.col(out)
    return m.withColumn(out, F.struct(*[measures[x].alias(x) for x in FIELDS], base_failed(measures).alias("base_failed"), kept(measures, F.col(text)).alias("kept")))


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's repetition measures and verdict.

    Null, empty and wordless texts have zeros and fail; rows that repeat a doc_id are judged one by one; an
    empty table gives no rows.
    """
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_quality.*")


def _windows_sql(n: int, name: str, first: bool) -> str:
    return f"""
g{name} AS (SELECT doc_id, i, hash_key, count(*) OVER (PARTITION BY doc_id, hash_key) AS c, row_number() OVER (PARTITION BY doc_id, hash_key ORDER BY i) AS r
  FROM (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS hash_key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w))),
c{name} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM g{name} WHERE {'c > 1' if first else 'r > 1'}),
s{name} AS (SELECT doc_id, count(*) AS words, sum(length(ws[c{name}.i])) AS chars FROM c{name} JOIN w USING (doc_id) GROUP BY doc_id)"""


def _sql() -> str:
    grams = list(NGRAM_PERCENT)
    checks = " AND ".join(f"100 * dup_{n}gram_chars <= {p} * word_chars" for n, p in NGRAM_PERCENT.items())
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
d AS (SELECT doc_id, count(*) AS n, sum(length(line)) AS chars FROM l WHERE r > 1 GROUP BY doc_id),
{_windows_sql(BASE_WINDOW, "base", True)},
{",".join(_windows_sql(n, str(n), False) for n in grams)},
m AS (SELECT w.doc_id, length(w.text) AS text_chars, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
      coalesce(sbase.words, 0)::BIGINT AS n_repeat_words, coalesce(d.chars, 0)::BIGINT AS dup_line_chars,
      {", ".join(f"coalesce(s{n}.chars, 0)::BIGINT AS dup_{n}gram_chars" for n in grams)}
      FROM w LEFT JOIN d USING (doc_id) LEFT JOIN sbase USING (doc_id) {" ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in grams)})
SELECT {", ".join(FIELDS)}, doc_id, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
       AND 100 * dup_line_chars <= {LINE_PERCENT} * text_chars AND {checks} AS kept FROM m
"""


OP3_SQL = _sql()
