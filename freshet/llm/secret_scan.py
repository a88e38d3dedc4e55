"""Secret scans of whole texts with one combined automaton for all rules."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.automaton import Rule, Scanner
from freshet.llm.common import fields, table

BASE_KINDS = ("assign", "access", "hex")
#: The rules in the order of ties. A hexadecimal run has no head to look for, so its least length is in the pattern.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", True, 6),
    Rule("access", "", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", "", r"[0-9a-f]{24,}"),
    Rule("hosting", "", r"gh[oprsu]_[A-Za-z0-9]+", least=24),
    Rule("chat", "", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("web_token", "", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
    Rule("private_key", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
#: What ends a private key, and, where that is missing, what may follow its BEGIN line: base64 characters and lines of them.
KEY_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
KEY_BODY = re.compile(
    r"(?:\\[nr]|[A-Za-z0-9+/=])*+"
    r"(?:[^\S\n]*+\n\s*+(?:(?:Proc-Type|DEK-Info):[^\n]*+|(?:\\[nr]|[A-Za-z0-9+/=])++(?=[^\S\n]*+(?:\n|\Z))))*+"
)
#: Bytes that are scanned at once.
BATCH = 8_000_000


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(RULES)


def found(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Each text's (start, end, kind) in code points, end exclusive, by start and then rule."""
    out: list[list[tuple[int, int, str]]] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        for data, spans in zip(group, scanner().spans(group)):
            chars = {0: 0}
            at = n = 0
            for x in sorted({x for s in spans for x in s[:2]}):
                n += len(data[at:x].decode())
                at = x
                chars[x] = n
            out.append([(chars[a], chars[b], RULES[k].kind) for a, b, k in spans])
        group.clear()

    for text in texts:
        group.append((text or "").encode())
        size += len(group[-1])
        if size >= BATCH:
            flush()
            size = 0
    flush()
    return out


def whole_keys(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """spans with those of private keys, which `found` ends at the BEGIN line, extended over the keys themselves.

    A key goes on to the first END line. If the next key begins or the text ends before one, it goes on over the
    base64 characters and lines that follow. Other spans stay as they are, also inside a key.
    """
    stops = [a for a, _, kind in spans if kind == "private_key"][1:] + [len(text)]
    out, k = [], 0
    for a, b, kind in spans:
        if kind == "private_key":
            end = KEY_END.search(text, b, stops[k]) or KEY_BODY.match(text, b, stops[k])
            b, k = end.end(), k + 1
        out.append((a, b, kind))
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


@F.pandas_udf(fields("n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))
def secrets(text: pd.Series) -> pd.DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans, private keys whole; a null text counts as an empty one."""
    rows = []
    for own, spans in zip(text.tolist(), found(text.tolist())):
        base = [s for s in spans if s[2] in BASE_KINDS]
        counts = [sum(s[2] == k for s in base) for k in BASE_KINDS]
        rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(whole_keys(own or "", spans))))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def masked(text: str, spans) -> str:
    """text with each span, or what overlapping spans cover together, replaced by [KIND] of the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def redacted(text: pd.Series) -> pd.Series:
    """Whole texts with secrets masked, private keys from their BEGIN to their END line; null stays null."""
    texts = text.tolist()
    return pd.Series([t if t is None else masked(t, whole_keys(t, s)) if s else t for t, s in zip(texts, found(texts))], dtype=object)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the secrets in `text` masked; no shuffle, other columns stay."""
    return docs.withColumn(text, redacted(F.col(text)))


def op7_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's secrets.

    Null and empty texts have none; rows that repeat a doc_id are scanned one by one; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", secrets("text").alias("s"))
    return docs.select("doc_id", "s.*")
