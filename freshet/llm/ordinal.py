"""Ordinal cumulative-link regression on graded documents, with hashed text features and ordered thresholds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import fields, table

#: Hashed features of words, and of a text's shape.
DIMENSIONS = 1 << 18
#: Bound of the training sample: labelled rows by the hash of their id.
SAMPLE_ROWS = 6000
#: Documents of the sample that a feature must occur in.
LEAST_DOCUMENTS = 5
ROUNDS = 300
RATE = 0.3
SPARSITY = 2e-3
#: A document is selected if its chance of at least this grade is at least one half.
SELECTED_GRADE = 2
GRADES = 3

_ENDS = re.compile(r"^\W+|\W+$")
_TAIL = re.compile(r"[^\w\s]+$")
_REMEMBERED = 600_000
_tokens: dict[str, int] = {}


def _index(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode()) % DIMENSIONS


def _token(raw: str) -> int:
    """A token's word feature, and in the upper bits that of what follows the word's last letter (0: nothing)."""
    word, tail = _ENDS.sub("", raw.lower()), _TAIL.search(raw)
    upper = len(raw) > 1 and raw.isupper()
    own = _index(f"w:{word}") if word else _index("w:")
    ending = tail[0][:6] if tail and tail[0] not in (".", ",") else ""
    return own | (1 + _index(f"e:{ending}:{upper}") << 20 if ending or upper else 0)


def text_features(text: str | None) -> np.ndarray:
    """The distinct features of a whole text: its words, its odd endings by share, its share of repeated lines."""
    tokens = (text or "").split()
    if not tokens:
        return np.array([_index("s:empty")], np.int64)
    fresh = [t for t in set(tokens) if t not in _tokens]
    if len(_tokens) + len(fresh) > _REMEMBERED:
        _tokens.clear()
        fresh = list(set(tokens))
    _tokens.update((t, _token(t)) for t in fresh if len(t) <= 40)
    found = np.fromiter((_tokens[t] if t in _tokens else _token(t) for t in tokens), np.int64, len(tokens))
    endings = np.unique(found >> 20, return_counts=True)
    shape = []
    for ending, n in zip(*(x.tolist() for x in endings)):
        if ending:
            shape += [_index(f"share:{ending}:{k}") for k in (1, 2, 5, 10) if 100 * n >= k * len(tokens)]
    lines = [x for x in text.split("\n") if x]
    repeated = len(lines) - len(set(lines))
    shape += [_index(f"lines:{k}") for k in (10, 20, 30, 50) if 100 * repeated >= k * len(lines) and repeated]
    distinct = len(np.unique(found))
    shape += [_index(f"distinct:{k}") for k in (20, 35, 50) if 100 * distinct < k * len(tokens)]
    shape += [_index(f"short:{k}") for k in (5, 10, 20) if len(tokens) < k]
    return np.unique(np.concatenate([found & ((1 << 20) - 1), np.array(shape, np.int64)]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """P(grade <= j) = sigmoid(threshold[j] - sum of a text's weights)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..., a column each."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds)


def fitted(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES) -> Model:
    """Maximum likelihood with an L1 penalty by proximal AdaGrad on all rows at once; thresholds stay ordered."""
    flat = np.concatenate(rows)
    used, inner = np.unique(flat, return_inverse=True)
    frequent = np.bincount(inner) >= LEAST_DOCUMENTS
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    held = frequent[inner]
    number = np.cumsum(frequent) - 1
    inner, owner = number[inner[held]], owner[held]
    w = np.zeros(int(frequent.sum()))
    shares = np.cumsum(np.bincount(grades, minlength=n_grades)[:-1]) / max(1, len(grades))
    theta = np.log((shares + 1e-3) / (1 - shares + 1e-3))
    w_sum, theta_sum = np.full(len(w), 1e-12), np.full(len(theta), 1e-12)
    for _ in range(ROUNDS):
        score = np.bincount(owner, w[inner], len(rows))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        share = np.maximum(upper - lower, 1e-9)
        by_score = 1 - upper - lower
        to_upper, to_lower = -upper * (1 - upper) / share, lower * (1 - lower) / share
        by_theta = np.array([to_upper[grades == j].sum() + to_lower[grades == j + 1].sum() for j in range(n_grades - 1)]) / len(rows)
        by_w = np.bincount(inner, by_score[owner], len(w)) / len(rows)
        w_sum += by_w**2
        theta_sum += by_theta**2
        step = RATE / np.sqrt(w_sum)
        w -= step * by_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * SPARSITY, 0)
        theta -= RATE / np.sqrt(theta_sum) * by_theta
        theta = np.maximum.accumulate(theta + 1e-6 * np.arange(len(theta)))
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used[frequent]] = w
    return Model(weights, theta.copy())


def trained(docs: DataFrame, labels: DataFrame, grade, rows: int = SAMPLE_ROWS, n_grades: int = GRADES) -> Model:
    """The model of at most `rows` labelled texts: those with the least hashes of their ids, of one id those with the least hashes of the text.

    One task fits it, as the sample is bounded, also where a doc_id has many texts or labels; its weights, of a fixed
    number, come to the driver. Labels without grade, id or document are left out, and grades outside 0 to n_grades - 1 are an error. Without
    any, the middle grades are what every text is expected to have.
    """
    number = grade.cast("int")
    checked = F.when(number.between(0, n_grades - 1), number).otherwise(F.raise_error(F.concat(F.lit("no such grade: "), number.cast("string"))).cast("int"))
    graded = labels.select("doc_id", F.when(number.isNotNull(), checked).alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    first = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("grade")]
    sample = graded.orderBy(*first).limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").orderBy(*first, F.xxhash64("text")).limit(rows)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "grade", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_, grades = [], []
        for batch in batches:
            rows_ += [np.array(x, np.int64) for x in batch.column("features").to_pylist()]
            grades += batch.column("grade").to_pylist()
        if rows_:
            model = fitted(rows_, np.array(grades, np.int64), n_grades)
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))], names=["weights", "thresholds"])

    found = texts.mapInArrow(featurise, fields("doc_id long, grade int, features array<long>"))
    fit_rows = found.repartition(1).sortWithinPartitions("doc_id", "grade").mapInArrow(fit, fields("weights binary, thresholds array<double>")).collect()
    if not fit_rows:
        return Model(np.zeros(DIMENSIONS, np.float32), np.linspace(-1, 1, n_grades - 1))
    return Model(np.frombuffer(bytes(fit_rows[0][0]), np.float32), np.array(fit_rows[0][1]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_grade, p_1, p_2, ...) of each row's whole text; p_j is the chance of grade j or more."""
    names = [f"p_{j + 1}" for j in range(len(model.thresholds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.tails(np.array([float(model.weights[text_features(t)].sum()) for t in batch.column("text").to_pylist()]).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.sum(axis=1)), *(pa.array(x) for x in tails.T)], names=["doc_id", "expected_grade", *names])

    return docs.select("doc_id", "text").mapInArrow(run, fields(", ".join(["doc_id long", "expected_grade double", *(f"{x} double" for x in names)])))


def op2_ordinal_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's expected grade (0 toxic, 1 poor, 2 good) and whether it is selected.

    Null and empty texts have the feature of an empty text alone; very long texts count with the features of all their words; rows
    that repeat a doc_id are graded one by one, equal texts alike; without labels all thresholds are at their defaults. Other columns
    aren't read. An empty table gives no rows.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    graded = scored(docs, trained(docs, labels, grade))
    return graded.withColumn("kept", F.col(f"p_{SELECTED_GRADE}") >= 0.5)
