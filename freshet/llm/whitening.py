"""Whitening of embeddings: principal components by Jacobi-Davidson over distributed centred products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import fields, table, written

#: Entries are fixed to multiples of 1 / STEPS.
STEPS = 256
COMPONENTS = 4
#: A pair is locked when its residual is below so many units of rounding of the largest eigenvalue.
ROUNDING_UNITS = 32
#: Where rounding in the products keeps a residual from falling further, this many units are accepted instead.
STALLED_UNITS = 4096
#: Steps of MINRES in a correction; every step is one pass over the vectors for all corrections together.
INNER_STEPS = 5
OUTER_STEPS = 80
#: Columns of the search subspace before it restarts, as a multiple of the wanted components, and those it restarts with.
SUBSPACE, RESTART = 8, 3
EPS = float(np.finfo(np.float64).eps)


# --- fixed vectors ---------------------------------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as little-endian integers of the least of 2, 4 and 8 bytes that holds all: equal vectors, equal bytes."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _unpacked(column: pa.Array, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of int64) of packed vectors, by their width."""
    data = column.to_pylist()
    size = np.fromiter(map(len, data), np.int64, len(data))
    for width in (2, 4, 8):
        at = np.flatnonzero(size == width * d)
        if len(at):
            yield at, np.frombuffer(b"".join([data[i] for i in at]), f"<i{width}").reshape(len(at), d).astype(np.int64)


def fixed_vectors(df: DataFrame, key: str, vector: str, steps: int = STEPS) -> DataFrame:
    """(key, d, x): x = floor(steps * c) of each entry, packed; rows whose vector is null or holds null or non-finite entries go.

    Products beyond the range of a long count as its ends.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys, own, out = [], batch.column("vector"), []
            for i, values in enumerate(own):
                if not values.is_valid:
                    continue
                c = values.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
                if np.isfinite(c).all():
                    with np.errstate(over="ignore"):
                        x = np.floor(steps * c)
                    keys.append(i)
                    inside = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
                    out.append((len(c), _packed(inside)))
            d, x = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), pa.array(d, pa.int32()), pa.array(x, pa.binary())], names=["key", "d", "x"])

    schema = fields("key long, d int, x binary")
    schema["key"].dataType = df.schema[key].dataType
    return df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(run, schema).withColumnRenamed("key", key)


# --- sums over all vectors -------------------------------------------------------------------------------------


def summed(fit: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sum of part(matrix of vectors) over all vectors, an array of a size that depends on d alone. Each task adds up its own."""
    kind = "long" if exact else "double"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in rows:
            for _, x in _unpacked(batch.column("x"), d):
                total = total + part(x)
        if np.ndim(total):
            values = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "value"])

    found = fit.select("x").mapInArrow(run, fields(f"i long, value {kind}")).groupBy("i").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(found), np.int64 if exact else np.float64)
    for r in found:
        out[r.i] = r.value
    return out


# --- Jacobi-Davidson -------------------------------------------------------------------------------------------

Product = Callable[[np.ndarray], np.ndarray]


def _minres(product: Product, theta: np.ndarray, outside: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Columns t with outside (V - theta) outside t near b, each by its own MINRES; one product a step serves all columns.

    `outside` projects columns off the locked and the current vectors. Lanczos vectors, Givens rotations and
    directions are kept for the last steps only.
    """
    beta = np.linalg.norm(b, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(b), b / np.where(live, beta, 1)
    w_old, w, t = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    one = np.ones(b.shape[1])
    c_old, c, s_old, s, eta, last = one, one, 0 * one, 0 * one, beta.copy(), 0 * one
    for _ in range(steps):
        p = outside(product(v) - theta * v)
        alpha = (v * p).sum(axis=0)
        p = outside(p - alpha * v - last * v_old)
        beta = np.linalg.norm(p, axis=0)
        rho0 = c * alpha - c_old * s * last
        rho1 = np.hypot(rho0, beta)
        rho2 = s * alpha + c_old * c * last
        rho3 = s_old * last
        live &= rho1 > 0
        safe = np.where(live, rho1, 1)
        c_old, s_old, c, s = c, s, rho0 / safe, beta / safe
        w_old, w = w, (v - rho3 * w_old - rho2 * w) / safe
        t = t + np.where(live, c * eta, 0) * w
        eta = -s * eta
        live &= beta > EPS * np.abs(theta)
        v_old, v, last = v, np.where(live, p / np.where(live, beta, 1), 0), beta
        if not live.any():
            break
    return t


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns that span what `new` adds to the bases; twice, so that nothing of them is left."""
    out = np.zeros((len(new), 0))
    for column in (new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)).T:
        for _ in range(2):
            for basis in (*bases, out):
                column = column - basis @ (basis.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            out = np.column_stack([out, column])
    return out


def principal(product: Product, d: int, wanted: int = COMPONENTS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors, of a symmetric matrix known only by its product with columns.

    Rayleigh-Ritz in a search subspace; a Ritz pair whose residual has come down to rounding is locked and leaves the
    subspace. The others' corrections solve the projected equation by MINRES, all in common passes. It ends
    when all of the largest `wanted` values, locked or not, are locked.
    """
    wanted = min(wanted, d)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    w = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, wanted + 2))))
    vw = product(w)
    best: dict[int, tuple[float, int]] = {}
    for _ in range(OUTER_STEPS):
        theta, y = np.linalg.eigh((w.T @ vw + vw.T @ w) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        w, vw = w @ y, vw @ y
        unit = EPS * max(np.abs(np.concatenate([theta, values])).max(initial=0.0), 1e-300)
        n = min(wanted, w.shape[1])
        size = np.linalg.norm(vw[:, :n] - theta[:n] * w[:, :n], axis=0)
        done = np.zeros(w.shape[1], bool)
        for i in range(n):
            low, since = best.get(len(values) + i, (np.inf, 0))
            best[len(values) + i] = (size[i], 0) if size[i] < low / 2 else (low, since + 1)
            done[i] = size[i] <= ROUNDING_UNITS * unit or (size[i] <= STALLED_UNITS * unit and since >= 2)
        if done.any():
            locked, values = np.column_stack([locked, w[:, done]]), np.concatenate([values, theta[done]])
            w, vw, theta = w[:, ~done], vw[:, ~done], theta[~done]
            best = {}
        order = np.argsort(-values, kind="stable")
        inside = locked.shape[1] + w.shape[1] >= d and not w.shape[1]
        if len(values) >= wanted and (inside or not w.shape[1] or theta[0] <= values[order[wanted - 1]]):
            return values[order[:wanted]], locked[:, order[:wanted]]
        if w.shape[1] > SUBSPACE * wanted:
            w, vw, theta = w[:, : RESTART * wanted], vw[:, : RESTART * wanted], theta[: RESTART * wanted]
        k = min(max(wanted - len(values), 1), w.shape[1])
        u, r = w[:, :k], vw[:, :k] - theta[:k] * w[:, :k]
        held = np.column_stack([locked, u])

        def outside(x: np.ndarray, held=held) -> np.ndarray:
            x = x - held @ (held.T @ x)
            return x - held @ (held.T @ x)

        t = _minres(product, theta[:k], outside, -outside(r), INNER_STEPS) if k else np.zeros((d, 0))
        new = _orthonormal(t, locked, w)
        if not new.shape[1] and locked.shape[1] + w.shape[1] < d:  # nothing to correct: look where nothing was looked yet
            new = _orthonormal(np.random.default_rng(seed + locked.shape[1] + w.shape[1]).standard_normal((d, 1)), locked, w)
        if new.shape[1]:
            w, vw = np.column_stack([w, new]), np.column_stack([vw, product(new)])
    raise ArithmeticError("the residuals didn't reach double precision")


# --- whitening -------------------------------------------------------------------------------------------------


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, residual) of each row and component.

    Mean and covariance are those of the distinct fixed vectors. All vectors must have one length: those of another
    than the most frequent (of several, the longest) are dropped. Components without variance are left out, so vectors that
    are all equal give no rows. A deviation beyond a long is null. A covariance has d x components entries at the driver, never d x d.
    """
    own = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").alias("_vector"))
    fixed = fixed_vectors(own, "_key", "_vector", steps)
    fit = written(fixed.select("d", "x").distinct(), "fit")
    schema = fields("key long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double")
    schema["key"].dataType = df.schema[key].dataType
    empty = df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    lengths = fixed.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or lengths.d == 0:
        return empty
    d = lengths.d
    fit = fit.where(F.col("d") == d)
    n = fit.count()
    sums = summed(fit, d, lambda x: x.sum(axis=0), exact=True)
    mean = sums.astype(np.float64) / n

    def product(u: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ u)

        return summed(fit, d, part).reshape(u.shape) / n

    trace = float(summed(fit, d, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
    values, vectors = principal(product, d, components)
    some = values > EPS * d * trace
    values, vectors = values[some], vectors[:, some]
    if not len(values):
        return empty
    residual = float(np.linalg.norm(product(vectors) - values * vectors, axis=0).max() / values[0])
    scaled = vectors / np.sqrt(values)
    middle = summed(fit, d, lambda x: ((x - mean) @ scaled).sum(axis=0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ scaled - middle
        return z.T @ z

    k = len(values)
    error = float(np.abs(summed(fit, d, spread).reshape(k, k) / n - np.eye(k)).max())
    total, names = [int(s) for s in sums], schema.names

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * max(int(x.max()), -int(x.min())) + max(map(abs, total))
        if d * most * most < 1 << 63:
            return ((n * x - sums) ** 2).sum(axis=1).tolist()
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, total)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at, x in _unpacked(batch.column("x"), d):
                m = len(at)
                rowwise = pa.array(np.repeat(at, k))
                yield pa.RecordBatch.from_arrays([
                    batch.column("_key").take(rowwise), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array([v for v in deviations(x) for _ in range(k)], pa.int64()), pa.array(((x - mean) @ scaled).ravel()),
                    pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error)), pa.array(np.full(m * k, residual)),
                ], names=names)

    return fixed.where(F.col("d") == d).mapInArrow(run, schema).withColumnRenamed("key", key)


def op11_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable rows of `embeddings` on the first four components, whitened.

    Rows with a null vector, or null or non-finite entries, have no rows here; nor have vectors of a length other than
    the most frequent one. Rows that repeat a vec_id or lack one are whitened each; equal vectors count once in
    the fit and have equal values. Equal eigenvalues leave their vectors free within their space. An empty table gives no rows.
    """
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").drop("residual")
