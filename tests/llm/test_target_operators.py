"""Whitening, previous factors and target resampling against plain versions on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from freshet.llm import resampling, suffixes, whitening


def write(spark, tmp_path, name, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return df


# --- whitening


def vectors():
    rnd = np.random.default_rng(3)
    good = (rnd.standard_normal((120, 9)) * np.linspace(3, 0.2, 9)).round(3).tolist()
    odd = [None, [], good[0][:8], [float("nan")] * 9, [None] * 9, [float("inf")] + [0.0] * 8]
    rows = [(i, v, 1, 2.0, i) for i, v in enumerate(good)] + [(900, good[5], 1, 2.0, 7), (900, good[6], 1, 2.0, 7), (None, good[7], 1, 2.0, 7)]
    return rows + [(1000 + i, v, 1, 2.0, 7) for i, v in enumerate(odd)]


def test_op11_whole_query(spark, tmp_path):
    rows = vectors()
    write(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<double>, n int, whitened double, _key long")
    got = whitening.op11_jacobi_davidson(spark, str(tmp_path)).toPandas()
    kept = [(k, v) for k, v, *_ in rows if v and len(v) == 9 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in kept])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T.astype(float), bias=True)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    assert len(got) == 4 * len(kept) and set(got.n) == {n}
    assert got.identity_error.max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), e / np.trace(cov), rtol=1e-12)
    wanted = (x - s / n) @ u / np.sqrt(e)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    for i, (k, _) in enumerate(kept):
        own = got[got.vec_id.isna()] if k is None else got[got.vec_id == k]
        near = [np.isclose(np.abs(wanted[i, c - 1]), np.abs(own[own.component == c].whitened)).any() for c in range(1, 5)]
        assert all(near) and deviation[i] in own.deviation.tolist()
    for c in range(1, 5):  # one sign for all rows
        own = got[(got.component == c) & (got.vec_id < 120)].sort_values("vec_id").whitened.to_numpy()
        assert np.allclose(own * np.sign(own[0]), wanted[:120, c - 1] * np.sign(wanted[0, c - 1]), atol=1e-9)


def test_op11_degenerate(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema), "vec_id", "embedding").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), "vec_id", "embedding").count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]
    one = whitening.whiten(spark.createDataFrame(line, schema), "vec_id", "embedding").toPandas()
    assert set(one.component) == {1} and len(one) == 10 and np.isclose(one.explained, 1).all()
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema), "vec_id", "embedding").toPandas()
    assert huge.deviation.isna().any()


@pytest.mark.parametrize("values", [[9, 8, 7.999999, 7.99, 3, 1, 0.5, 0], [5, 5, 5, 5, 5, 1], [1, 0, 0, 0, 0], [2.0], [1e-6, 1e6, 1e3, 1, 0.1]])
def test_principal_pairs(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    a = q @ np.diag(np.array(values, float)) @ q.T
    e, u = whitening.principal(lambda x: a @ x, d)
    assert np.allclose(e, sorted(values, reverse=True)[:4], atol=1e-12 * max(values))
    assert np.abs(a @ u - u * e).max() <= 1e-12 * max(values)
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12)


# --- previous factors


def passages(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ab é\0") for _ in range(rnd.randint(0, 400))) for _ in range(12)]

    def part():
        if rnd.random() < 0.7:
            return rnd.choice(base)[rnd.randint(0, 60) :][: rnd.randint(0, 200)]
        return "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 80)))

    rows = []
    for i in range(100):
        key = rnd.choice([rnd.randint(0, 60), None]) if rnd.random() < 0.3 else i * 3
        rows.append((key, None if rnd.random() < 0.05 else "".join(part() for _ in range(rnd.randint(0, 6)))))
    return rows + rows[:15] + [(7, "".join(rnd.choice("xyzw") for _ in range(3000)) * 2), (5, "a" * 2000), (9, "a" * 500), (11, "")]


def removed(rows, length):
    order = lambda k: 1 << 62 if k is None else k
    data = [(order(k), (t or "").encode()) for k, t in rows]
    out = []
    for (key, _), (own, b) in zip(rows, data):
        covered = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if any(j < own and b[k : k + length] in c for j, c in data):
                covered[k] += 1
                covered[k + length] -= 1
        gone = np.cumsum(covered)[: len(b)] > 0
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((key, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,chunk", [(50, 500), (20, suffixes.CHUNK)])
def test_repeats_by_length_and_chunk(spark, length, chunk):
    rows = passages(length)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, found string").repartition(4)
    got = suffixes.without_repeats(df, length, chunk)
    assert sorted((tuple(r) for r in got.drop("spans").collect()), key=str) == removed(rows, length)


def test_op12_whole_query(spark, tmp_path):
    rows = passages(8)
    write(spark, tmp_path, "documents", [(*r, 1, "b") for r in rows], "doc_id long, text string, digest int, bucket string")
    assert sorted((tuple(r) for r in suffixes.op12_previous_factors(spark, str(tmp_path)).collect()), key=str) == removed(rows, 50)
    write(spark, tmp_path, "documents", [], "doc_id long, text string")
    assert suffixes.op12_previous_factors(spark, str(tmp_path)).count() == 0


def test_previous_factors_follow_the_definition():
    rnd = np.random.default_rng(4)
    for _ in range(40):
        n = int(rnd.integers(1, 60))
        text = sorted("".join(rnd.choice(list("ab"), 8)) for _ in range(n))
        doc = rnd.integers(0, 5, n)
        same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 8)
        lcp = np.array([0] + [same(a, b) for a, b in zip(text, text[1:])])
        plain = [max([same(text[i], text[j]) for j in range(n) if doc[j] < doc[i]], default=0) for i in range(n)]
        assert suffixes.previous_factors(lcp, doc, 3).tolist() == [x if x >= 3 else 0 for x in plain]


# --- target resampling


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_resample(docs, target, n, least, percent):
    def buckets(text):
        own = words(text)
        return [zlib.crc32(" ".join(own[i : i + k]).encode()) % 10000 for k in range(1, n + 1) for i in range(len(own) - k + 1)]

    source = np.bincount([b for _, t in docs for b in buckets(t)], minlength=10000)
    wanted = np.bincount(np.array([b for t in target for b in buckets(t)], int), minlength=10000)
    s, t = int(source.sum()), int(wanted.sum())
    gain = [math.floor(1000 * math.log((b + 1) * (s + 10000) / ((a + 1) * (t + 10000)))) for a, b in zip(source.tolist(), wanted.tolist())]
    out = []
    for key, text in docs:
        own = buckets(text)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([key, len(words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ranked = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], 1 << 62 if r[0] is None else r[0]))
    for i, r in enumerate(ranked[: percent * len(ranked) // 100]):
        r[5] = i + 1
    return out


def odd_documents():
    rnd = random.Random(2)
    pool = ["river", "Flood", "gauge", "Ärger", "水位", "x1", "the", "of", "zz9"]
    docs = [(i, " ,".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    docs += docs[:30] + [(3, docs[3][1])] * 5 + [(None, docs[40][1]), (None, None), (500, None), (501, ""), (502, "-- !!"), (503, "long" * 60000 + " word" * 40)]
    return docs, ["river flood river", "gauge 水位", None, ""]


def test_op13_whole_query(spark, tmp_path):
    docs, target = odd_documents()
    write(spark, tmp_path, "documents", [(*r, 1, "s") for r in docs], "doc_id long, text string, rank int, score string")
    write(spark, tmp_path, "benchmark", [(i, t, 0) for i, t in enumerate(target)], "item_id long, text string, weight int")
    got = sorted((tuple(r) for r in resampling.op13_head_tail_resampling(spark, str(tmp_path)).collect()), key=str)
    plain = plain_resample(docs, target, 1, 20, 10)
    assert sorted(map(str, ((r[0], r[1], r[2], r[3]) for r in got))) == sorted(map(str, ((k, n, w, s) for k, _, n, w, s, _ in plain)))
    drawn = lambda rows: sorted((rank, key, score) for key, score, rank in rows if rank is not None)
    assert drawn((r[0], r[3], r[4]) for r in got) == drawn((r[0], r[4], r[5]) for r in plain)
    write(spark, tmp_path, "documents", [], "doc_id long, text string")
    assert resampling.op13_head_tail_resampling(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [2, 3])
def test_longer_features_and_tails(spark, n):
    docs, target = odd_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n, percent=50)
    plain = plain_resample(docs, target, n, 20, 50)
    assert sorted(str((r.doc_id, r.n_words, r.n_features, r.weight, r.score)) for r in got.collect()) == sorted(str(tuple(r[:5])) for r in plain)


def test_head_doesnt_change_buckets():
    own = [w.encode() for w in words("the river of the flood the river zz")]
    some = resampling.Head([b"the", b"river"], [b"the river"], 2)
    assert resampling.Head([], [], 2).of(own).tolist() == some.of(own).tolist()
