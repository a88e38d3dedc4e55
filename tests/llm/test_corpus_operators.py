"""Mixing, shards, ids, media, packing, near copies and the pipeline against plain versions, with odd inputs."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from freshet.llm import jaccard, media, mixing, packing, rans, registry, sharding, tokens
from freshet.llm.common import scratch, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, rate string"
HERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(9)
    words = ["ab", "Cd", "é", "xyz,", "longer\n", "don't", "%%%", "42"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 80)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "  two  spaces \n "), (103, "z" * 40_000), (104, "q w e r t y " * 4000), (5, rows[5][1]), (105, rows[5][1]), (106, " ")]
    return spark.createDataFrame([(i, t, rnd.choice(["en", "de", None, "xx"]), "s", None, "own") for i, t in rows], SCHEMA).repartition(3)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_pieces_have_the_ids_of_whole_texts():
    rnd = random.Random(3)
    parts = ["a", "B", "the", " ", "  ", "\n", "\t", ".", ",", "!", "é", "é", "ß", "1", "²", "'s", "don't", "%%%", "中", "😀", " ", "Σ", "<|endoftext|>", "x" * 60, "\x1c", "\x00", "İ", "ǆ", "ﬁ"]
    some = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        for _ in range(2):  # the second time from memory
            got = tokens.encoded(path, [None, *some])
            assert got == [b"", *(np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(some, add_special_tokens=False))]


def test_crc_of_parts():
    a, b = os.urandom(77), os.urandom(100_003)
    assert tokens.crc32_shifted(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_rans_round_trip_checkpoints_and_damage():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 1000, 200_000):
        ids = rng.zipf(1.3, n) % 50_000
        coder = rans.Coder(rans.normalised(np.bincount(ids, minlength=rans.VOCABULARY)))
        block = coder.encode(ids)
        assert (coder.decode(block) == ids).all()
        marks = rans._HEADER.unpack_from(block)[4]
        assert (np.concatenate([coder.decode(block, k) for k in range(marks + 1)]) == ids).all()
        with pytest.raises(ValueError):
            coder.decode(block[:-1] + bytes([block[-1] ^ 1]))
    assert rans.normalised(np.array([0, 1, 10**12])).sum() == 1 << rans.SCALE_BITS and rans.normalised(np.zeros(4)).sum() == 0


def test_rans_states_are_exact():
    rng = np.random.default_rng(1)
    cases = [np.full(5000, 7), np.append(np.zeros(299_999, np.int64), 65_535), rng.permutation(65_536), rng.zipf(1.1, 70_001) % 65_536]
    for ids in cases:
        freq = rans.normalised(np.bincount(ids, minlength=rans.VOCABULARY))
        coder = rans.Coder(freq)
        block = coder.encode(ids)
        assert (coder.decode(block) == ids).all()
        lanes = rans._HEADER.unpack_from(block)[2]
        first = np.cumsum(freq) - freq
        for lane in (0, lanes - 1):  # the same in whole numbers of any length
            x = rans._LOW
            for i in reversed(ids[lane::lanes].tolist()):
                f = int(freq[i])
                x = x >> 32 if x >= f * (rans._LOW << 32 >> rans.SCALE_BITS) else x
                x = (x // f << rans.SCALE_BITS) + x % f + int(first[i])
            assert x == np.frombuffer(block, np.uint64, lanes, rans._HEADER.size)[lane]


def test_ids_are_counted_and_cut_as_they_are_ordered(spark, docs, monkeypatch):
    monkeypatch.setattr(rans, "PART_DOCUMENTS", 20)
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 5000)
    tokenizer = public_tokenizers.path(rans.TOKENIZER)
    rows = rans.ordered_ids(docs, tokenizer)
    t = Tokenizer.from_file(tokenizer)
    wanted = np.bincount([i for _, text in texts(docs) for i in [*t.encode(text or "", add_special_tokens=False).ids, 2]], minlength=rans.VOCABULARY)
    assert (rans.id_counts(rows.select("seen", "times")) == wanted).all()  # without reading the ids again
    cut = [r for r in rows.collect() if r["n_tokens"]]
    assert len(cut) < docs.count() and all(r["n_tokens"] == sum(r["length"]) == len(r["payload"]) // 2 <= 5000 for r in cut)  # was a row for each document
    assert sum(r["n_tokens"] for r in cut) == wanted.sum()


def test_crc_operators_are_made_once(monkeypatch):
    tokens.crc32_shifted(1, (1 << 20) - 1)
    calls, times = [], tokens._times
    monkeypatch.setattr(tokens, "_times", lambda *x: calls.append(1) or times(*x))
    assert tokens.crc32_shifted(zlib.crc32(b"ab"), 5000) ^ zlib.crc32(bytes(5000)) == zlib.crc32(b"ab" + bytes(5000))
    assert len(calls) <= 13  # was 32 for each doubling


def test_id_files(spark, docs, monkeypatch):
    monkeypatch.setattr(rans, "PART_DOCUMENTS", 20)
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 5000)
    path, tokenizer = scratch(spark, "t"), public_tokenizers.path(rans.TOKENIZER)
    rans.write_ids(docs, path, tokenizer)
    t, start, wanted = Tokenizer.from_file(tokenizer), 0, []
    for i, text in sorted(texts(docs), key=lambda x: (x[0], x[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rans.documents_read(spark, path).collect())) == wanted
    empty = scratch(spark, "t")
    rans.write_ids(docs.limit(0), empty, tokenizer)
    assert rans.documents_read(spark, empty).count() == 0


def test_packing(docs):
    path = public_tokenizers.path(packing.TOKENIZER)
    rows = packing.pack_documents(docs, path, tokens=512, segments=9).collect()
    t, by_doc, by_seq = Tokenizer.from_file(path), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, text in texts(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        own = [r for r in by_doc[i] if r["doc_tokens"] == len(ids)]
        covered = collections.Counter(k for r in own for k in range(r["start"], r["start"] + r["length"]))
        assert set(covered) == set(range(len(ids))) and len(set(covered.values())) == 1
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= 512 and len(own) <= 9
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_packing_limits_on_loss():
    packer, rnd = packing.Packer(100, 4, 50), random.Random(4)
    sizes = [(rnd.randint(1, 250), rnd.randint(0, 80)) for _ in range(200)]
    out = [s for k, (n, p) in enumerate(sizes) for s in packer.add(k, n, p)] + list(packer.sequences(last=True))
    seen = collections.Counter()
    for s in out:
        assert sum(n for _, _, n in s) <= 100 and len(s) <= 4 and sum(packer.loss(a, n, sizes[k][1]) for k, a, n in s) <= 50
        seen.update(x for k, a, n in s for x in ((k, i) for i in range(a, a + n)))
    assert len(seen) == sum(n for n, _ in sizes) and set(seen.values()) == {1}


def test_media(spark, docs):
    for limit in (10**6, 0):  # by broadcast and by join
        path = scratch(spark, "media")
        media.store(docs, path, limit)
        got = sorted((tuple(r)[:5] for r in media.read(spark, path).collect()), key=lambda x: (x[0], x[1]))
        assert got == sorted(
            ((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t in texts(docs) for b in [(t or "").encode()] for p in [b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))]),
            key=lambda x: (x[0], x[1]),
        )
        assert spark.read.parquet(f"{path}/shared").groupBy("digest").count().where("count > 1").isEmpty()
    empty = scratch(spark, "media")
    media.store(docs.limit(0), empty)
    assert media.read(spark, empty).count() == 0


def test_gear_and_cuts_follow_content():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(200_000))
    h, acc = media.gear(np.frombuffer(data, np.uint8)), 0
    for i, b in enumerate(data[:3000]):
        acc = (2 * acc + int(media._GEAR[b])) & 0xFFFFFFFF
        assert acc == h[i]
    changed = data[:5000] + b"abc" + data[5000:]
    pieces = [{p[a:b] for a, b in zip([0, *c], c)} for p, c in zip((data, changed), media.cuts([data, changed]))]
    assert len(pieces[0] & pieces[1]) >= len(pieces[0]) - 4
    assert all(b - a <= media.MOST for c in media.cuts([data]) for a, b in zip([0, *c], c))


def test_shards(spark, docs):
    weights = [1.0, 2.0, 0.5, 1.0]
    many = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a, b = sharding.assign_shards(many, "doc_id", weights), sharding.assign_shards(many, "doc_id", [*weights, 1.0], shard="grown")
    both = a.join(b, "doc_id")
    assert both.where("shard <> grown AND grown <> 4").count() == 0
    share = {r["shard"]: r["n"] / 20_000 for r in a.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(share[i] - w / 4.5) < 0.02 for i, w in enumerate(weights))
    slots = sharding.with_slots(sharding.assign_shards(docs, "doc_id", weights), "doc_id", buckets=4).groupBy("shard").agg(F.collect_list("slot").alias("s")).collect()
    assert all(sorted(r["s"]) == list(range(len(r["s"]))) for r in slots) and sum(len(r["s"]) for r in slots) == docs.count()
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [1.0, 0.0])


def test_poisson_mixture(spark, docs):
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3000 == 0, "rare").when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"))
    mixed = mixing.replicate(many, "doc_id", "lang", {"a": 0.5, "b": 0.3, "rare": 0.2})
    got = {r["lang"]: r["count"] for r in mixed.groupBy("lang").count().collect()}
    assert all(abs(got[k] - 30_000 * w) < 500 for k, w in (("a", 0.5), ("b", 0.3), ("rare", 0.2)))  # rare: a rate of 600
    ordered = mixing.shuffled(mixing.replicate(docs, "doc_id", "lang", {"en": 1.0, "de": 3.0}), "doc_id", buckets=8)
    assert sorted(r["position"] for r in ordered.collect()) == list(range(ordered.count())) and "lang" in ordered.columns
    assert mixing.replicate(docs.limit(0), "doc_id", "lang", {"en": 1.0}).count() == 0


def plain_classes(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for x in range(len(rows)):
            for y in range(x):
                if label[x] != label[y] and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    return sorted((i, len(s), m) for (i, _), s, m in zip(rows, sets, label))


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_near_copies(spark, n, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rnd = random.Random(n)
    base = [[f"w{rnd.randrange(500)}" for _ in range(rnd.choice([12, 40, 90, 200]))] for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "one two"), (5, "  ")]
    for k in range(150):
        own = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 8])):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(50)}"
        rows.append((10 + k, " ".join(own).upper() if k % 9 == 0 else " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("own"))
    assert sorted(map(tuple, jaccard.classes(docs, n, percent).collect())) == plain_classes(rows, n, percent)


def test_near_copies_of_nothing_and_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.classes(docs, 3, 90).collect()), key=str)
    assert got == sorted([(None, 4, 7), (7, 4, 7), (7, 4, 7), (None, 0, None)], key=str)
    assert jaccard.classes(docs.limit(0), 3, 90).count() == 0


def test_roots_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in jaccard.roots(edges).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[100] == got[101] != got[0]


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no tables here")
def test_pipeline_stages(spark):
    from freshet.llm import quality, secret_scan
    from freshet.llm.common import written

    docs = spark.read.parquet(f"{HERE}/documents.parquet")
    columns = docs.columns
    ruled = written(corpus_pipeline.quality_rules(spark, docs, HERE), "t")
    assert ruled.columns == columns and 0 < ruled.count() < docs.count()
    kept = written(corpus_pipeline.ngram_jaccard(spark, ruled, HERE), "t")
    rows = texts(ruled)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, m in plain_classes(rows, 5, 80) if i == m} and kept.columns == columns
    clean = written(corpus_pipeline.secret_spans(spark, kept, HERE), "t")
    before = dict(texts(kept))
    assert dict(texts(clean)) == {i: secret_scan.masked(t, s) for (i, t), s in zip(before.items(), secret_scan.found(list(before.values())))}
    mixed = written(corpus_pipeline.language_mix(spark, clean, HERE), "t")
    assert mixed.columns == columns and mixed.join(clean, columns, "left_anti").isEmpty()
    pieces = corpus_pipeline.packed_sequences(spark, mixed, HERE)
    per_doc = {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg((F.sum("length") / F.first("doc_tokens")).alias("n")).collect()}
    assert per_doc == {r["doc_id"]: float(r["count"]) for r in mixed.groupBy("doc_id").count().collect()}
    assert quality.judged(docs).where("_quality.kept").count() == ruled.count()


def prose(seed, n=60):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def test_near_copies_are_removed_by_row(spark):
    a, b, c, d = (prose(k) for k in range(4))
    near = [*b[:-1], "other"]
    rows = [(7, a), (7, b), (7, c), (3, near), (9, d), (9, d), (9, a), (4, []), (4, [])]
    rows = [(i, " ".join(w)) for i, w in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = sorted([rows[0], rows[2], rows[3], rows[4], rows[7], rows[8]])
    assert sorted(texts(corpus_pipeline.ngram_jaccard(spark, docs, ""))) == wanted
    hot = [(1, " ".join(prose(k))) for k in range(10, 60)]
    assert sorted(texts(corpus_pipeline.ngram_jaccard(spark, spark.createDataFrame(hot, "doc_id long, text string"), ""))) == sorted(hot)


def test_rows_without_ids_link_and_are_removed(spark):
    base, alone = prose(1, 100), prose(2, 100)
    left, right = ["x", *base[1:]], [*base[:-1], "y"]  # 0.96 alike, each 0.98 to base
    rows = [(8, left), (5, right), (None, base), (None, alone), (None, alone), (None, [*alone[:-1], "z"]), (None, []), (None, prose(3))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = jaccard.members(docs, 3, 97).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(8, 5), (5, 5), (None, 5), *[(None, None)] * 5], key=str)
    assert len({r["component"] for r in got}) == 4  # a class with ids, one without, a text alone, none
    kept = texts(corpus_pipeline.ngram_jaccard(spark, docs, ""))
    assert sorted(i for i, _ in kept if i is not None) == [5] and len(kept) == 4
    assert (None, "") in kept and (None, " ".join(prose(3))) in kept


def test_mixture_by_source_keeps_all_groups(spark, monkeypatch):
    sizes = {"hot": 18_000, "b": 1800, None: 200}
    rows = [(s, k) for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame([(i, "t", None if i % 2 else "zz", s, 1) for i, (s, _) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    whole = sum(n**0.7 for n in sizes.values())
    wanted = {s: 20_000 * n**0.7 / whole for s, n in sizes.items()}
    for limit in (10**6, 0):  # by broadcast and by join
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
        got = {r["source"]: r["count"] for r in corpus_pipeline.source_mix(spark, docs, "").groupBy("source").count().collect()}
        assert set(got) == set(sizes) and all(abs(got[s] - w) < 5 * (w * max(1, w / sizes[s])) ** 0.5 for s, w in wanted.items())
    some = mixing.replicate(docs, "doc_id", "source", {"hot": 1.0}, other=0.5)
    assert {r["source"] for r in some.select("source").distinct().collect()} == set(sizes)


def test_shards_against_plain_hashes(spark, tmp_path):
    """The query itself on null, empty, long and repeated rows: shards, the one more shard, sizes, CRCs, slots."""
    rows = [(i, f"text {i} \u00e9") for i in range(300)] + [(3, None), (3, ""), (None, "x"), (7, "y" * 50_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def best(key, shards):
        us = [int(hashlib.md5(f"shard:{i // 4}:{key}".encode()).hexdigest()[8 * (i % 4) : 8 * (i % 4) + 8], 16) for i in range(shards)]
        return max(range(shards), key=lambda i: us[i])

    got = sharding.op6_rendezvous_shards(spark, str(tmp_path)).collect()
    key = lambda d: "" if d is None else str(d)
    wanted = sorted((key(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), best(key(d), 16), best(key(d), 17)) for d, t in rows)
    assert sorted((key(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == wanted
    assert all(r["grown_shard"] in (r["shard"], 16) and r["law"] == "key" for r in got)
    for shard in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("name", ["op1_poisson_mix", "op3_repetition_rules", "op9_partenum_jaccard", "op10_block_tree"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{HERE}/{t}.parquet'")
    got, wanted = registry.QUERIES[name](spark, HERE), con.execute(registry.ORACLE[name])
    names = sorted(got.columns)
    assert names == sorted(x[0] for x in wanted.description)
    at = [[x[0] for x in wanted.description].index(n) for n in names]
    plain = lambda row: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(plain(r) for r in got.select(names).collect()) == sorted(plain([row[i] for i in at]) for row in wanted.fetchall())


def test_large_hubs(spark, monkeypatch):
    """More near copies and outsiders than a block holds, in bins that mix roots."""
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "PART", 16)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(140):
        own = list(base)
        at = rnd.randrange(100)
        for j in range(rnd.choice([2, 4, 8, 14, 22])):
            own[at + j if at + j < 120 else j] = f"n{k}-{j}" if k % 3 else f"m{k % 5}-{j}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.classes(docs, 5, 80).collect())) == plain_classes(rows, 5, 80)


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, repeated doc_ids, an empty table, and columns with the names that stages use themselves."""
    text = lambda k: " ".join(prose(k))
    names = "rate replica _order _rate _n _quality _digest _id row key group".split()
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in names)
    rows = [(i, t, None, s, None, *names) for i, t, s in [(1, text(1), "a"), (1, text(2), "a"), (2, text(1), None), (None, text(3), "b"), (4, None, "b"), (5, "", None)]]
    docs = spark.createDataFrame(rows, schema)
    for docs_ in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs_ = written(stage(spark, docs_, ""), name)
            assert docs_.columns == docs.columns
            assert all(tuple(r)[5:] == tuple(names) for r in docs_.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, docs_, "").count() >= 0
    kept = texts(corpus_pipeline.ngram_jaccard(spark, docs, ""))
    assert sorted(kept, key=str) == sorted([(1, text(1)), (1, text(2)), (None, text(3)), (4, None), (5, "")], key=str)


def test_short_texts_fill_sequences():
    packer, made = packing.Packer(), []
    for i in range(3000):
        made += packer.add(i, 4, 1)
    made += packer.sequences(True)
    assert sum(n for pieces in made for _, _, n in pieces) == 12_000 and len(made) == 3


def test_all_limits_bind_in_plain_documents():
    def packed(sizes):
        packer = packing.Packer()
        made = [s for i, n in enumerate(sizes) for s in packer.add(i, n, 1)] + list(packer.sequences(True))
        assert collections.Counter((k, x) for s in made for k, a, n in s for x in range(a, a + n)) == collections.Counter((k, x) for k, n in enumerate(sizes) for x in range(n))
        return made, [sum(packer.loss(a, n, 1) for _, a, n in s) for s in made]

    made, _ = packed([3000] * 8 + [1] * 4000)
    assert len(made) == 7 and len(made[0]) <= 733 and sum(n for _, _, n in made[0]) == 4096  # one limit: 1097 pieces in the first
    made, loss = packed([4000] * 20 + [5] * 1000)
    assert len(made) == 21 and loss[0] <= 4072 and max(loss) < 4090


def test_wide_ids_are_refused():
    with pytest.raises(ValueError):
        rans._short(np.array([1, 70_000], "<u4").tobytes())
