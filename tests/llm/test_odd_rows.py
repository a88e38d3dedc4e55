"""Queries of the training-data operators on odd rows: clashing names, nulls, empty texts, repeated ids."""

import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm import html_text, media, mixing, ordinal, packing, rans, secret_scan, sharding

ODD = [(1, "one two three", "en", "a", 3), (1, "one two three", "en", "a", 3), (1, "another text", "de", "a", 3), (2, None, "en", "b", None), (3, "", "fr", None, 0), (None, "no id here", "es", "b", 9), (4, "word " * 4000, "en", "a", 1), (5, "é中\U0001f600 ", None, "c", 1)]
EXTRA = ["_rate", "_group", "_order", "_bucket", "_n", "_rank", "_before", "Position", "rate", "replica", "row", "key", "digest", "shard", "slot", "start", "feature"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(7) for c in EXTRA})
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(1, 1, 0), (2, 0, 1), (3, 0, 0), (None, 1, 0), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def text(t):
    return (t or "").encode()


def test_op1_keeps_columns_of_any_name(spark, odd):
    out = mixing.op1_poisson_mix(spark, odd)
    rows = out.collect()
    kept = [c for c in EXTRA if c.lower() not in ("rate", "replica", "position")]
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", *kept, "rate", "replica", "position"}
    assert sorted(r.position for r in rows) == list(range(len(rows))) and all(r._rate == r._bucket == r.key == 7 for r in rows)
    assert {r.lang for r in rows} <= set(mixing.LANGUAGE_WEIGHTS)
    ones = Counter(r.text for r in rows if r.doc_id == 1 and r.lang == "en")
    assert ones["one two three"] % 2 == 0  # repeated rows share their count


def test_laid_out_keeps_every_row(spark):
    df = spark.createDataFrame([(i % 3, 0, i) for i in range(50)], "doc_id long, replica int, _order int")
    assert sorted(r._order for r in mixing.laid_out(df, "doc_id").collect()) == list(range(50))


def test_op2_bounds_its_sample_and_refuses_grades(spark, odd):
    got = ordinal.op2_ordinal_grades(spark, odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.expected_grade <= 2 and r.p_1 >= r.p_2 for r in got)
    alike = {(r.expected_grade, r.p_2) for r in got if r.doc_id == 1}
    assert len(alike) <= 2
    docs = spark.createDataFrame([(1, f"text {i} of the same id") for i in range(400)] + [(2, "bad words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, g int")
    seen = []
    fit = ordinal.fitted
    model = ordinal.trained(docs, labels, F.col("g"), rows=50)
    assert model.thresholds.shape == (2,) and fit is ordinal.fitted and not seen
    with pytest.raises(Exception, match="no such grade: 7"):
        ordinal.trained(docs, spark.createDataFrame([(1, 7)], "doc_id long, g int"), F.col("g"))


def test_op4_reads_back_every_row(spark, odd):
    got = rans.op4_rans_ids(spark, odd).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for k, t, *_ in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        wanted[k, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == wanted
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_op5_payloads_come_back(spark, odd):
    import hashlib

    got = media.op5_chunked_media(spark, odd).collect()
    wanted = Counter()
    for k, t, *_ in ODD:
        raw = text(t)
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        wanted[k, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == wanted
    equal = {(r.media_bytes, r.media_sha256, r.feature) for r in got if r.n_bytes == len(text(ODD[0][1])) and r.payload_sha256 == next(x.payload_sha256 for x in got if x.doc_id == 1 and x.n_bytes == 13)}
    assert len(equal) == 1 and all(r.media_bytes > 0 and r.feature for r in got)


def test_op6_slots_are_gapless(spark, odd):
    got = sharding.op6_rendezvous_shards(spark, odd).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, len(text(t)) + 1, zlib.crc32(text(t))) for k, t, *_ in ODD)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_op7_judges_rows_one_by_one(spark, odd):
    got = secret_scan.op7_secret_automaton(spark, odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, *_ in ODD) and all(r.n_assign == r.n_access == r.n_hex == 0 for r in got)


def test_op8_packs_odd_rows_whole(spark, odd):
    got = packing.op8_vector_packing(spark, odd).collect()
    assert Counter(k for k, *_ in ODD) == Counter({k: sum(r.start == 0 for r in got if r.doc_id == k) for k in {k for k, *_ in ODD}})
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 4096 and sorted(v)[0][0] == 0 for v in by.values())


def test_empty_documents_fill_sequences(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(20_000)], "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER)).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(got) == 5 and sum(r.n for r in got) == 20_000


def test_short_documents_are_spread_over_sequences(spark):
    docs = spark.createDataFrame([(i, "word " * 3000 if i % 76 == 0 else "") for i in range(3040)], "doc_id long, text string").coalesce(1)
    got = corpus_pipeline.packed_sequences(spark, docs, "").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("pieces")).collect()
    assert max(r.pieces for r in got) < 300 and sum(r.n for r in got) > 4090 * (len(got) - 2)  # a limit of 4096 pieces: more than 600 in one


@pytest.mark.parametrize("name", ["newsletter", "widget", "notice", "alert-text", "tags", "post share", "story-text legal", "card-login", "widget-area main-content", "content section-comment"])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_names_of_what_holds_the_text_are_outvoted(name, tag):
    story = "<h1>A headline</h1>" + "".join(f"<p>Paragraph number {i} says quite a lot of words about the river and what it did to the town in spring.</p>" for i in range(3))
    page = f'<body><nav><a href="/">Home</a></nav><{tag} class="{name}">{story}</{tag}><div class="newsletter-signup"><p>Get it by mail.</p></div><footer>Imprint</footer></body>'
    assert html_text.main_text(page).split("\n")[0] == "A headline" and html_text.main_text(page).count("\n") == 3


def test_forms_and_comments():
    story = "<h1>A headline</h1>" + "<p>A paragraph that says quite a lot of words about the river and what it did to the town.</p>" * 2
    talk = '<div class="comments"><h3>Comments</h3>' + "<p>I was there and saw how the river came into the town and what it did to our house and garden.</p>" * 5 + "</div>"
    got = html_text.main_text(f'<body><form id="f"><div>{story}</div><div class="search"><p>Search here</p></div></form>{talk}</body>')
    assert got.count("\n") == 2 and "I was there" not in got and "Search" not in got
    assert html_text.main_text('<body><div class="cookie-notice"><h2>Cookies</h2><p>We use them.</p></div></body>') == ""
