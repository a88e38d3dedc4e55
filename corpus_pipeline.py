"""A training corpus from `documents`: rules, near copies, secrets, mixture, sequences. Each stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import jaccard, mixing, packing, quality, secret_scan
from freshet.llm.common import BROADCAST_ROWS, small_batches, table, written

#: Words of a shingle, and the Jaccard similarity in percent from which documents are near copies.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _row(docs: DataFrame) -> Column:
    """All columns as one, so that what a stage adds can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the repetition rules reject, among them null, empty and wordless texts.

    Rows that repeat a doc_id are judged one by one, on their whole texts; other columns stay as they are.
    """
    small_batches(spark)
    return quality.judged(docs.select(_row(docs), "text")).where("_quality.kept").select("row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the least doc_id, of several such texts one.

    Rows are known by doc_id and digest, so that other texts of the same doc_id are judged by their own classes.
    Rows without doc_id come last in their class: one stays if no row of it has an id. Texts without words stay.
    An empty table gives no rows; other columns stay as they are.
    """
    found = jaccard.members(docs, SHINGLE_WORDS, SIMILARITY).where("node IS NOT NULL")
    rows = written(found.groupBy("component", "doc_id", "node", "digest").agg(F.count(F.lit(1)).alias("rows")), "members")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "digest")).alias("first"))
    first = written(first, "firsts")  # so that the join may split a large class
    stays = F.expr("doc_id <=> first.doc_id AND node = first.node AND digest = first.digest")
    judged = written(rows.join(first, "component").select("doc_id", "digest", "rows", stays.alias("stays")), "near-copies")

    def of(docs: DataFrame, judged: DataFrame, how: str) -> DataFrame:
        own = judged.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_of"))
        own = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
        return docs.join(own, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of")), how)

    kept = of(docs.select(_row(docs), jaccard.text_digest().alias("_digest")), judged.where("NOT stays"), "left_anti")
    repeated = judged.where("stays AND rows > 1")
    if not repeated.isEmpty():
        kept = of(kept, repeated, "left_anti").union(of(kept, repeated, "left_semi").withColumn("_id", F.col("row.doc_id")).dropDuplicates(["_id", "_digest"]).drop("_id"))
    return kept.select("row.*")


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars, if there is such a column, those of the text that is left.

    Null and empty texts stay as they are; rows that repeat a doc_id are masked one by one.
    """
    masked = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts to tempered shares of all sources, null as one, in a global random order.

    Rows that repeat a doc_id share its count; without doc_id the key is empty. Null texts are mixed like others.
    """
    keyed = docs.select(_row(docs), F.col("doc_id").alias("key"), F.col("source").alias("group"))
    return mixing.laid_out(mixing.replicate(keyed, "key", "group", None), "key").select("row.*")


language_mix = source_mix  # its former name


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; null and empty texts are the end id, repeated rows are packed each.

    Segments and loss-bearing tokens of a sequence are limited by what is left to pack, so that short documents are spread over the sequences.
    """
    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_spans", secret_spans),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: The last stage's tokens can't be had from SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
