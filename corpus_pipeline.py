"""The corpus pipeline: quality, near copies, benchmark passages, personal data, token ids.

Each stage reads what the one before wrote. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, pii, quality, queries, simhash
from millrace.llm.common import cut, having, made, release, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches the classifier's bound."""
    queries.small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.grade(docs, model).filter("keep").select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (of repeated rows, one).

    A row is judged by its own text, whatever other rows have its id; a null id comes last.
    """
    queries.small_batches(spark)
    since = made()
    rows = cut(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("number")), "numbered")
    groups = simhash.copy_groups(rows.select("number", "doc.doc_id", "doc.text").withColumnRenamed("doc_id", "id"))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "number")).alias("first"))
    kept = cut(first.select("first.number"), "kept")
    release(since, rows, kept)
    return having(rows, kept).select("doc.*")


def text_digest() -> Column:
    return F.sha2(F.encode("text", "UTF-8"), 256)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item, each judged by its own text."""
    since, named = made(), docs.withColumn("_digest", text_digest())
    found = decontam.contamination(named, table(spark, sf_dir, "benchmark"), id_="_digest").filter("n_hit > 0").select("_digest").distinct()
    found = cut(found, "hit")
    release(since, found)
    return having(named, found, "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; ``n_chars`` follows the new text."""
    out = pii.replace_pii(docs)
    changed = F.when(F.size("entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and whether they decode to the text."""
    queries.small_batches(spark)
    coded = bpe.bpe(docs.withColumn("_digest", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)), queries.BPE_FILE)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), (F.sha2(F.encode("decoded", "UTF-8"), 256) == F.col("_digest")).alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: The stages' models and sketches are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
