"""A cleaning pipeline over the documents: quality, repeated lines, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as
the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressmark.llm import line_dedup, ngram_join, packing, quality_rules, secret_scan
from pressmark.llm.common import table
from pressmark.llm.queries import WORD_BPE
from pressmark.session import shared_folder


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with ``n_chars`` as the length of the changed text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines leave the texts; a text without any word left goes."""
    found = _with_length(line_dedup.line_dedup(docs), docs)
    return found.where(F.col("text").rlike(r"[^\s]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates the row of the smallest doc_id stays; texts without words stay.

    Of several rows with that id the smallest text hash stays, of equal rows one.
    """
    groups = ngram_join.ngram_join(docs)
    best = groups.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(
        F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")).alias("b")).select("b.*")
    rows = docs.select(
        F.struct("*").alias("row"), F.isnull("doc_id").alias("none"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"))
    # the join leaves equal rows in one place, so dropping copies moves nothing
    key = ["none", "id", "text_hash"]
    left = rows.where("words").join(best, key, "left_semi").dropDuplicates(key)
    return left.select("row.*").unionByName(rows.where("NOT words").select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _with_length(secret_scan.redact(secret_scan.secret_scan(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 2048 ids."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", pack),
]

#: Hashed n-gram sets and BPE ids have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
