"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, ann_tree, bpe_codec, knn_quality, lexical_treap, license_scan, line_dedup, ngram_join, packing, quality_rules, secret_scan, sharding, token_counts
from .common import table
from ..session import shared_folder

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated chunks of lines."""
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated runs of two or more lines, whatever their hashes."""
    found = line_dedup.passage_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after inserting all documents, deleting the toxic ones and revising those of low quality.

    A revised text has each of its lines once.  The deletion is sent twice and counts once.
    """
    versions = {"byte_bpe_50k": BYTE_RANKS, "byte_bpe_multi_50k": MULTI_RANKS}
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = token_counts.Ledger(spark, f"{shared_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    ledger.commit("1-insert", ledger.insertions(token_counts.count_tokens(docs, versions)))
    for _ in range(2):
        ledger.commit("2-delete", ledger.deletions(labels.where("toxic = 1").select("doc_id")))
    poor = labels.where("quality = 0 and toxic = 0").select("doc_id").distinct()
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    # an id whose texts all stay the same needs no revision; of any other all rows are revised, as
    # a revision takes back all that is known under its id
    changed = docs.where(once != F.col("text")).select("doc_id").join(poor, "doc_id", "left_semi").distinct()
    revised = docs.join(changed, "doc_id", "left_semi").withColumn("text", once)
    ledger.commit("3-revise", ledger.revisions(token_counts.count_tokens(revised, versions)))
    return ledger.totals()


def op3_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product for every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return ann_tree.search(vectors, vectors.where("vec_id % 20 = 0"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return license_scan.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("matches")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = ngram_join.ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    encoded = bpe_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), MULTI_RANKS)
    return bpe_codec.decode(encoded, MULTI_RANKS).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return knn_quality.quality_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by place."""
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter(
        "base_spans", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secret_scan.listed(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("all_spans")).alias("spans"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_lexical_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_treap.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of every document."""
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_RANKS, PIECE_BPE)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith(("op", "passage")) and callable(f)}


def statements() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.statement(), "passage_dedup": line_dedup.passage_statement(),
            "op8_quality_rules": quality_rules.statement(),
            "op11_sharding": sharding.statement(), "op12_lexical_treap": lexical_treap.statement()}
