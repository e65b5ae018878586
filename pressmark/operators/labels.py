"""Label dictionaries, encoding, label statistics and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.lookup import broadcast_small

UNLABELLED = "UNL"

# Classes a model may have; what is kept per class stays small.
MAX_LABELS = 10_000


def label_dictionary(articles: DataFrame, label: str = "label") -> DataFrame:
    """(label_idx, label): sorted distinct labels, numbered from 0.

    Labels that are all numbers sort as numbers.  The window runs over the
    distinct labels only.
    """
    distinct = articles.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label")).distinct()
    all_numbers = F.min(F.expr("try_cast(label as double)").isNotNull()).over(Window.partitionBy(F.lit(0)))
    as_number = F.when(F.col("numeric"), F.expr("try_cast(label as double)"))
    order = Window.partitionBy("numeric").orderBy(as_number, "label")
    return (
        distinct.withColumn("numeric", all_numbers)
        .withColumn("label_idx", F.row_number().over(order) - 1)
        .select("label_idx", "label")
    )


def label_list(articles: DataFrame, label: str = "label") -> list[str]:
    """The dictionary on the driver: one entry per class, at most MAX_LABELS."""
    found = [r.label for r in label_dictionary(articles, label).orderBy("label_idx").limit(MAX_LABELS + 1).collect()]
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} distinct values in {label!r}: that is no label")
    if not found:
        raise ValueError("the corpus holds no label")
    return found


def encode_labels(articles: DataFrame, dictionary: DataFrame, label: str = "label") -> DataFrame:
    known = broadcast_small(dictionary.withColumnRenamed("label", "_label"))
    return articles.join(known, F.col(label).cast("string") == F.col("_label"), "left").drop("_label")


def decode_labels(rows: DataFrame, dictionary: DataFrame, idx: str = "label_idx", out: str = "label") -> DataFrame:
    known = broadcast_small(dictionary.select(F.col("label_idx").alias("_idx"), F.col("label").alias(out)))
    return rows.join(known, F.col(idx) == F.col("_idx"), "left").drop("_idx")


def label_distribution(articles: DataFrame, year: str = "year", label: str = "label") -> DataFrame:
    """Counts per (year, label), ordered by both; rows without a year form the group 'None'."""
    return (
        articles.groupBy(
            F.coalesce(F.col(year).cast("string"), F.lit("None")).alias("year"), F.col(label).alias("label")
        )
        .agg(F.count(F.lit(1)).alias("size"))
        .orderBy("year", "label")
    )


def corpus_size(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count(F.lit(1)).alias("n_articles"))


def duplicate_count(articles: DataFrame, text: str = "raw_text") -> DataFrame:
    """(n_articles, n_duplicates): articles whose text was already seen."""
    copies = articles.groupBy(F.sha1(text).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_articles"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )
