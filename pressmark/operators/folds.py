"""Folds, sections and hold-out splits as projections on a handful of cut values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..plans import ranks

SEED = 42


def _salt(seed: int) -> str:
    return f"|{seed}"


def shuffled_folds(docs: DataFrame, k: int = 10, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Add ``fold``: k parts of a pseudo-random order, the first n mod k one row larger."""
    order = ranks.hash_key(F.col(key), _salt(seed))
    _, cuts = ranks.cut_values(docs, order, ranks.even_starts(k)).get("", (0, {}))
    return docs.withColumn("fold", ranks.section_column(order, [cuts[r] for r in sorted(cuts)]))


def stratified_folds(docs: DataFrame, k: int = 5, label: str = "label", key: str = "doc_id") -> DataFrame:
    """Add ``fold``: per label, k consecutive parts in key order."""
    found = ranks.cut_values(docs, F.col(key), ranks.even_starts(k), by=F.col(label))
    fold = F.lit(None).cast("int")
    for name, (_, cuts) in found.items():
        section = ranks.section_column(F.col(key), [cuts[r] for r in sorted(cuts)])
        fold = F.when(F.col(label).cast("string") == F.lit(name), section).otherwise(fold)
    return docs.withColumn("fold", fold)


def holdout(docs: DataFrame, test_share: float = 0.2, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Add ``is_test``: the first ceil(share * n) rows of a pseudo-random order."""
    order = ranks.hash_key(F.col(key), _salt(seed))
    size = lambda n: math.ceil(round(test_share * n, 9))
    n, cuts = ranks.cut_values(docs, order, lambda n: [size(n)]).get("", (0, {}))
    if not cuts:  # everything is test data
        return docs.withColumn("is_test", F.lit(True))
    return docs.withColumn("is_test", order < F.lit(cuts[size(n)]))
