"""Equi-joins against lookup tables whose size is only known at run time.

A lookup table (vocabulary, model, cache) has one row per key.  Three plans:

* the table fits a checked bound: broadcast it, the rows do not move;
* it does not: shuffle on the key.  Keys that many rows share are answered from
  a small broadcast part first and leave the shuffle key, so no task receives
  more than an even share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_BYTES = 256 * 1024 * 1024
HOT_KEYS = 2000


def row_bytes(df: DataFrame) -> int:
    """Rough width of a row of scalars; arrays are sized by the caller."""
    return 24 * len(df.columns) + 32


def fits_broadcast(rows: int, bytes_per_row: int) -> bool:
    return rows * bytes_per_row <= BROADCAST_BYTES


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    table_rows: int,
    bytes_per_row: int | None = None,
    frequency: Column | None = None,
    how: str = "inner",
    limit_bytes: int | None = None,
    widest_row: int | None = None,
) -> DataFrame:
    """Join ``rows`` with the one-row-per-key ``table`` on ``key``.

    ``table_rows`` is the counted size of the table.  ``frequency`` is a column of
    the table that tells how many rows hold the key; without it the counts are
    taken from ``rows``.  ``widest_row`` bounds the frequent entries that are broadcast beyond the limit.
    """
    width = bytes_per_row or row_bytes(table)
    limit = BROADCAST_BYTES if limit_bytes is None else limit_bytes
    if table_rows * width <= limit:
        return rows.join(F.broadcast(table), key, how)
    return _spread_lookup(rows, table, key, frequency, how, min(HOT_KEYS, max(1, BROADCAST_BYTES // (widest_row or width))))


def _spread_lookup(
    rows: DataFrame, table: DataFrame, key: str, frequency: Column | None, how: str, hot_keys_most: int = HOT_KEYS
) -> DataFrame:
    values = [c for c in table.columns if c != key]
    entry = F.struct(*[F.col(c) for c in values])
    if frequency is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        hot_keys = counts.orderBy(F.col("_n").desc()).limit(hot_keys_most).select(key)
        hot = table.join(F.broadcast(hot_keys), key, "left_semi").select(key, entry.alias("_hot"))
    else:
        # TakeOrdered: at most that many rows, whatever the table holds
        hot = (
            table.withColumn("_n", frequency).orderBy(F.col("_n").desc()).limit(hot_keys_most)
            .select(key, entry.alias("_hot"))
        )
    # Rows answered by the hot part get a spread-out key that matches nothing.
    marked = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_key",
        F.when(F.col("_hot").isNull(), F.struct(F.lit(0).cast("bigint").alias("salt"), F.col(key).alias("k")))
        .otherwise(F.struct((F.abs(F.xxhash64(*rows.columns)) + 1).alias("salt"), F.col(key).alias("k"))),
    )
    cold = table.select(
        F.struct(F.lit(0).cast("bigint").alias("salt"), F.col(key).alias("k")).alias("_key"),
        entry.alias("_cold"),
    )
    joined = marked.join(cold, "_key", "left").withColumn("_entry", F.coalesce("_hot", "_cold"))
    if how == "inner":
        joined = joined.where(F.col("_entry").isNotNull())
    return joined.select(*rows.columns, *[F.col("_entry")[c].alias(c) for c in values])


def broadcast_small(df: DataFrame, names: Sequence[str] | None = None, limit_bytes: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows one, else unchanged."""
    limit = BROADCAST_BYTES if limit_bytes is None else limit_bytes
    probe = df.select(*names) if names else df
    return F.broadcast(df) if probe.count() * row_bytes(df) <= limit else df
