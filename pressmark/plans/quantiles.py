"""Exact, linearly interpolated quantiles per key without holding a key in one task.

1. ``percentile_approx`` (a mergeable sketch of bounded size) brackets each wanted
   order statistic between two observed values.
2. One pass counts the rows below each bracket and the distinct values inside it;
   a running count over the few distinct values inside a bracket finds the value.

The rows are read twice; keep them if they are costly to compute.

The brackets are wide enough for the sketch's error; should one still miss its
rank, the keys concerned go through both steps again with a finer sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lookup import broadcast_small
from .staging import settle

ACCURACY = 10_000
FINEST = 2_000_000_000
GRID = 1000
# Bracket width on either side, in errors of the sketch.
MARGIN = 5.0


def exact_quantiles(
    rows: DataFrame, probabilities: Sequence[float], total: Column | None = None, accuracy: int = ACCURACY
) -> DataFrame:
    """(key, q ARRAY) from rows (key, value).

    ``total`` (an expression on ``key``) is the number of values of the key when
    the rows leave out zeros; every given value must then be >= 0.
    """
    found = settle(_bracketed(rows, probabilities, total, accuracy))
    missed = found.where("missed").select("key")
    right = found.where("NOT missed").select("key", "q")
    if missed.isEmpty():
        return right
    if accuracy >= FINEST:
        raise ValueError("the values of a key have no order to take quantiles of")
    again = rows.join(broadcast_small(missed), "key", "left_semi")
    return right.unionByName(exact_quantiles(again, probabilities, total, min(FINEST, accuracy * 100)))


def _bracketed(rows: DataFrame, probabilities: Sequence[float], total: Column | None, accuracy: int) -> DataFrame:
    """(key, q, missed): one round; ``missed`` where a bracket did not hold its rank."""
    p = list(probabilities)
    margin = MARGIN / accuracy
    points = ",".join(f"{i / GRID!r}D" for i in range(GRID + 1))
    sketch = f"percentile_approx(value, array({points}), {accuracy})"
    sizes = rows.groupBy("key").agg(F.count("value").alias("given"), F.expr(sketch).alias("grid"))
    n = F.col("given") if total is None else total
    zeros = n - F.col("given")
    # wanted ranks among the given values, 0-based; negative = one of the left-out zeros
    targets = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"),
                 ((F.floor if side == 0 else F.ceil)(F.lit(q) * (n - 1)) - zeros).cast("bigint").alias("rank"))
        for i, q in enumerate(p) for side in (0, 1)
    ])
    share = F.col("rank") / F.greatest(F.col("given") - 1, F.lit(1))
    low_at = F.greatest(F.lit(0), F.floor((share - margin) * GRID)).cast("int")
    high_at = F.least(F.lit(GRID), F.ceil((share + margin) * GRID)).cast("int")
    wanted = (
        sizes.select("key", "given", "grid", F.inline(targets))
        .where(F.col("rank") >= 0)
        .select("key", "i", "side", "rank", F.col("grid")[low_at].alias("low"), F.col("grid")[high_at].alias("high"))
    )
    brackets = wanted.groupBy("key").agg(F.collect_list(F.struct("i", "side", "rank", "low", "high")).alias("b"))
    # one bracket row per key: broadcast if their counted size allows.
    # All rows below a bracket fold into its null entry, so one exchange serves both counts.
    brackets = settle(brackets)
    each = rows.join(broadcast_small(brackets), "key").select("key", "value", F.inline("b"))
    counted = each.where(F.col("value") <= F.col("high")).groupBy(
        "key", "i", "side", "rank", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")
    ).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("key", "i", "side").orderBy(F.col("value").asc_nulls_first())
    hits = (
        counted.withColumn("last", F.sum("n").over(running))  # rows <= value
        .where(
            F.col("value").isNotNull()
            & (F.col("rank") < F.col("last")) & (F.col("rank") >= F.col("last") - F.col("n"))
        )
        .select("key", "i", "side", "value")
    )
    per_key = hits.groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("i") * 2 + F.col("side")).alias("slot"), "value"))).alias("hit")
    )
    out = sizes.select("key", "given").join(per_key, "key", "left")

    def statistic(i: int, q: float, side: int) -> Column:
        rank = (F.floor if side == 0 else F.ceil)(F.lit(q) * (n - 1)) - zeros
        return F.when(rank < 0, F.lit(0.0)).otherwise(F.try_element_at("hit", F.lit(2 * i + side)))

    quantiles = []
    for i, q in enumerate(p):
        position = F.lit(q) * (n - 1)
        fraction = position - F.floor(position)
        a, b = statistic(i, q, 0), statistic(i, q, 1)
        quantiles.append(a + (b - a) * fraction)
    q = F.array(*quantiles)
    return out.select("key", q.alias("q"), F.exists(q, lambda x: x.isNull()).alias("missed"))
