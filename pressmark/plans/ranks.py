"""Exact order statistics without a global sort or a one-partition window.

``cut_values`` finds the values at given ranks of a 64-bit key by refining a
histogram: each pass counts the rows per cell of the intervals that still hold a
wanted rank (map-side combined, at most intervals x cells rows reach the driver)
and narrows every interval by a factor of ``CELLS``.  Rows are then put into
folds or sections by comparing their key with the few cut values, which is a
plain projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

CELLS = 1024
SMALL = 20_000  # values the driver may sort itself

HASH_HEX = 15  # 60 bits of the digest, an order-preserving BIGINT


def hash_key(key: Column, salt: str) -> Column:
    """Pseudo-random BIGINT order: the first 60 bits of md5(key || salt)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, HASH_HEX), 16, 10).cast("bigint")


def cut_values(
    df: DataFrame,
    value: Column,
    ranks: Callable[[int], Sequence[int]],
    by: Column | None = None,
) -> dict[str, tuple[int, dict[int, int]]]:
    """Per group: (row count, {rank: value at that 0-based rank}).

    ``ranks`` maps the number of rows of a group to the wanted ranks.  ``by`` must
    have few distinct values (labels, pipelines); its values are returned as text.
    """
    group = F.lit("") if by is None else by.cast("string")
    base = df.select(group.alias("g"), value.cast("bigint").alias("v"))
    stats = base.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).collect()
    result: dict[str, tuple[int, dict[int, int]]] = {}
    # (group, lo, hi) -> (rows below lo, wanted ranks)
    open_: dict[tuple[str, int, int], tuple[int, list[int]]] = {}
    size: dict[tuple[str, int, int], int] = {}
    for s in stats:
        wanted = [r for r in ranks(s.n) if 0 <= r < s.n]
        result[s.g] = (s.n, {})
        if wanted:
            open_[(s.g, s.lo, s.hi)] = (0, wanted)
            size[(s.g, s.lo, s.hi)] = s.n
    while open_:
        if sum(size[k] for k in open_) <= SMALL:
            _finish(base, open_, result)
            break
        open_, size = _refine(base, open_, result)
    return result


def _within(base: DataFrame, open_: Mapping[tuple[str, int, int], object]) -> DataFrame:
    spec = [(g, lo, hi, max(1, -(-(hi - lo + 1) // CELLS))) for g, lo, hi in open_]
    if {g for g, *_ in spec} == {""}:  # one group: at most a dozen intervals, as literals
        literals = F.array(*[
            F.struct(*[F.lit(x).cast("bigint").alias(n) for n, x in zip(("lo", "hi", "width"), s[1:])]) for s in spec
        ])
        inside = F.filter(literals, lambda s: F.col("v").between(s["lo"], s["hi"]))
        return base.select("g", "v", F.inline(inside))
    intervals = base.sparkSession.createDataFrame(spec, "g string, lo bigint, hi bigint, width bigint")
    # one row per open interval: bounded by groups x ranks
    return base.join(F.broadcast(intervals), "g").where(F.col("v").between(F.col("lo"), F.col("hi")))


def _finish(base, open_, result) -> None:
    found: dict[tuple[str, int, int], list[int]] = {k: [] for k in open_}
    for row in _within(base, open_).select("g", "lo", "hi", "v").collect():
        found[(row.g, row.lo, row.hi)].append(row.v)
    for key, (below, wanted) in open_.items():
        ordered = sorted(found[key])
        for r in wanted:
            result[key[0]][1][r] = ordered[r - below]


def _refine(base, open_, result):
    cells: dict[tuple[str, int, int], dict[int, int]] = {k: {} for k in open_}
    counted = (
        _within(base, open_)
        .withColumn("cell", F.expr("(v - lo) div width"))
        .groupBy("g", "lo", "hi", "cell").agg(F.count(F.lit(1)).alias("n"))
    )
    for row in counted.collect():
        cells[(row.g, row.lo, row.hi)][row.cell] = row.n
    nxt, size = {}, {}
    for (g, lo, hi), (below, wanted) in open_.items():
        width = max(1, -(-(hi - lo + 1) // CELLS))
        seen = below
        pending = sorted(wanted)
        for cell in sorted(cells[(g, lo, hi)]):
            n = cells[(g, lo, hi)][cell]
            inside = [r for r in pending if r < seen + n]
            if inside:
                c_lo = lo + cell * width
                c_hi = min(hi, c_lo + width - 1)
                if width == 1:
                    result[g][1].update(dict.fromkeys(inside, c_lo))
                else:
                    nxt[(g, c_lo, c_hi)] = (seen, inside)
                    size[(g, c_lo, c_hi)] = n
                pending = pending[len(inside):]
            seen += n
    return nxt, size


def section_column(value: Column, cuts: Sequence[int]) -> Column:
    """Number of cut values at or below ``value`` (cuts in ascending order)."""
    section = F.lit(0)
    for cut in cuts:
        section = section + F.when(value >= F.lit(cut), 1).otherwise(0)
    return section


def even_starts(k: int) -> Callable[[int], list[int]]:
    """First ranks of parts 1..k-1 when the first n mod k parts get one row more."""

    def starts(n: int) -> list[int]:
        small, extra = divmod(n, k)
        return [i * small + min(i, extra) for i in range(1, k)]

    return starts


def proportional_starts(k: int) -> Callable[[int], list[int]]:
    """First ranks of parts 1..k-1 when part i covers [i*n/k, (i+1)*n/k)."""
    return lambda n: [i * n // k for i in range(1, k)]
