"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's ids (its tokens and an end id) are cut into full sequences and one remainder.  The
histogram of piece lengths is the demand of a cutting-stock problem: a linear program over patterns
(how many pieces of each length class share a sequence), whose columns are priced by a knapsack
dynamic program.  Patterns are used a whole number of times; what rounding leaves over is packed
largest first.  Pieces are ranked within their length class, and a piece's rank tells its sequence
by arithmetic, so no list of documents ever meets in one place.

The driver sees the histogram (at most ``length / width`` numbers) and the patterns, however many
documents there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import binary, column, settled, slices
from .word_bpe import word_encoder

LENGTH = 2048
#: Lengths are rounded up to multiples of this in the linear program; it costs width / 2 ids a piece.
WIDTH = 4
END_ID = 1
ROUNDS = 1_000
#: Stop when at most this share of the sequences could still be saved.
GAP = 5e-4
RANKED = 200_000
#: Bytes of text encoded at once.
SLICE = 2 << 20
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int"


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """Every document cut into full sequences and a remainder; ``class`` is the length in steps of ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer_path)
        for whole in batches:
            # the arrays of a slice are some twenty times its text
            for batch in slices(whole, "text", SLICE):
                ids, counts = enc.batch(column(batch, "text"))
                # the end id behind every document
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, END_ID).astype("<u4")
                n = counts + 1
                begins = np.cumsum(n) - n
                parts = -(-n // length)
                doc = np.repeat(np.arange(len(n)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
                size = np.minimum(length, n[doc] - start)
                data, at = memoryview(ids.tobytes()), begins[doc] + start
                cut = [data[4 * a:4 * (a + s)] for a, s in zip(at.tolist(), size.tolist(), strict=True)]
                arrays = [
                    column(batch, "doc_id").take(pa.array(doc)), pa.array(start), pa.array(size),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(n[doc]),
                    pa.array((-(-size // width)).astype(np.int32)),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
                if with_ids:
                    arrays.append(binary([c.tobytes() for c in cut]))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest pattern: unbounded knapsack over sizes 1..capacity, ``values[s - 1]`` for size s."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        found = values[:c] + best[c - 1::-1]
        k = int(found.argmax())
        if found[k] > best[c - 1]:
            best[c], took[c] = found[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(values), np.int64), capacity
    while c:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def first_patterns(demand: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis: the largest size left, filled up as well as the sizes left allow.

    Every pattern uses up one size, which later patterns lack, so the columns are independent.
    """
    capacity, m = len(demand), len(sizes)
    left, open_ = demand[sizes - 1].copy(), np.ones(m, bool)
    columns, amount = np.zeros((m, m)), np.zeros(m)
    place = np.full(capacity + 1, -1)
    place[sizes] = np.arange(m)
    for j in range(m):
        largest = int(np.flatnonzero(open_)[-1])
        values = np.full(capacity, -1.0)
        values[sizes[open_] - 1] = sizes[open_]
        _, rest = price(values, capacity - int(sizes[largest]))
        pattern = np.zeros(m)
        held = np.flatnonzero(rest) + 1
        pattern[place[held]] = rest[held - 1]
        pattern[largest] += 1
        use = np.where(pattern > 0, left / np.where(pattern > 0, pattern, 1), np.inf)
        spent = int(use.argmin())
        columns[:, j], amount[j] = pattern, use[spent]
        left = np.maximum(left - use[spent] * pattern, 0)
        left[spent], open_[spent] = 0, False
    return columns, amount


def patterns(demand: np.ndarray, rounds: int = ROUNDS, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """(pattern, times used) that cover ``demand[s - 1]`` pieces of size s exactly; capacity is len(demand).

    Column generation by the revised simplex method.
    """
    capacity = len(demand)
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    m = len(sizes)
    columns, amount = first_patterns(demand.astype(float), sizes)
    inverse = np.linalg.inv(columns)
    least = float((sizes * demand[sizes - 1]).sum()) / capacity
    for _ in range(rounds):
        if amount.sum() <= (1 + gap) * least:
            break
        dual = inverse.sum(axis=0)
        values = np.full(capacity, -1.0)
        values[sizes - 1] = np.maximum(dual, 0)
        worth, pattern = price(values, capacity)
        if worth <= 1 + gap:
            break
        entering = pattern[sizes - 1].astype(float)
        step = inverse @ entering
        usable = step > 1e-9
        ratio = np.where(usable, amount / np.where(usable, step, 1), np.inf)
        leave = int(ratio.argmin())
        amount = amount - ratio[leave] * step
        amount[leave] = ratio[leave]
        amount = np.maximum(amount, 0)
        row = inverse[leave] / step[leave]
        step[leave] = 0
        inverse -= np.outer(step, row)
        inverse[leave] = row
        columns[:, leave] = entering
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    for j in range(m):
        pattern = np.zeros(capacity, np.int64)
        pattern[sizes - 1] = columns[:, j].round().astype(np.int64)
        # whole uses only, and never more pieces than there are
        held = pattern > 0
        times = int(min(np.floor(amount[j] + 1e-6), (left[held] // pattern[held]).min())) if held.any() else 0
        if times > 0:
            left -= times * pattern
            out.append((pattern, times))
    while left.any():
        pattern, room = np.zeros(capacity, np.int64), capacity
        for s in range(capacity, 0, -1):
            if left[s - 1] and s <= room:
                pattern[s - 1] = min(left[s - 1], room // s)
                room -= pattern[s - 1] * s
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        left -= times * pattern
        out.append((pattern, times))
    return out


def _places(plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first rank, pieces a sequence and first sequence of every pattern that holds it."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        for k in np.flatnonzero(pattern).tolist():
            each = int(pattern[k])
            found.setdefault(k + 1, []).append((ranks.get(k + 1, 0), each, sequence))
            ranks[k + 1] = ranks.get(k + 1, 0) + each * times
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row a piece.

    Null and empty texts hold the end id alone.  Rows with a null or a repeated doc_id are packed like
    any other, one document each.  Other columns are ignored.  No rows give no pieces.
    """
    cut = settled(pieces(docs, tokenizer_path, length, width, with_ids), "pieces")
    # counts by (class, bucket): the histogram of the linear program and the ranks' first numbers
    total = cut.count()
    buckets = max(1, -(-total // RANKED))
    # rows of one document fall into different buckets, so a hot doc_id spreads as well
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    by_bucket = bucketed.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    demand = np.zeros(-(-length // width), np.int64)
    for row in by_bucket.groupBy("class").agg(F.sum("n").alias("n")).collect():
        demand[row["class"] - 1] = row["n"]
    places = _places(patterns(demand))
    first = by_bucket.withColumn(
        "before", F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select("class", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = bucketed.withColumn("place", F.row_number().over(order) - 1).join(first, ["class", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "bucket")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = column(batch, "class").to_numpy()
            ranks = column(batch, "rank").to_numpy().astype(np.int64)
            sequence = np.zeros(len(ranks), np.int64)
            for k in np.unique(classes).tolist():
                here = classes == k
                begins, each, sequences = places[k]
                j = np.searchsorted(begins, ranks[here], "right") - 1
                sequence[here] = sequences[j] + (ranks[here] - begins[j]) // each[j]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], names=[*batch.schema.names, "sequence_id"])

    placed = ranked.mapInArrow(assign, ranked.schema.simpleString()[7:-1] + ", sequence_id:bigint")
    # a sequence holds at most ``length`` pieces
    within = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, *(["ids"] if with_ids else [])]
    return placed.select(*columns)


def padding(packed: DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """Sequences, ids and padding of a packed corpus, as one row; a sequence of a power of two long is not padded."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    exact = F.log2("used") == F.floor(F.log2("used"))
    return used.agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("ids"),
        F.sum(F.when(exact, 0).otherwise(length - F.col("used"))).alias("padding"),
    ).toPandas()
