"""Ranked lexical search over a K2-treap of the term-document grid.

Rows of the grid are terms, columns are documents, a cell is the term's impact in the document.  A block
of documents is one quadtree: a node covers a square of the grid, a 4-bit mask tells which quarters hold
anything, and its value is the greatest impact inside.  Values are stored as differences to the parent.

An item follows the paths of all its rows at once.  A state is a range of documents with one node per
row; the sum of the nodes' maxima bounds the score of every document in the range.  States wait in a
priority queue, the best is halved first, and what cannot reach the worst of the k best found is dropped.
The best found are carried from block to block within a task, so a task sends k rows per item.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import binary, column, settled, slices

K = 10
BLOCK_DOCS = 16_384
BLOCK_CELLS = 500_000
ITEMS_AT_ONCE = 1_000
ITEM_BYTES_AT_ONCE = 8 << 20
CELLS_AT_ONCE = 16_384     # states taken from the queue together times rows of the item
#: Fixed value: the characters of a term in UTF-8 bytes, after A-Z became a-z.
TERM = rb"[0-9a-z\x80-\xff]+"
NOT_TERM = rb"[^0-9a-z\x80-\xff]"
PART = 1 << 20

POSTINGS = "doc_id bigint, n bigint, terms array<int>, times array<int>"
INDEX = "height int, doc_ids array<bigint>, masks binary, sizes array<bigint>, below binary, top bigint"
FOUND = "item int, doc_id bigint, score bigint"

#: For a mask and a quarter: is the quarter there, and how many quarters come before it.
_HAS = np.array([[(m >> q) & 1 for q in range(4)] for m in range(16)], bool).ravel()
_RANK = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int64).ravel()
_COUNT = np.array([bin(m).count("1") for m in range(16)], np.int64)


def term_counts(text: bytes, pattern, gap) -> Counter:
    """Terms of a text with their numbers, part by part, so that memory follows the distinct terms."""
    low, found, at = text.lower(), Counter(), 0   # bytes.lower changes A-Z only
    while at < len(low):
        end = at + PART
        if end < len(low):
            cut = gap.search(low, end)
            end = cut.start() if cut else len(low)
        found.update(pattern.findall(low, at, end))
        at = end
    return found


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times): number of all terms, and the known terms with their occurrences."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        pattern, gap = re.compile(TERM), re.compile(NOT_TERM)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, terms, times = [], [], []
                for text in column(batch, "text"):
                    counts = term_counts(text.as_py(), pattern, gap)
                    known = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
                    n.append(sum(counts.values()))
                    terms.append([t for t, _ in known])
                    times.append([c for _, c in known])
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                     pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "times"])

    return rows.mapInArrow(run, POSTINGS)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2^31, one place apart."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """Levels of a quadtree: masks, place of the first child, and maxima; each level ends in an empty node."""

    def __init__(self, height: int, masks: list[np.ndarray], values: list[np.ndarray]):
        self.height = height
        pad = np.zeros(1, np.int64)
        self.masks = [np.concatenate([m.astype(np.int64), pad]) for m in masks]
        self.first = [np.cumsum(_COUNT[m]) - _COUNT[m] for m in self.masks]
        self.values = [np.concatenate([v, pad]) for v in values]

    @staticmethod
    def build(rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, height: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Masks of levels 0 to height-1 and maxima of levels 0 to height, from the cells of a grid."""
        code = (_spread(rows) << np.uint64(1)) | _spread(cols)
        order = np.argsort(code)
        code, value = code[order].astype(np.int64), impacts[order]
        masks, values = [], [value]
        for _ in range(height):
            parent = code >> 2
            begin = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            masks.append(np.bitwise_or.reduceat(1 << (code & 3), begin).astype(np.uint8))
            value = np.maximum.reduceat(value, begin)
            code = parent[begin]
            values.append(value)
        return masks[::-1], values[::-1]

    @staticmethod
    def packed(masks: list[np.ndarray], values: list[np.ndarray]) -> tuple[bytes, list[int], bytes, int]:
        """Masks, nodes per level, and every node's distance below its parent's maximum."""
        below = [np.repeat(values[n], _COUNT[masks[n]]) - values[n + 1] for n in range(len(masks))]
        # byte planes of the distances: the high ones are almost all zeros
        planes = np.concatenate(below).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
        return zlib.compress(b"".join(m.tobytes() for m in masks), 1), [len(v) for v in values], zlib.compress(planes, 1), int(values[0][0])

    @classmethod
    def unpacked(cls, height: int, masks: bytes, sizes: list[int], below: bytes, top: int) -> Treap:
        every = np.frombuffer(zlib.decompress(masks), np.uint8)
        under = np.frombuffer(zlib.decompress(below), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
        levels, values, at, child = [], [np.array([top], np.int64)], 0, 0
        for n in range(height):
            levels.append(every[at:at + sizes[n]])
            at += sizes[n]
            values.append(np.repeat(values[n], _COUNT[levels[n]]) - under[child:child + sizes[n + 1]])
            child += sizes[n + 1]
        return cls(height, levels, values)


class Best:
    """The k best (score, id) found so far; smaller ids first among equal scores, a null id before all."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least, self.last = 1, None    # a score must be above 0

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(p) for p in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, ~null, -score))[:self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]
        if len(order) == self.k:
            self.least, self.last = int(self.score[-1]), (not self.null[-1], int(self.id[-1]))


def descend(tree: Treap, rows: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best) -> int:
    """Add the block's best documents for the rows of an item to ``best``; returns the states looked at.

    ``ids`` are the block's ids in ascending order, a column is a place in them.
    """
    height, n, seen, ticket = tree.height, len(ids), 0, 0
    width = max(4, CELLS_AT_ONCE // max(len(rows), 1))
    root = np.zeros((1, len(rows)), np.int64)
    queue = [(-int(tree.values[0][0]) * len(rows), 0, 0, root, np.zeros(1, np.int64), None)]
    while queue:
        bound, _, level, nodes, cols, bounds = heapq.heappop(queue)
        if -bound < best.least:
            break
        if bounds is not None:
            keep = bounds >= best.least
            if best.last is not None:
                # a range of equal bound whose ids all come later cannot enter any more
                low = cols << (height - level)
                later = np.where(null[low] | (not best.last[0]), ~null[low] & (not best.last[0]), ids[low] > best.last[1])
                keep &= (bounds > best.least) | ~later
            nodes, cols, bounds = nodes[keep], cols[keep], bounds[keep]
        if level == height:
            best.add(bounds, ids[cols], null[cols])
            continue
        seen += len(cols)
        half = ((rows >> (height - 1 - level)) & 1) << 1
        mask = tree.masks[level][nodes] << 2
        first = tree.first[level][nodes]
        nothing = len(tree.values[level + 1]) - 1
        parts = []
        for bit in (0, 1):
            place = mask + (half + bit)
            child = np.where(_HAS[place], first + _RANK[place], nothing)
            parts.append((child, 2 * cols + bit, tree.values[level + 1][child].sum(axis=1)))
        child, col, total = (np.concatenate(p) for p in zip(*parts, strict=True))
        alive = np.flatnonzero((total >= best.least) & (col << (height - 1 - level) < n))
        alive = alive[np.lexsort((col[alive], -total[alive]))]
        for at in range(0, len(alive), width):
            some = alive[at:at + width]
            ticket += 1
            heapq.heappush(queue, (-int(total[some[0]]), ticket, level + 1, child[some], col[some], total[some]))
    return seen


def index(found: DataFrame, row_of: np.ndarray, weights: list[int], n_docs: int, n_terms: int) -> DataFrame:
    """One quadtree per block of documents of ``found`` (POSTINGS); term t is row ``row_of[t]`` with its weight."""

    def tree(ids: list, n: list, terms: list, times: list) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda r: (ids[r] is not None, ids[r] or 0))
        sizes = np.array([len(terms[r]) for r in order])
        cols = np.repeat(np.arange(len(order)), sizes)
        rows = row_of[np.concatenate([terms[r] for r in order])]
        tf = np.concatenate([times[r] for r in order]).astype(np.int64)
        m = 100 - 90 + (90 * np.array([n[r] for r in order], np.int64) * n_docs) // n_terms
        impacts = np.array(weights, np.int64)[rows] * ((1_000_000_000 * tf) // (1_000 * tf + 8 * m[cols]))
        height = max(1, (len(order) - 1).bit_length(), (len(weights) - 1).bit_length())
        some = impacts > 0
        masks, level_sizes, below, top = b"", [], b"", 0
        if some.any():
            masks, level_sizes, below, top = Treap.packed(*Treap.build(rows[some], cols[some], impacts[some], height))
        return pa.RecordBatch.from_arrays([
            pa.array([height], pa.int32()), pa.array([[ids[r] for r in order]], pa.list_(pa.int64())), binary([masks]),
            pa.array([level_sizes], pa.list_(pa.int64())), binary([below]), pa.array([top], pa.int64()),
        ], names=[f.split()[0] for f in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, terms, times, cells = [], [], [], [], 0
        for batch in batches:
            for i, c, t, f in zip(column(batch, "doc_id").to_pylist(), column(batch, "n").to_pylist(),
                                  column(batch, "terms"), column(batch, "times"), strict=True):
                ids.append(i)
                n.append(c)
                terms.append(t.values.to_numpy())
                times.append(f.values.to_numpy())
                cells += len(terms[-1])
                if len(ids) == BLOCK_DOCS or cells >= BLOCK_CELLS:
                    yield tree(ids, n, terms, times)
                    ids, n, terms, times, cells = [], [], [], [], 0
        if ids:
            yield tree(ids, n, terms, times)

    return found.where(F.size("terms") > 0).mapInArrow(run, INDEX)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of ``items`` (item_id, text) its k best rows of ``docs`` (doc_id, text).

    Equal scores rank by ascending doc_id, a null one first.  Null and empty texts have no terms; an item
    without terms in the documents gives no row; every row of either table counts on its own, repeated or
    not; empty tables give no row; other columns are ignored.  Items are taken in blocks of bounded size,
    each against all documents.
    """
    import re

    n_items, n_bytes = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n_items // ITEMS_AT_ONCE), -(-n_bytes // ITEM_BYTES_AT_ONCE))
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part"))
    pattern, gap = re.compile(TERM), re.compile(NOT_TERM)
    answers = []
    for part in range(parts):
        # the stated query set, a bounded block of it
        here = [(r["item_id"], sorted(term_counts((r["text"] or "").encode(), pattern, gap)))
                for r in dealt.where(F.col("part") == part).collect()]
        answers.append(_answer(docs, here, k))
    answer = answers[0]
    for other in answers[1:]:
        answer = answer.unionByName(other)
    return answer.select(F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")


def _answer(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    found = settled(postings(docs, vocabulary), "postings")
    n_docs, n_terms = found.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row per term of the block's items
    df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    # rows by falling weight: terms alike in impact are neighbours, so a node's maximum says more
    by_weight = sorted(df, key=lambda t: (df[t], t))
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in by_weight]
    row_of = np.full(len(vocabulary), -1, np.int64)
    row_of[by_weight] = np.arange(len(by_weight))
    paths = [np.sort(row_of[[vocabulary[t] for t in terms]]) if terms else np.zeros(0, np.int64) for _, terms in items]
    paths = [path[path >= 0] for path in paths]
    grid = settled(index(found, row_of, weights, n_docs, max(n_terms, 1)), "treaps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in paths]
        for batch in batches:
            for r in range(batch.num_rows):
                height, ids, masks, sizes, below, top = (column(batch, f.split()[0])[r] for f in INDEX.split(", "))
                if not len(sizes.values):
                    continue
                tree = Treap.unpacked(height.as_py(), masks.as_py(), sizes.as_py(), below.as_py(), top.as_py())
                null = ids.values.is_null().to_numpy(zero_copy_only=False)
                numbers_here = ids.values.fill_null(0).to_numpy()
                for path, b in zip(paths, best, strict=True):
                    if len(path):
                        descend(tree, path, numbers_here, null, b)
        item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        if len(item):
            ids, null, score = (np.concatenate([getattr(b, f) for b in best]) for f in ("id", "null", "score"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=null), pa.array(score, pa.int64())],
                names=["item", "doc_id", "score"])

    hits = grid.mapInArrow(run, FOUND)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item int, item_id bigint")
    # at most ITEMS_AT_ONCE rows are expected in a block of items
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def statement() -> str:
    """The same ranking in SQL."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
            r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH asked AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
split AS (SELECT doc_id, {terms} AS terms FROM documents),
sizes AS (SELECT doc_id, len(terms)::BIGINT AS n, terms FROM split WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
held AS (SELECT doc_id, n, unnest(terms) AS term FROM sizes),
tf AS (SELECT doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf
  FROM held WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, docs),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS impact
  FROM tf JOIN weights USING (term), corpus),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
