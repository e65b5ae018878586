"""Approximate nearest neighbours by inner product in a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then put into one of its leaves.  A query
visits leaves best first: a priority queue holds nodes by the inner product of the query with their
centre, and opening a node puts its children into the queue.  How many leaves are visited follows
from queries whose true neighbours are known: visits widen until their recall reaches the target.

Leaves that hold many vectors, or are visited by many queries, are split into blocks, so no task gets
more than a block of each.  Of equal vectors only the k + 1 with the smallest ids can be among
anyone's k nearest, and equal queries are answered once; both are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import column, settled

K = 20
#: Vectors the tree is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 20_000
BRANCHES = 8
LEAF = 256
MAX_LEAVES = 4_096
ROUNDS = 12
#: Queries with known neighbours, at most, and the recall they must reach.
CALIBRATION = 256
RECALL = 0.97
BLOCK_VECTORS = 4_000
BLOCK_QUERIES = 1_000

FOUND = "query bigint, ids binary, scores binary"


@dataclass
class Tree:
    """Inner nodes: their children's numbers and centres; a leaf has its number in ``leaf``."""

    children: list[list[int]]
    centres: list[np.ndarray]
    leaf: dict[int, int]

    @property
    def n_leaves(self) -> int:
        return len(self.leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row: down to the nearest centre."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[node]
            near = ((c * c).sum(axis=1) - 2 * (x[rows] @ c.T)).argmin(axis=1)
            todo.extend((child, rows[near == j]) for j, child in enumerate(self.children[node]) if (near == j).any())
        return out

    def visit(self, q: np.ndarray, limit: int) -> list[int]:
        """The first ``limit`` leaves for a query, best bin first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < limit:
            _, node = heapq.heappop(queue)
            if node in self.leaf:
                out.append(self.leaf[node])
                continue
            for child, near in zip(self.children[node], (self.centres[node] @ q).tolist(), strict=True):
                heapq.heappush(queue, (-near, child))
        return out


def _centres(x: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(ROUNDS):
        near = ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        held = counts > 0
        centres[held] = sums[held] / counts[held, None]
    return centres[held], (np.cumsum(held) - 1)[near]


def grow(sample: np.ndarray, total: int, leaf: int = LEAF, branches: int = BRANCHES) -> Tree:
    """A tree whose leaves hold about ``leaf`` of ``total`` vectors, as far as the sample can tell."""
    rng = np.random.default_rng(11)
    leaves = max(1, min(MAX_LEAVES, total // leaf))
    least = max(2, len(sample) // leaves)
    tree = Tree([[]], [np.zeros((0, sample.shape[1]))], {})
    todo = [(0, sample)]
    while todo:
        node, x = todo.pop()
        parts = None
        if len(x) > least and len(x) >= 2 * branches:
            centres, near = _centres(x, min(branches, max(2, len(x) // least)), rng)
            parts = [x[near == j] for j in range(len(centres))]
        if parts is None or sum(len(p) > 0 for p in parts) < 2:
            tree.leaf[node] = len(tree.leaf)
            continue
        tree.centres[node] = centres
        for part in parts:
            tree.children[node].append(len(tree.children))
            todo.append((len(tree.children), part))
            tree.children.append([])
            tree.centres.append(np.zeros((0, sample.shape[1])))
    return tree


def _matrix(array: pa.Array) -> np.ndarray:
    flat = np.asarray(array.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 1))


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query row the ids and scores of its ``k`` best rows of x, ties to the smaller id.

    The product picks candidates; their scores are summed again one by one, so that equal vectors have
    equal scores wherever they stand.
    """
    if not len(q):
        return
    rough = q @ x.T
    slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
    for row, scores in zip(q, rough, strict=True):
        near = np.arange(len(x))
        if len(x) > k:
            near = np.flatnonzero(scores >= np.partition(scores, len(x) - k)[len(x) - k] - slack)
        exact = (x[near] * row).sum(axis=1)
        order = np.lexsort((ids[near], -exact))[:k]
        yield ids[near][order], exact[order]


def usable(vector: Column) -> Column:
    """Vectors with a component other than zero, and none null, infinite or NaN."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """One row a query with its ``k`` best of all its rows; rows of a query arrive one after the other."""

    def run(batches):
        held: list = []
        query = None

        def done():
            ids = np.concatenate([np.frombuffer(i, "<i8") for i, _ in held])
            scores = np.concatenate([np.frombuffer(s, "<f8") for _, s in held])
            order = np.lexsort((ids, -scores))[:k]
            return pa.RecordBatch.from_arrays(
                [pa.array([query] * len(order), pa.int64()), pa.array(ids[order]), pa.array(scores[order])],
                names=["query", "vec_id", "score"])

        for batch in batches:
            for q, i, s in zip(*(column(batch, c).to_pylist() for c in ("query", "ids", "scores")), strict=True):
                if q != query and held:
                    yield done()
                    held = []
                query = q
                held.append((i, s))
                if len(held) > 64:
                    # keep what can still win
                    ids = np.concatenate([np.frombuffer(i, "<i8") for i, _ in held])
                    scores = np.concatenate([np.frombuffer(s, "<f8") for _, s in held])
                    order = np.lexsort((ids, -scores))[:k]
                    held = [(ids[order].tobytes(), scores[order].tobytes())]
        if held:
            yield done()

    spark = found.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return found.repartition(parts, "query").sortWithinPartitions("query").mapInArrow(
        run, "query bigint, vec_id bigint, score double")


def exact(points: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """(query, vec_id, score): the true ``k`` nearest of a bounded number of queries, by blocks of points."""

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            x, ids = _matrix(column(batch, "vector")), column(batch, "vec_id").to_numpy()
            for q, (i, s) in zip(query_ids.tolist(), _best(queries, x, ids, k), strict=True):
                if q in best:
                    i, s = np.concatenate([best[q][0], i]), np.concatenate([best[q][1], s])
                    order = np.lexsort((i, -s))[:k]
                    i, s = i[order], s[order]
                best[q] = (i, s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.int64()), pa.array([i.astype("<i8").tobytes() for i, _ in best.values()], pa.binary()),
             pa.array([s.astype("<f8").tobytes() for _, s in best.values()], pa.binary())], names=["query", "ids", "scores"])

    return _merged(points.select("vec_id", "vector").mapInArrow(run, FOUND), k)


def visits_for(tree: Tree, queries: np.ndarray, truth: list[np.ndarray], recall: float) -> int:
    """Leaves to visit so that on average ``recall`` of the true neighbours (given by their leaves) are met."""
    met = np.zeros(tree.n_leaves + 1)
    for q, leaves in zip(queries, truth, strict=True):
        place = {leaf: i for i, leaf in enumerate(tree.visit(q, tree.n_leaves))}
        for leaf in leaves.tolist():
            met[place[leaf] + 1] += 1 / len(leaves) / len(truth)
    reached = np.flatnonzero(np.cumsum(met) >= recall - 1e-12)
    return max(1, int(reached[0])) if len(reached) else tree.n_leaves


def search(vectors: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every query, nearest first, without itself.

    ``vectors`` and ``queries``: (vec_id, vector array<double>), rows not ``usable`` take no part, nor do rows
    with a null id or a length other than the commonest one (of several, the longest).  A query is never
    its own neighbour: rows with its id are left out.  Repeated rows with one id and one vector are one
    row.  Fewer candidates than ``k`` give fewer rows; empty tables give none.
    """
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select("vec_id", "vector")
    lengths = good.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    size = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    spark = vectors.sparkSession
    if size is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fits = F.size("vector") == size["size"]
    # of equal vectors the k + 1 smallest ids; a partial limit precedes the exchange
    order = Window.partitionBy("vector").orderBy("vec_id")
    points = good.where(fits).withColumn("copy", F.dense_rank().over(order)).where(F.col("copy") <= k + 1)
    points = settled(points.select("vec_id", "vector").distinct(), "points")
    asked = queries.where(F.col("vec_id").isNotNull() & usable(F.col("vector")) & fits).select("vec_id", "vector").distinct()
    classes = asked.groupBy("vector").agg(F.min("vec_id").alias("query"))
    asked = settled(asked.join(classes, "vector").select(F.col("vec_id").alias("query_id"), "query", "vector"), "asked")
    classes = asked.where(F.col("query_id") == F.col("query")).select("query", "vector")

    chosen = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    total = points.count()
    if not chosen:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    tree = grow(np.array([r["vector"] for r in chosen], np.float64), total, leaf)

    def to_leaves(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tree.assign(_matrix(column(batch, "vector"))))], names=[*batch.schema.names, "leaf"])

    placed = settled(points.mapInArrow(to_leaves, "vec_id bigint, vector array<double>, leaf int"), "leaves")

    some = classes.orderBy(F.xxhash64("query"), "query").limit(CALIBRATION).collect()
    if not some:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    probes = np.array([r["vector"] for r in some], np.float64)
    truth = exact(placed, probes, np.array([r["query"] for r in some]), k + 1).join(
        placed.select("vec_id", "leaf"), "vec_id").where("query <> vec_id").groupBy("query").agg(F.collect_list("leaf").alias("leaves"))
    known = {r["query"]: np.array(r["leaves"]) for r in truth.collect()}
    pairs = [(q, known[r["query"]]) for q, r in zip(probes, some, strict=True) if r["query"] in known]
    visits = visits_for(tree, np.array([q for q, _ in pairs]), [t for _, t in pairs], recall) if pairs else tree.n_leaves

    def to_visits(batches):
        for batch in batches:
            found = [tree.visit(q, visits) for q in _matrix(column(batch, "vector"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "leaves"])

    visiting = settled(classes.mapInArrow(to_visits, "query bigint, vector array<double>, leaves array<int>").select(
        "query", "vector", F.explode("leaves").alias("leaf")), "visits")
    # at most MAX_LEAVES rows each
    held = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("blocks"))
    asking = visiting.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("parts"))
    grid = F.broadcast(held.join(asking, "leaf"))
    side = lambda rows, own, other, key: rows.join(grid, "leaf").withColumn(
        own[1], F.pmod(F.xxhash64(key), own[0]).cast("int")).withColumn(
        other[1], F.explode(F.sequence(F.lit(0), F.col(other[0]) - 1)))
    left = side(placed, ("blocks", "block"), ("parts", "part"), "vec_id").select("leaf", "block", "part", "vec_id", "vector")
    right = side(visiting, ("parts", "part"), ("blocks", "block"), "query").select("leaf", "block", "part", "query", "vector")

    def compare(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "ids": [], "scores": []})
        ids = x["vec_id"].to_numpy()
        best = list(_best(np.stack(q["vector"]).astype(np.float64), np.stack(x["vector"]).astype(np.float64), ids, k + 1))
        return pd.DataFrame({
            "query": q["query"].to_numpy(), "ids": [i.astype("<i8").tobytes() for i, _ in best],
            "scores": [s.astype("<f8").tobytes() for _, s in best]})

    cell = ["leaf", "block", "part"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(compare, FOUND)
    best = _merged(found, k + 1).select(F.col("query"), "vec_id", "score")
    answers = asked.select("query_id", "query").join(best, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
