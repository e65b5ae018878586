"""Deep forests over many rows: trees grown in tasks and kept as a table.

Spark ML keeps every node of a growing forest on the driver, so a forest of unlimited depth asks for driver memory
in proportion to rows times trees.  Here a row travels as its bins, one byte a feature; a task receives the bins of
all rows (bounded by ``MATRIX_BYTES``) and grows whole trees level by level from histograms, by the rules of Spark
ML: Poisson bootstrap, a random subset of the features per node, at most 32 bins a feature, the split of the largest
gain.  Draws of a tree depend on the seed, the tree's number and the order of the rows.

The driver holds the thresholds and one importance per feature.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.staging import stored

# The growing travels with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
#: Bytes of the bins of all rows: what a growing task holds, with a few times that in numbers.
MATRIX_BYTES = 256 * 1024 * 1024
BLOCK_ROWS = 8192
#: Numbers of the histograms held at a time.
CELLS = 1_000_000
#: Bytes of trees, and of rows, that a scoring task holds.
SCORE_BYTES = 32 * 1024 * 1024
LEAST_GAIN = 1e-12

TREES = ("tree int, n_nodes int, feature binary, cut binary, left binary, gain binary, raw binary, dist binary, importance binary")


def _array(batch: pa.RecordBatch | pa.Table, name: str, width: int) -> np.ndarray:
    """[row, entry] of an array column; every row must have all its entries."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        raise ValueError("a row has no features")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) != len(column) * width:
        raise ValueError(f"a row has not {width} features")
    return flat.reshape(-1, width)


def thresholds_of(rows: DataFrame, dim: int, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values that part its bins: between all its values if they are few, else its quantiles over all rows."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.zeros(0)] * dim
        for batch in batches:
            x = _array(batch, "x", dim)
            for f in range(dim):
                if seen[f] is not None:
                    found = np.union1d(seen[f], x[:, f])
                    seen[f] = found if len(found) <= bins else None
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(
            [None if s is None else s.tolist() for s in seen], pa.list_(pa.float64()))], names=["f", "seen"])

    arrays = rows.select(vector_to_array("features").alias("x"))
    small = {r["f"]: r["seen"] for r in arrays.mapInArrow(few, "f int, seen array<double>").groupBy("f").agg(
        F.when(F.max(F.col("seen").isNull().cast("int")) == 0, F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen")).collect()}
    exact = {f: np.sort(s) for f, s in small.items() if s is not None and len(s) <= bins}
    points = ",".join(f"{i / bins!r}D" for i in range(1, bins + 1))
    each = arrays.select(F.posexplode("x").alias("f", "value")).where(~F.col("f").isin(list(exact)) if exact else F.lit(True))
    grid = {} if len(exact) == dim else {
        r["f"]: np.array(r["q"]) for r in each.groupBy("f").agg(F.expr(f"percentile_approx(value, array({points}), 10000)").alias("q")).collect()}
    out = []
    for f in range(dim):
        if f in exact:
            out.append((exact[f][:-1] + exact[f][1:]) / 2)
        else:
            cuts = np.unique(grid[f])
            out.append(cuts[cuts < grid[f][-1]])
    return out


def binned(x: np.ndarray, thresholds: Sequence[np.ndarray]) -> np.ndarray:
    """[row, feature]: the thresholds below a value; ``value <= thresholds[k]`` where the bin is at most k."""
    return np.stack([np.searchsorted(t, x[:, f]) for f, t in enumerate(thresholds)], axis=1).astype(np.uint8)


def _blocks(rows: DataFrame, thresholds: Sequence[np.ndarray], carry: dict[str, str]) -> DataFrame:
    """(block, n, bins, *carry) of at most ``BLOCK_ROWS`` rows; ``carry`` names columns and their types in numpy."""
    dim = len(thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                if any(part.column(c).null_count for c in carry):
                    raise ValueError(f"null in {', '.join(carry)}")
                raw = [binned(_array(part, "x", dim), thresholds), *[part.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in carry.items()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([part.num_rows], pa.int32()), *[pa.array([r.tobytes()], pa.binary()) for r in raw]],
                    names=["block", "n", "bins", *carry])
                number += 1

    return stored(rows.select(vector_to_array("features").alias("x"), *carry).mapInArrow(
        run, ", ".join(["block bigint, n int, bins binary", *[f"{c} binary" for c in carry]])))


@dataclass(frozen=True)
class Rules:
    n_labels: int
    subset: int                # features a node may ask for
    impurity: str = "gini"
    max_depth: int = 30
    min_leaf: int = 1
    bootstrap: bool = True
    seed: int = 42


def _disorder(counts: np.ndarray, total: np.ndarray, impurity: str) -> np.ndarray:
    """Impurity times weight of class counts along the last axis."""
    safe = np.where(total > 0, total, 1.0)
    if impurity == "gini":
        return total - np.einsum("...c,...c->...", counts, counts) / safe
    share = counts / safe[..., None]
    return -total * (share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=-1)


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None, rules: Rules, tree: int) -> dict[str, np.ndarray]:
    """One tree: per node feature (-1: leaf), cut, left child (the right one follows it; of a leaf -1 - its row of ``dist``), gain, rows."""
    rng = np.random.default_rng([rules.seed & 0xFFFFFFFF, tree])
    n, dim = x.shape
    classes, s = rules.n_labels, min(rules.subset, dim)
    drawn = rng.poisson(1.0, n) if rules.bootstrap else np.ones(n, np.int64)
    rows = np.flatnonzero(drawn)
    raw = drawn[rows].astype(float)
    w = raw if weight is None else raw * weight[rows]
    label = y[rows].astype(np.int64)
    total, total_raw = np.bincount(label, w, classes)[None], np.array([raw.sum()])
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("feature", "cut", "left", "gain", "raw", "total")}
    first, place = 0, np.zeros(len(rows), np.int64)
    n_bins = int(x.max(initial=0)) + 1
    for depth in range(rules.max_depth + 1):
        a = len(total)
        feature, cut, left, gain = np.full(a, -1, np.int16), np.zeros(a, np.uint8), np.zeros(a, np.int32), np.zeros(a)
        impure = (total > 0).sum(axis=1) > 1
        opened = np.flatnonzero(impure & (total_raw >= 2 * rules.min_leaf)) if depth < rules.max_depth else np.zeros(0, np.int64)
        # rows of closed nodes are done; the others are sorted by their open node
        number = np.full(a, -1, np.int64)
        number[opened] = np.arange(len(opened))
        place = number[place]
        order = np.argsort(place, kind="stable")
        order = order[np.searchsorted(place[order], 0):]
        rows, label, w, raw, place = rows[order], label[order], w[order], raw[order], place[order]
        pick = np.argpartition(rng.random((len(opened), dim)), s - 1, axis=1)[:, :s] if s < dim else np.tile(np.arange(dim), (len(opened), 1))
        chunk = max(1, CELLS // (s * n_bins * classes))
        for start in range(0, len(opened) if n_bins > 1 else 0, chunk):
            nodes = opened[start:start + chunk]
            k, here = len(nodes), slice(*np.searchsorted(place, [start, start + chunk]))
            p = place[here] - start
            asked = pick[place[here]]
            b = x[rows[here, None], asked]
            slot = (p[:, None] * s + np.arange(s)) * n_bins + b
            hist = np.bincount((slot * classes + label[here, None]).ravel(), np.repeat(w[here], s), k * s * n_bins * classes)
            low = hist.reshape(k, s, n_bins, classes).cumsum(axis=2)[:, :, :-1]
            n_low, n_all = low.sum(axis=-1), total[nodes].sum(axis=1)[:, None, None]
            if weight is None:
                raw_low = n_low
            else:
                raw_low = np.bincount(slot.ravel(), np.repeat(raw[here], s), k * s * n_bins).reshape(k, s, n_bins).cumsum(axis=2)[:, :, :-1]
            high = total[nodes][:, None, None, :] - low
            parted = _disorder(low, n_low, rules.impurity) + _disorder(high, n_all - n_low, rules.impurity)
            won = (_disorder(total[nodes], n_all[:, 0, 0], rules.impurity)[:, None, None] - parted) / n_all
            won = np.where((raw_low >= rules.min_leaf) & (total_raw[nodes][:, None, None] - raw_low >= rules.min_leaf), won, 0.0).reshape(k, -1)
            best = won.argmax(axis=1)
            top = won[np.arange(k), best]
            good = top > LEAST_GAIN
            feature[nodes] = np.where(good, pick[start:start + k][np.arange(k), best // (n_bins - 1)], -1)
            cut[nodes], gain[nodes] = best % (n_bins - 1), np.where(good, top, 0.0)
        split = feature >= 0
        left[split] = first + a + 2 * np.arange(split.sum())
        for c, v in zip(out, (feature, cut, left, gain, total_raw, total)):
            out[c].append(v)
        if not split.any():
            break
        node = opened[place]
        kept = split[node]
        rows, label, w, raw, node = rows[kept], label[kept], w[kept], raw[kept], node[kept]
        place = left[node] - (first + a) + (x[rows, feature[node]] > cut[node])
        n_next = 2 * int(split.sum())
        total = np.bincount(place * classes + label, w, n_next * classes).reshape(n_next, classes)
        total_raw = np.bincount(place, raw, n_next)
        first += a
    return _pruned({c: np.concatenate(v) for c, v in out.items()}, np.cumsum([0, *[len(v) for v in out["raw"]]]), dim)


def _pruned(t: dict[str, np.ndarray], levels: np.ndarray, dim: int) -> dict[str, np.ndarray]:
    """Leaves of one parent that predict the same class become one, as in Spark ML; then the leaves' class shares and the importances."""
    total = t.pop("total")
    feature, left, predicted, classes = t["feature"], t["left"].astype(np.int64), total.argmax(axis=1), total.shape[1]
    for begin, end in zip(levels[-2::-1], levels[:0:-1]):
        inner = begin + np.flatnonzero(feature[begin:end] >= 0)
        low, high = left[inner], left[inner] + 1
        feature[inner[(feature[low] < 0) & (feature[high] < 0) & (predicted[low] == predicted[high])]] = -1
    reached = np.zeros(len(feature), bool)
    reached[0] = True
    for begin, end in zip(levels[:-1], levels[1:]):
        inner = begin + np.flatnonzero((feature[begin:end] >= 0) & reached[begin:end])
        reached[left[inner]] = reached[left[inner] + 1] = True
    number = np.cumsum(reached) - 1
    inner = np.flatnonzero(reached & (feature >= 0))
    importance = np.bincount(feature[inner], (t["gain"] * total.sum(axis=1))[inner], dim)
    left[inner] = number[left[inner]]
    leaf = np.flatnonzero(reached & (feature < 0))
    kinds = total[leaf]
    pure = (kinds > 0).sum(axis=1) == 1
    left[leaf] = -1 - np.where(pure, kinds.argmax(axis=1), classes + np.cumsum(~pure) - 1)
    t["gain"][leaf] = 0.0
    mixed = kinds[~pure]
    dist = np.concatenate([np.eye(classes), mixed / np.maximum(mixed.sum(axis=1, keepdims=True), 1e-300)])
    return {c: v[reached] for c, v in (t | {"left": left}).items()} | {"dist": dist, "importance": importance / (importance.sum() or 1.0)}


def leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The row of ``dist`` each row of bins falls to."""
    at, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(live):
        live = live[feature[at[live]] >= 0]
        here = at[live]
        at[live] = left[here] + (x[live, feature[here]] > cut[here])
    return -1 - left[at]


def _tree(row: dict, n_labels: int) -> tuple[np.ndarray, ...]:
    kinds = {"feature": "<i2", "cut": "u1", "left": "<i4", "dist": "<f8"}
    feature, cut, left, dist = (np.frombuffer(row[c], t) for c, t in kinds.items())
    return feature, cut, left, dist.reshape(-1, n_labels)


@dataclass
class DeepForest:
    """Trees as rows of ``TREES``, thresholds of the features' bins and importances (shares)."""

    trees: DataFrame
    thresholds: list[np.ndarray]
    n_labels: int
    n_trees: int
    n_bytes: int
    importance: np.ndarray

    @property
    def numFeatures(self) -> int:  # noqa: N802  as Spark ML names it
        return len(self.thresholds)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        return DenseVector(self.importance)

    def nodes(self) -> DataFrame:
        """(tree, node, feature_idx, gain, n_rows) of every node; a leaf has feature -1."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    n = row["n_nodes"]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, row["tree"], np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(np.frombuffer(row["feature"], "<i2").astype(np.int32)), pa.array(np.frombuffer(row["gain"], "<f8")),
                        pa.array(np.frombuffer(row["raw"], "<f8").astype(np.int64))], names=["tree", "node", "feature_idx", "gain", "n_rows"])

        return self.trees.select("tree", "n_nodes", "feature", "gain", "raw").mapInArrow(
            run, "tree int, node int, feature_idx int, gain double, n_rows bigint")

    def transform(self, rows: DataFrame) -> DataFrame:
        """(*rows, probability, prediction): the mean of the leaves' class shares; the first class among equals."""
        spark, labels, dim = rows.sparkSession, self.n_labels, len(self.thresholds)
        known = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
        blocks = _blocks(known, self.thresholds, {"_row": "<i8"})
        size = blocks.agg(F.sum("n").alias("n")).first()["n"] or 0
        groups = max(1, -(-self.n_bytes // SCORE_BYTES))
        chunks = max(1, -(-size * dim // SCORE_BYTES), -(-spark.sparkContext.defaultParallelism // groups))
        # every group of trees meets every chunk of rows in one task
        left = self.trees.select(
            F.pmod("tree", F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"),
            F.struct("tree", "feature", "cut", "left", "dist").alias("t"))
        right = blocks.select(
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("c"),
            "n", "bins", "_row")

        def score(key, trees: pa.Table, part: pa.Table) -> pa.Table:
            if not part.num_rows:
                return pa.table({"_row": pa.array([], pa.int64()), "s": pa.array([], pa.list_(pa.float64()))})
            x = np.concatenate([np.frombuffer(b, np.uint8) for b in part.column("bins").to_pylist()]).reshape(-1, dim)
            total = np.zeros((len(x), labels))
            for row in sorted(trees.column("t").to_pylist(), key=lambda r: r["tree"]):
                feature, cut, child, dist = _tree(row, labels)
                total += dist[leaves(x, feature, cut, child)]
            ids = np.concatenate([np.frombuffer(b, "<i8") for b in part.column("_row").to_pylist()])
            return pa.table({"_row": pa.array(ids), "s": pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), labels).cast(pa.list_(pa.float64()))})

        partial = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInArrow(score, "_row bigint, s array<double>")
        if groups == 1:
            summed = partial
        else:
            summed = partial.groupBy("_row").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(labels)]).alias("s"))
        share = F.transform("s", lambda v: v / F.lit(float(self.n_trees)))
        best = (F.array_position("s", F.array_max("s")) - 1).cast("double")
        return known.join(summed, "_row").select(*rows.columns, array_to_vector(share).alias("probability"), best.alias("prediction"))

    def save(self, path: str) -> None:
        root = path.rstrip("/")
        self.trees.write.parquet(f"{root}/trees")
        rows = [(f, t.tolist(), float(self.importance[f]), self.n_labels, self.n_trees, self.n_bytes) for f, t in enumerate(self.thresholds)]
        self.trees.sparkSession.createDataFrame(
            rows, "f int, thresholds array<double>, importance double, n_labels int, n_trees int, n_bytes bigint").write.parquet(f"{root}/features")

    @staticmethod
    def load(path: str, spark: SparkSession) -> "DeepForest":
        root = path.rstrip("/")
        rows = spark.read.parquet(f"{root}/features").orderBy("f").collect()  # one row per feature
        return DeepForest(
            spark.read.parquet(f"{root}/trees"), [np.array(r["thresholds"], float) for r in rows], rows[0]["n_labels"], rows[0]["n_trees"],
            rows[0]["n_bytes"], np.array([r["importance"] for r in rows]))


def fit_forest(rows: DataFrame, dim: int, n_trees: int, rules: Rules, weight: str | None = None) -> DeepForest:
    """Grow ``n_trees`` trees on (label_idx, features[, weight])."""
    spark = rows.sparkSession
    thresholds = thresholds_of(rows, dim)
    carry = {"label_idx": "<i4"} | ({weight: "<f8"} if weight else {})
    blocks = _blocks(rows, thresholds, carry)
    # a task grows several trees on rows it has received once
    tasks = min(n_trees, 4 * spark.sparkContext.defaultParallelism)
    groups = spark.range(0, tasks, 1, tasks).withColumnRenamed("id", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, group = [], None
        for batch in batches:
            for row in batch.to_pylist():
                group = row["g"]
                parts.append((row["block"], *[np.frombuffer(row[c], t) for c, t in {"bins": np.uint8, **carry}.items()]))
        if group is None:
            return
        parts.sort(key=lambda part: part[0])
        x = np.concatenate([part[1] for part in parts]).reshape(-1, dim)
        y = np.concatenate([part[2] for part in parts])
        w = np.concatenate([part[3] for part in parts]) if weight else None
        del parts
        for number in range(group, n_trees, tasks):
            t = grow(x, y, w, rules, number)
            raw = {c: t[c].astype(k).tobytes() for c, k in {
                "feature": "<i2", "cut": "u1", "left": "<i4", "gain": "<f8", "raw": "<f8", "dist": "<f8", "importance": "<f8"}.items()}
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([len(t["feature"])], pa.int32()), *[pa.array([v], pa.binary()) for v in raw.values()]],
                names=["tree", "n_nodes", *raw])

    trees = stored(groups.crossJoin(F.broadcast(blocks)).mapInArrow(run, TREES))
    each = trees.select("importance", (F.length("feature") + F.length("cut") + F.length("left") + F.length("dist")).alias("n")).collect()  # a number per tree and feature
    importance = np.sum([np.frombuffer(r["importance"], "<f8") for r in each], axis=0)
    return DeepForest(trees, thresholds, rules.n_labels, n_trees, sum(r["n"] for r in each), importance / (importance.sum() or 1.0))
