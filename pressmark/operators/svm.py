"""Support vector classification: one linear fit per class pair, voting, calibration."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.lookup import lookup
from ..plans.ranks import hash_key
from ..plans.staging import keep, settle

CALIBRATION_SHARE = 5   # every fifth row (by hash) is held out for calibration
NEWTON_STEPS = 12
TOLERANCE = 1e-3


def class_pairs(n: int) -> list[tuple[int, int]]:
    """Unordered class pairs (i, j), i < j, in coefficient order."""
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def label_pairs(dictionary: DataFrame) -> DataFrame:
    """(pair, first, second) from label_dict(label_idx, label): a join on the tiny label table."""
    a = dictionary.select(F.col("label_idx").alias("i"), F.col("label").alias("first"))
    b = dictionary.select(F.col("label_idx").alias("j"), F.col("label").alias("second"))
    pairs = a.join(F.broadcast(b), F.col("i") < F.col("j"))
    return pairs.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("i", "j")) - 1).alias("pair"), "first", "second")


def balanced_weights(rows: DataFrame, label: str = "label_idx") -> DataFrame:
    """Add ``weight`` = n / (classes * n_class)."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1))).collect()}  # one row per class
    total = sum(sizes.values())
    weight = F.lit(None).cast("double")
    for value, n in sizes.items():
        weight = F.when(F.col(label) == value, F.lit(total / (len(sizes) * n))).otherwise(weight)
    return rows.withColumn("weight", weight)


@dataclass
class PairwiseSvmModel:
    """Coefficients per class pair; a positive margin votes for the first class."""

    labels: list[str]
    coefficients: np.ndarray  # pairs x features
    intercepts: np.ndarray
    slopes: np.ndarray        # calibration per pair
    offsets: np.ndarray

    def margins(self, features: Column) -> Column:
        """Margins of vectors, sparse or dense; only the stored values are touched."""
        matrix, intercepts = self.coefficients, self.intercepts

        @F.pandas_udf("array<double>")
        def products(indices: pd.Series, values: pd.Series) -> pd.Series:
            return pd.Series([
                (matrix @ v if i is None else matrix[:, i] @ v) + intercepts for i, v in zip(indices, values)
            ], dtype=object)

        parts = F.unwrap_udt(features)
        return products(parts["indices"], parts["values"])

    def coefficient_table(self, spark) -> DataFrame:
        """(idx, w): the coefficients of every feature that has one, over all class pairs.

        They are on the driver already, where Spark ML returns a fitted model; from here on they are a table.
        """
        used = np.flatnonzero(self.coefficients.any(axis=0))
        flat = pa.array(self.coefficients[:, used].T.ravel())
        lists = pa.FixedSizeListArray.from_arrays(flat, len(self.intercepts)).cast(pa.list_(pa.float64()))
        return spark.createDataFrame(pa.table({"idx": pa.array(used.astype(np.int32)), "w": lists}))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``votes``, ``prediction`` (class index, lowest wins ties) and ``probability``."""
        return self.decide(rows.withColumn("_margins", self.margins(F.col("features"))))

    def score_long(self, features: DataFrame, table: DataFrame, n_features: int, docs: DataFrame) -> DataFrame:
        """As ``transform``, from (doc_id, feature, value) and table (feature, w); no vector is built."""
        k = len(self.intercepts)
        rows = lookup(features.select("doc_id", "feature", "value"), table, "feature", n_features, bytes_per_row=80 + 8 * k)
        sums = rows.groupBy("doc_id").agg(*[F.sum(F.col("value") * F.col("w")[p]).alias(f"m{p}") for p in range(k)])
        joined = docs.join(sums, "doc_id", "left")
        margins = F.array(*[F.coalesce(f"m{p}", F.lit(0.0)) + F.lit(float(b)) for p, b in enumerate(self.intercepts)])
        return self.decide(joined.select(*docs.columns, margins.alias("_margins")))

    def decide(self, scored: DataFrame) -> DataFrame:
        """Votes, prediction and probability from ``_margins``."""
        k = len(self.labels)
        pairs = class_pairs(k)
        m = F.col("_margins")
        votes, chance = [], []
        calibrated = [
            F.lit(1.0) / (1 + F.exp(F.least(F.greatest(
                -(m[p] * float(self.slopes[p]) + float(self.offsets[p])), F.lit(-500.0)), F.lit(500.0))))
            for p in range(len(pairs))
        ]
        for c in range(k):
            won = [F.when(m[p] > 0, 1).otherwise(0) if i == c else F.when(m[p] > 0, 0).otherwise(1)
                   for p, (i, j) in enumerate(pairs) if c in (i, j)]
            share = [calibrated[p] if i == c else 1 - calibrated[p] for p, (i, j) in enumerate(pairs) if c in (i, j)]
            votes.append(sum(won[1:], won[0]))
            chance.append(sum(share[1:], share[0]) * (2.0 / (k * (k - 1))))
        scored = scored.withColumn("votes", F.array(*votes))
        best = F.array_position("votes", F.array_max("votes")) - 1
        return scored.withColumn("prediction", best.cast("double")).withColumn(
            "probability", array_to_vector(F.array(*chance))
        ).drop("_margins")


@dataclass
class TextSvmModel(PairwiseSvmModel):
    """``coefficients`` is a table (feature, term, df, idf, scale, w array per pair); nothing of its size is on the driver."""

    n_terms: int = 0

    def score_bags(self, bags: DataFrame, docs: DataFrame) -> DataFrame:
        """Votes, prediction and probability from (doc_id, term, tf): idf, scale and weights are one lookup."""
        k = len(self.intercepts)
        fused = self.coefficients.select(
            "term", "df", "idf", F.transform("w", lambda x: x / F.col("scale")).alias("w"))
        rows = lookup(bags, fused, "term", self.n_terms, bytes_per_row=120 + 8 * k, frequency=F.col("df"))
        x = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
        sums = rows.select("doc_id", x.alias("x"), "w").groupBy("doc_id").agg(
            F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *[F.sum(F.col("x") * F.col("w")[p]).alias(f"m{p}") for p in range(k)])
        margins = F.array(*[
            F.coalesce(F.try_divide(f"m{p}", "norm"), F.lit(0.0)) + F.lit(float(b)) for p, b in enumerate(self.intercepts)])
        joined = docs.join(sums, "doc_id", "left")
        return self.decide(joined.select(*docs.columns, margins.alias("_margins")))

    def named_coefficients(self) -> DataFrame:
        return self.coefficients.select("feature", "w")


def _fit_pair(data: DataFrame, i: int, j: int, c: float, max_iter: int):
    rows = data.where(F.col("label_idx").isin(i, j)).withColumn("label", (F.col("label_idx") == i).cast("double"))
    total = rows.agg(F.sum("weight")).first()[0]
    svc = LinearSVC(
        featuresCol="features", labelCol="label", weightCol="weight", standardization=False,
        regParam=1.0 / (c * total), maxIter=max_iter, tol=TOLERANCE,
    )
    model = svc.fit(rows)
    return model.coefficients.toArray(), model.intercept


def _fit_all(data: DataFrame, k: int, c: float, max_iter: int, parallelism: int):
    pairs = class_pairs(k)
    with ThreadPoolExecutor(parallelism) as pool:
        fitted = list(pool.map(lambda p: _fit_pair(data, p[0], p[1], c, max_iter), pairs))
    return np.array([f[0] for f in fitted]), np.array([f[1] for f in fitted])


def _calibrate(model: PairwiseSvmModel, held_out: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Logistic fit of margin -> P(first class), all pairs per pass (Newton steps on grouped sums)."""
    return calibrate(held_out.select("label_idx", model.margins(F.col("features")).alias("margins")), len(model.labels))


def calibrate(held_out: DataFrame, n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Slope and offset per class pair from the (label_idx, margins) of held-out rows."""
    pairs = class_pairs(n_labels)
    long = held_out.select("label_idx", F.posexplode("margins").alias("pair", "m"))
    first = F.element_at(F.array(*[F.lit(i) for i, _ in pairs]), F.col("pair") + 1)
    second = F.element_at(F.array(*[F.lit(j) for _, j in pairs]), F.col("pair") + 1)
    points = settle(
        long.where((F.col("label_idx") == first) | (F.col("label_idx") == second))
        .select("pair", "m", (F.col("label_idx") == first).cast("double").alias("y"))
    )
    return newton(points, len(pairs))


def newton(points: DataFrame, n_pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Slope and offset per pair from held-out (pair, m, y)."""
    a, b = np.ones(n_pairs), np.zeros(n_pairs)
    for _ in range(NEWTON_STEPS):
        slope = F.element_at(F.array(*[F.lit(float(x)) for x in a]), F.col("pair") + 1)
        offset = F.element_at(F.array(*[F.lit(float(x)) for x in b]), F.col("pair") + 1)
        p = F.lit(1.0) / (1 + F.exp(-(slope * F.col("m") + offset)))
        v = p * (1 - p)
        sums = points.select("pair", "m", (F.col("y") - p).alias("e"), v.alias("v")).groupBy("pair").agg(
            F.sum(F.col("e") * F.col("m")).alias("ga"), F.sum("e").alias("gb"),
            F.sum(F.col("v") * F.col("m") * F.col("m")).alias("haa"), F.sum(F.col("v") * F.col("m")).alias("hab"),
            F.sum("v").alias("hbb"),
        ).collect()  # one row per class pair
        moved = 0.0
        for r in sums:
            ridge = 1e-3
            h = np.array([[r.haa + ridge, r.hab], [r.hab, r.hbb + ridge]])
            g = np.array([r.ga - ridge * a[r.pair], r.gb - ridge * b[r.pair]])
            step = np.clip(np.linalg.solve(h, g), -5, 5)
            a[r.pair] += step[0]
            b[r.pair] += step[1]
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-6:
            break
    return a, b


def fit_pairwise_svm(
    rows: DataFrame, labels: Sequence[str], c: float = 1.0, max_iter: int = 100,
    parallelism: int = 8, calibrate: bool = True, key: str = "doc_id",
) -> PairwiseSvmModel:
    """``rows`` holds (key, label_idx, features); class weights are balanced."""
    k = len(labels)
    data = keep(settle(balanced_weights(rows)))
    coefficients, intercepts = _fit_all(data, k, c, max_iter, parallelism)
    ones, zeros = np.ones(len(class_pairs(k))), np.zeros(len(class_pairs(k)))
    if calibrate:
        aside = F.pmod(hash_key(F.col(key), "|calibrate"), F.lit(CALIBRATION_SHARE)) == 0
        partial = PairwiseSvmModel(
            list(labels), *_fit_all(data.where(~aside), k, c, max_iter, parallelism), ones, zeros
        )
        slopes, offsets = _calibrate(partial, data.where(aside))
    else:
        slopes, offsets = ones, zeros
    return PairwiseSvmModel(list(labels), coefficients, intercepts, slopes, offsets)


def fourier_features(rows: DataFrame, dim: int, gamma: float = 1.0, size: int = 256, seed: int = 42,
                     column: str = "features") -> DataFrame:
    """Replace the vectors by random Fourier features of the RBF kernel exp(-gamma |x-y|^2)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=math.sqrt(2 * gamma), size=(dim, size))
    b = rng.uniform(0, 2 * math.pi, size=size)

    @F.pandas_udf("array<double>")
    def project(values: pd.Series) -> pd.Series:
        if len(values) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(math.sqrt(2.0 / size) * np.cos(np.stack(values.to_numpy()) @ w + b)))

    return rows.withColumn(column, array_to_vector(project(vector_to_array(F.col(column)))))


def pair_weights(spark, model: PairwiseSvmModel, names: Sequence[str] | DataFrame | None, top: int = 10) -> DataFrame:
    """(first, second, feature, weight, rank): per class pair the ``top`` largest positive and
    the ``top`` smallest negative coefficients, ranked from the strongest.

    ``names``: one name per feature, or a table (feature, idx).
    """
    if isinstance(model, TextSvmModel):
        named = model.named_coefficients()
    elif not isinstance(names, DataFrame):
        if len(names) != model.coefficients.shape[1]:
            raise ValueError(f"{len(names)} names for {model.coefficients.shape[1]} features")
        names = spark.createDataFrame(list(enumerate(names)), "idx int, feature string")
    if not isinstance(model, TextSvmModel):
        named = model.coefficient_table(spark).join(names, "idx")
    pairs = class_pairs(len(model.labels))
    name = lambda side: F.get(F.array(*[F.lit(model.labels[p[side]]) for p in pairs]), F.col("pair"))
    long = named.select("feature", F.posexplode("w").alias("pair", "weight"))
    rows = long.where(F.col("weight") != 0).select(name(0).alias("first"), name(1).alias("second"), "feature", "weight")
    # the ranked rows of a pair are cut to ``top`` before they are exchanged
    strongest = Window.partitionBy("first", "second", F.signum("weight")).orderBy(F.abs("weight").desc(), "feature")
    return rows.withColumn("rank", F.row_number().over(strongest)).where(F.col("rank") <= top)
