"""Learners by tag: parameters with defaults and the Spark ML estimator behind each."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import forest, svm

UNLIMITED_DEPTH = 30  # the deepest tree Spark ML grows
SEED = 42
#: Rows times trees of a forest of unlimited depth whose nodes Spark ML may hold on the driver; larger ones are kept as a table.
DRIVER_ROWS = 500_000


@dataclass
class NaiveBayes:
    alpha: float = 0.1


@dataclass
class SupportVector:
    kernel: str = "linear"
    penalty_parameter_c: float = 1.0
    gamma: float = 1.0
    max_iter: int = 100
    fourier_size: int = 256
    random_state: int = SEED


@dataclass
class RandomForest:
    n_estimators: int = 100
    max_features: int | str | None = 5
    criterion: str = "gini"
    max_depth: int = 0
    min_samples_leaf: int = 1
    bootstrap: bool = True
    class_weight: str | None = None
    random_state: int = SEED


@dataclass
class GradientBoosting:
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 3
    max_features: int | float | str | None = "auto"
    random_state: int = SEED


@dataclass
class ExtremeBoosting:
    n_estimators: int = 100
    learning_rate: float = 0.1
    booster: str = "gbtree"
    max_depth: int = 3
    gamma: float = 0.0
    min_child_weight: int = 1
    colsample_bytree: float = 1.0
    subsample: float = 1.0
    random_state: int = SEED


@dataclass
class LightBoosting:
    n_estimators: int = 100
    boosting_type: str = "gbdt"
    max_depth: int = -1
    num_leaves: int = 31
    learning_rate: float = 0.1
    random_state: int = SEED


@dataclass
class Perceptron:
    hidden_layer_sizes: str = "100"
    solver: str = "lbfgs"
    max_iter: int = 200
    batch_size: int = 200
    learning_rate_init: float = 0.001
    random_state: int = SEED

    def hidden(self) -> list[int]:
        return [int(n) for n in self.hidden_layer_sizes.split(",")]


def _subset(max_features, auto: str = "all") -> str:
    return {None: "all", "none": "all", "auto": auto}.get(max_features, str(max_features))


@dataclass
class FittedLearner:
    """A fitted model with one way to predict for all learners."""

    tag: str
    model: object
    labels: list[str]
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    probability: Column | None = None
    projection: dict | None = None  # arguments of the kernel projection, if there is one

    def save(self, path: str, spark) -> None:
        """Spark ML models with their own writer, pairwise models as one row per class pair."""
        root = path.rstrip("/")
        kind = type(self.model)
        if isinstance(self.model, svm.TextSvmModel):
            m = self.model
            m.coefficients.write.parquet(f"{root}/terms")
            rows = [(p, *map(float, x), m.n_terms) for p, x in enumerate(zip(m.intercepts, m.slopes, m.offsets, strict=True))]
            spark.createDataFrame(rows, "pair int, intercept double, slope double, offset double, n_terms int").write.parquet(f"{root}/pairs")
        elif isinstance(self.model, svm.PairwiseSvmModel):
            m = self.model
            rows = [
                (p, m.coefficients[p].tolist(), float(m.intercepts[p]), float(m.slopes[p]), float(m.offsets[p]))
                for p in range(len(m.intercepts))
            ]
            spark.createDataFrame(
                rows, "pair int, coefficients array<double>, intercept double, slope double, offset double"
            ).write.parquet(f"{root}/pairs")
        elif isinstance(self.model, forest.DeepForest):
            self.model.save(f"{root}/model")
        else:
            self.model.write().save(f"{root}/model")
        settings = {
            "tag": self.tag, "labels": self.labels, "projection": self.projection,
            "kind": [kind.__module__, kind.__name__], "boosted": self.probability is not None,
        }
        spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.text(f"{root}/settings")

    @staticmethod
    def load(path: str, spark) -> "FittedLearner":
        root = path.rstrip("/")
        s = json.loads(spark.read.text(f"{root}/settings").first().value)
        if s["kind"][1] in (svm.PairwiseSvmModel.__name__, svm.TextSvmModel.__name__):
            rows = spark.read.parquet(f"{root}/pairs").orderBy("pair").collect()  # one row per class pair
            column = lambda name: np.array([r[name] for r in rows])
            if s["kind"][1] == svm.TextSvmModel.__name__:
                model = svm.TextSvmModel(
                    s["labels"], spark.read.parquet(f"{root}/terms"), column("intercept"), column("slope"), column("offset"),
                    rows[0]["n_terms"] if rows else 0)
            else:
                model = svm.PairwiseSvmModel(
                    s["labels"], column("coefficients"), column("intercept"), column("slope"), column("offset"))
        elif s["kind"][1] == forest.DeepForest.__name__:
            model = forest.DeepForest.load(f"{root}/model", spark)
        else:
            model = getattr(importlib.import_module(s["kind"][0]), s["kind"][1]).load(f"{root}/model")
        return FittedLearner(
            s["tag"], model, s["labels"], _projection(s["projection"]),
            _one_vs_rest_probability() if s["boosted"] else None, s["projection"],
        )

    def transform(self, rows: DataFrame) -> DataFrame:
        """(*rows, predicted, proba ARRAY in label order)."""
        return self.named(self.model.transform(self.prepare(rows)), rows.columns)

    def array_proba(self) -> Callable[[np.ndarray], np.ndarray] | None:
        """The class shares of ``transform`` as a function of arrays (rows x features), for linear models; else None."""
        if not isinstance(self.model, LogisticRegressionModel):
            return None
        weights, start = self.model.coefficientMatrix.toArray().T, self.model.interceptVector.toArray()

        def shares(x: np.ndarray) -> np.ndarray:
            raw = x @ weights + start
            if raw.shape[1] == 1:
                raw = np.hstack([np.zeros_like(raw), raw])
            top = raw.max(axis=1, keepdims=True)
            odds = np.where(np.isinf(top), raw == top, np.exp(raw - np.where(np.isinf(top), 0.0, top)))
            return odds / odds.sum(axis=1, keepdims=True)

        return shares

    def named(self, scored: DataFrame, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
        """Predicted label and class shares of rows the model has scored."""
        names = F.array(*[F.lit(n) for n in self.labels])
        proba = vector_to_array("probability") if self.probability is None else self.probability
        return scored.select(
            *columns,
            F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"), proba.alias("proba"),
        )


def _projection(arguments: dict | None) -> Callable[[DataFrame], DataFrame]:
    if arguments is None:
        return lambda df: df
    return lambda df: svm.fourier_features(df, **arguments)


def _one_vs_rest_probability() -> Column:
    """Boosted margins to shares: each class gets its binary probability, then they are normalised."""
    raw = vector_to_array("rawPrediction")
    each = F.transform(raw, lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(each, lambda x: x / total)


def _boosted(rows, labels, n_estimators, rate, depth, subset, seed, subsample=1.0, min_gain=0.0, min_instances=1):
    tree = GBTClassifier(
        stepSize=rate, maxIter=n_estimators, maxDepth=depth, featureSubsetStrategy=subset, seed=seed,
        subsamplingRate=subsample, minInfoGain=min_gain, minInstancesPerNode=max(1, min_instances),
    )
    estimator = OneVsRest(classifier=tree, labelCol="label", parallelism=min(8, max(1, len(labels))))
    return estimator.fit(rows)


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", F.col("label_idx").cast("double"))


def _fit_svc(p: SupportVector, rows, labels, dim):
    if p.kernel == "linear":
        model = svm.fit_pairwise_svm(rows, labels, p.penalty_parameter_c, p.max_iter)
        return FittedLearner("svc", model, labels)
    if p.kernel != "rbf":
        raise ValueError(f"kernel {p.kernel!r} has no distributed form; use 'linear' or 'rbf'")
    arguments = {"dim": dim, "gamma": p.gamma, "size": p.fourier_size, "seed": p.random_state}
    project = _projection(arguments)
    model = svm.fit_pairwise_svm(project(rows), labels, p.penalty_parameter_c, p.max_iter)
    return FittedLearner("svc", model, labels, project, projection=arguments)


def _fit_rf(p: RandomForest, rows, labels, dim):
    subset = _subset(min(p.max_features, dim) if isinstance(p.max_features, int) else p.max_features)
    data = svm.balanced_weights(rows) if p.class_weight == "balanced" else rows
    if _too_deep(p, rows, dim):
        rules = forest.Rules(
            len(labels), min(p.max_features, dim) if isinstance(p.max_features, int) else dim, p.criterion, UNLIMITED_DEPTH,
            p.min_samples_leaf, p.bootstrap, p.random_state)
        return FittedLearner("rf", forest.fit_forest(data, dim, p.n_estimators, rules, "weight" if data is not rows else None), labels)
    estimator = RandomForestClassifier(
        labelCol="label", numTrees=p.n_estimators, featureSubsetStrategy=subset, impurity=p.criterion,
        maxDepth=p.max_depth or UNLIMITED_DEPTH, minInstancesPerNode=p.min_samples_leaf, bootstrap=p.bootstrap,
        seed=p.random_state,
        # each row keeps its node in every tree: else a pass would send the trees grown so far and walk them from the root
        cacheNodeIds=True,
    )
    if data is not rows:
        estimator = estimator.setWeightCol("weight")
    return FittedLearner("rf", estimator.fit(_labelled(data)), labels)


def _too_deep(p: RandomForest, rows: DataFrame, dim: int) -> bool:
    """Would Spark ML hold more nodes on the driver than it should, and do the rows' bins fit the tasks that grow trees?"""
    if p.max_depth or not (isinstance(p.max_features, int) or p.max_features in (None, "none", "auto")):
        return False
    n = rows.count()
    return n * p.n_estimators > DRIVER_ROWS and n * dim <= forest.MATRIX_BYTES


def _fit_gb(p: GradientBoosting, rows, labels, dim):
    model = _boosted(_labelled(rows), labels, p.n_estimators, p.learning_rate, p.max_depth, _subset(p.max_features, "sqrt"), p.random_state)
    return FittedLearner("gb", model, labels, probability=_one_vs_rest_probability())


def _fit_xgb(p: ExtremeBoosting, rows, labels, dim):
    if p.booster == "gblinear":
        linear = LogisticRegression(labelCol="label", regParam=1e-4, elasticNetParam=0.5, maxIter=p.n_estimators)
        return FittedLearner("xgb", linear.fit(_labelled(rows)), labels)
    if p.booster != "gbtree":
        raise ValueError(f"booster {p.booster!r} is not offered; use 'gbtree' or 'gblinear'")
    model = _boosted(
        _labelled(rows), labels, p.n_estimators, p.learning_rate, p.max_depth or UNLIMITED_DEPTH,
        _subset(None if p.colsample_bytree >= 1 else p.colsample_bytree), p.random_state,
        p.subsample, p.gamma, p.min_child_weight,
    )
    return FittedLearner("xgb", model, labels, probability=_one_vs_rest_probability())


def _fit_lgbm(p: LightBoosting, rows, labels, dim):
    depth = p.max_depth if p.max_depth > 0 else max(1, (p.num_leaves - 1).bit_length())
    if p.boosting_type == "rf":
        return _fit_rf(RandomForest(p.n_estimators, None, max_depth=depth, random_state=p.random_state), rows, labels, dim)
    if p.boosting_type != "gbdt":
        raise ValueError(f"boosting type {p.boosting_type!r} is not offered; use 'gbdt' or 'rf'")
    model = _boosted(_labelled(rows), labels, p.n_estimators, p.learning_rate, depth, "all", p.random_state)
    return FittedLearner("lgbm", model, labels, probability=_one_vs_rest_probability())


def _fit_mlp(p: Perceptron, rows, labels, dim):
    net = MultilayerPerceptronClassifier(
        labelCol="label", layers=[dim, *p.hidden(), len(labels)], maxIter=p.max_iter, blockSize=p.batch_size,
        seed=p.random_state, solver="l-bfgs" if p.solver == "lbfgs" else "gd", stepSize=p.learning_rate_init,
    )
    return FittedLearner("mlp", net.fit(_labelled(rows)), labels)


# tag -> (parameters, fit); a plug-in adds an entry with register().
LEARNERS: dict[str, tuple[type, Callable]] = {
    "svc": (SupportVector, _fit_svc), "rf": (RandomForest, _fit_rf), "gb": (GradientBoosting, _fit_gb),
    "xgb": (ExtremeBoosting, _fit_xgb), "lgbm": (LightBoosting, _fit_lgbm), "mlp": (Perceptron, _fit_mlp),
    "nb": (NaiveBayes, None),  # works on long features, see bayes.py
}


def register(tag: str, parameters: type, fit: Callable) -> None:
    """Add a learner: ``fit(parameters, rows, labels, dim) -> FittedLearner``."""
    LEARNERS[tag] = (parameters, fit)


def parameters(tag: str, **given):
    """Parameter object of a learner; unknown names are refused."""
    if tag not in LEARNERS:
        raise ValueError(f"unknown learner {tag!r}, use one of {sorted(LEARNERS)}")
    kind = LEARNERS[tag][0]
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown parameter(s) {sorted(unknown)} for {tag!r}")
    return kind(**given)


def fit_learner(tag: str, rows: DataFrame, labels: Sequence[str], dim: int, **given) -> FittedLearner:
    """Fit on (doc_id, label_idx, features)."""
    kind = parameters(tag, **given)
    fit = LEARNERS[tag][1]
    if fit is None:
        raise ValueError(f"learner {tag!r} is fitted on long features")
    return fit(kind, rows, list(labels), dim)


def importances(spark, fitted: FittedLearner, names: Sequence[str] | DataFrame, top: int = 30) -> DataFrame:
    """(feature, importance): relative importance rounded to 3, the ``top`` largest.

    ``names``: one name per feature, or a table (feature, idx).  Features that no tree uses are left out
    unless fewer than ``top`` are used; a fitted forest holds its importances on the driver, where only the used ones
    are read.
    """
    models = getattr(fitted.model, "models", None) or [fitted.model]
    used: dict[int, float] = {}
    for m in models:
        vector = m.featureImportances
        pairs = zip(vector.indices.tolist(), vector.values.tolist()) if hasattr(vector, "indices") else enumerate(vector.toArray().tolist())
        for i, v in pairs:
            used[i] = used.get(i, 0.0) + v
    if not isinstance(names, DataFrame):
        if len(names) != models[0].numFeatures:
            raise ValueError(f"{len(names)} names for {models[0].numFeatures} features")
        names = spark.createDataFrame(list(enumerate(names)), "idx int, feature string")
    found = spark.createDataFrame(list(used.items()), "idx int, importance double")
    rows = names.join(found, "idx", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    return relative_importance(rows, sum(used.values()), top)


def split_counts(spark, fitted: FittedLearner, names: Sequence[str] | DataFrame, path: str) -> DataFrame:
    """(feature, n_splits, gain) of every feature: how many inner nodes of all trees ask for it, and their summed gain.

    The trees are saved below ``path`` (a new folder every executor can reach) and their nodes read back as
    a table, so no tree is walked on the driver.  ``names`` as of ``importances``; a feature no node asks
    for has 0 and 0.0.
    """
    nodes = saved_nodes(spark, fitted, path).where(F.col("feature_idx") >= 0)
    if not isinstance(names, DataFrame):
        names = spark.createDataFrame(list(enumerate(names)), "idx int, feature string")
    counted = nodes.groupBy(F.col("feature_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n_splits"), F.sum("gain").alias("gain"))
    return names.join(counted, "idx", "left").select(
        "feature", F.coalesce("n_splits", F.lit(0)).cast("bigint").alias("n_splits"), F.coalesce("gain", F.lit(0.0)).alias("gain"))


def saved_nodes(spark, fitted: FittedLearner, path: str) -> DataFrame:
    """(model, tree, node, feature_idx, gain, n_rows) of every node of a fitted tree learner; a leaf has feature -1.

    ``model`` is the class of a one-vs-rest model, else 0.
    """
    if isinstance(fitted.model, forest.DeepForest):
        return fitted.model.nodes().select(F.lit(0).alias("model"), "tree", "node", "feature_idx", "gain", "n_rows")
    models = getattr(fitted.model, "models", None) or [fitted.model]
    if not all(hasattr(m, "trees") for m in models):
        raise ValueError("only tree learners have splits")
    root = path.rstrip("/")
    with ThreadPoolExecutor(min(8, len(models))) as pool:
        list(pool.map(lambda i: models[i].write().save(f"{root}/model={i}"), range(len(models))))
    # the writer's layout: one folder of node rows per model
    node = F.col("nodeData")
    parts = spark.read.option("basePath", root).parquet(*[f"{root}/model={i}/data" for i in range(len(models))])
    inner = node["leftChild"] >= 0
    return parts.select(
        F.col("model").cast("int").alias("model"), F.col("treeID").alias("tree"), node["id"].alias("node"),
        F.when(inner, node["split"]["featureIndex"]).otherwise(-1).alias("feature_idx"),
        F.when(inner, node["gain"]).otherwise(0.0).alias("gain"), node["rawCount"].alias("n_rows"))


def relative_importance(rows: DataFrame, total: float, top: int = 30) -> DataFrame:
    """(feature, importance): shares of ``total``, the ``top`` largest."""
    share = rows.select("feature", F.round(F.col("importance") / (total or 1.0), 3).alias("importance"))
    return share.orderBy(F.col("importance").desc(), "feature").limit(top)
