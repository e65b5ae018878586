"""Registered queries around the Spark ML learners and the explanations.

They have no SQL counterpart: iterative fits and random perturbations.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import bayes, explain, kernel_map, labels, learners, svm, terms, vectors
from ..session import scratch_path
from . import queries as q, search
from .recipe import PipelineSpec
from .staging import settle, spread

DIM = 64
NAMES = [f"e{i:02d}" for i in range(DIM)]
TEXT_SAMPLES = explain.SAMPLES
# Coalitions of a Kernel SHAP explanation: a parameter of the query, as its background is.
SHAP_SAMPLES = 256
KERNEL_GAMMA = 0.5
#: Components the made labels depend on.
PLANTED = (3, 40)
STYLE_FOREST = PipelineSpec(features="style", learner="rf", blocks=("Basic", "Quote"))


def embeddings(spark, sf) -> tuple[DataFrame, list[str]]:
    """(doc_id, label_idx, features, features_array) and the class names."""
    rows = q.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("features_array"),
    )
    names = labels.label_list(rows)
    data = vectors.dense_vectors(q.encoded(rows, names), "features_array").drop("label")
    return settle(data), names


def _fit(spark, sf, tag, **parameters):
    data, names = embeddings(spark, sf)
    train = data.select("doc_id", "label_idx", "features")
    return data, learners.fit_learner(tag, train, names, DIM, **parameters)


def _predictions(spark, sf, tag, **parameters):
    data, fitted = _fit(spark, sf, tag, **parameters)
    out = fitted.transform(data.select("doc_id", "label_idx", "features"))
    truth = F.element_at(F.array(*[F.lit(n) for n in fitted.labels]), F.col("label_idx") + 1)
    return out.select("doc_id", truth.alias("truth"), "predicted", F.round(F.array_max("proba"), 6).alias("confidence"))


def svm_predict(spark, sf):
    return _predictions(spark, sf, "svc")


def svm_rbf_predict(spark, sf):
    return _predictions(spark, sf, "svc", kernel="rbf", gamma=0.5)


def kernel_error_checks(spark, sf):
    """Kernel features with landmarks: the error against the exact kernel, between all rows and 256 other sampled ones."""
    data, _ = embeddings(spark, sf)
    model = kernel_map.fit_kernel_map(data, KERNEL_GAMMA)
    probes = kernel_map.sampled(data, 256, "|probes")
    wanted = model.error <= kernel_map.TARGET or 2 * len(model.landmarks) >= min(data.count() - 1, 2 * kernel_map.SAMPLE)
    return model.error_over(data, probes).select(
        "n", F.lit(wanted).alias("reached_or_all_taken"),
        (F.col("error") <= 1.2 * max(model.error, kernel_map.TARGET)).alias("holds"))


def svm_kernel_predict(spark, sf):
    """Support vectors over kernel features of measured error."""
    data, names = embeddings(spark, sf)
    model = kernel_map.fit_kernel_map(data, KERNEL_GAMMA)
    rows = settle(model.transform(data.drop("features")).select("doc_id", "label_idx", "features"))
    scored = svm.fit_pairwise_svm(rows, names).transform(rows)
    name = F.array(*[F.lit(n) for n in names])
    return scored.select(
        "doc_id", F.element_at(name, F.col("label_idx") + 1).alias("truth"),
        F.element_at(name, F.col("prediction").cast("int") + 1).alias("predicted"),
        F.round(F.array_max(vector_to_array("probability")), 6).alias("confidence"))


def rf_predict(spark, sf):
    return _predictions(spark, sf, "rf")


def gb_predict(spark, sf):
    return _predictions(spark, sf, "gb")


def xgb_linear_predict(spark, sf):
    return _predictions(spark, sf, "xgb", booster="gblinear")


def lgbm_forest_predict(spark, sf):
    return _predictions(spark, sf, "lgbm", boosting_type="rf")


def mlp_predict(spark, sf):
    return _predictions(spark, sf, "mlp")


def svm_pair_weights(spark, sf):
    data, names = embeddings(spark, sf)
    model = svm.fit_pairwise_svm(data.select("doc_id", "label_idx", "features"), names, calibrate=False)
    return svm.pair_weights(spark, model, NAMES)


def class_pairs(spark, sf):
    rows = q.table(spark, sf, "embeddings")
    pairs = svm.label_pairs(labels.label_dictionary(rows))
    return pairs.select(F.col("pair").cast("bigint").alias("pair"), "first", "second")


def rf_importance(spark, sf):
    _, fitted = _fit(spark, sf, "rf")
    return learners.importances(spark, fitted, NAMES)


def _splits(spark, sf, tag, **parameters):
    _, fitted = _fit(spark, sf, tag, **parameters)
    return fitted, learners.split_counts(spark, fitted, NAMES, scratch_path(spark, "trees"))


def xgb_split_counts(spark, sf):
    """Splits and gain per feature of boosted trees, all classes together."""
    return _splits(spark, sf, "xgb")[1].select("feature", "n_splits", F.round("gain", 6).alias("gain"))


def lgbm_split_counts(spark, sf):
    """The same of the forest mode."""
    return _splits(spark, sf, "lgbm", boosting_type="rf")[1].select("feature", "n_splits", F.round("gain", 6).alias("gain"))


def split_count_checks(spark, sf):
    """Splits of all features against the node numbers of the model itself: a binary tree has one leaf more than inner nodes."""
    fitted, counts = _splits(spark, sf, "lgbm", boosting_type="rf")
    inner = sum((m.totalNumNodes - m.getNumTrees) // 2 for m in getattr(fitted.model, "models", None) or [fitted.model])
    used = [i for i, v in enumerate(fitted.model.featureImportances.toArray()) if v > 0]
    return counts.agg(
        F.count(F.lit(1)).alias("n_features"), (F.sum("n_splits") == inner).alias("all_nodes"),
        (F.sum(F.when(F.col("feature").isin(*[NAMES[i] for i in used]), F.col("n_splits")).otherwise(0)) == F.sum("n_splits")).alias("used_only"),
        (F.sum((F.col("n_splits") > 0).cast("int")) >= len(used)).alias("all_used"), (F.min("gain") >= 0).alias("no_loss"))


def svc_grid(spark, sf):
    """The default recipe's penalty, searched over five folds: all candidates, folds and class pairs in the same rounds."""
    table = search.score_candidates(PipelineSpec(learner="svc"), search.SVC_SPACE, _raw_articles(spark, sf))
    return _ranked(table, search.SVC_SPACE)


def rf_grid(spark, sf):
    """A forest on style features, searched over five folds; finished scores are kept in a ledger."""
    return _ranked(search.score_candidates(
        STYLE_FOREST, search.RF_SPACE, _raw_articles(spark, sf), ledger=scratch_path(spark, "ledger")), search.RF_SPACE)


def rf_grid_top(spark, sf):
    """The report of the same search: ranks 1 to 3, ties included."""
    return search.top_candidates(rf_grid(spark, sf))


def _ranked(table, space):
    return table.select(
        "candidate_id", *[F.col("params")[n].alias(n) for n in sorted(space)], F.round("mean_score", 6).alias("mean_score"),
        F.round("std_score", 6).alias("std_score"), F.col("rank").cast("bigint").alias("rank"))


def _raw_articles(spark, sf):
    return spread(q.documents(spark, sf).select("doc_id", F.col("lang").alias("label"), F.col("text").alias("raw_text")))


def text_svm_predict(spark, sf):
    """The default recipe: TF-IDF, inter-quartile scaling, linear support vectors."""
    from .recipe import PipelineSpec, fit

    docs = _raw_articles(spark, sf)
    return fit(PipelineSpec(learner="svc"), docs).predict(docs.drop("label"))


def text_svm_cv(spark, sf):
    """The default recipe cross-validated: ten folds and all class pairs in the same rounds."""
    from .recipe import PipelineSpec, cross_validate

    return cross_validate(PipelineSpec(learner="svc"), _raw_articles(spark, sf))


def text_svm_cv_accuracy(spark, sf):
    """Out-of-fold predictions of the default recipe against the truth: at least nine of ten are right, in every fold and label."""
    rows = text_svm_cv(spark, sf).withColumn("right", (F.col("predicted") == F.col("truth")).cast("int"))
    folds_right = rows.groupBy("fold").agg(F.avg("right").alias("a")).agg(F.count(F.lit(1)).alias("n_folds"), F.min("a").alias("worst_fold"))
    labels_right = rows.groupBy("truth").agg(F.avg("right").alias("a")).agg(F.min("a").alias("worst_label"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"), F.lit(0).alias("k")).join(
        folds_right.withColumn("k", F.lit(0)), "k").join(labels_right.withColumn("k", F.lit(0)), "k").select(
        "n_rows", "n_docs", "n_folds", (F.col("worst_fold") >= 0.9).alias("folds_right"), (F.col("worst_label") >= 0.9).alias("labels_right"))


def text_svm_checks(spark, sf):
    """What any fitted default recipe must fulfil, counted over its full output."""
    from .recipe import PipelineSpec, fit

    docs = _raw_articles(spark, sf)
    model = fit(PipelineSpec(learner="svc"), docs)
    proba = model.predict_proba(docs.drop("label")).join(docs.select("doc_id", "label"), "doc_id")
    total = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
    rows = proba.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"),
        F.sum((F.abs(total - 1) < 1e-9).cast("bigint")).alias("n_sums"),
        F.sum((F.array_min("proba") >= 0).cast("bigint")).alias("n_positive"),
        F.sum(F.col("predicted").isin(*model.labels).cast("bigint")).alias("n_labelled"),
        (F.avg((F.col("predicted") == F.col("label")).cast("int")) >= 0.95).alias("accurate"), F.lit(0).alias("k"))
    weights = model.pair_weights().groupBy("first", "second", F.signum("weight")).agg(F.count(F.lit(1)).alias("n"))
    strongest = weights.agg(
        F.sum((F.col("n") > 10).cast("bigint")).alias("n_over"), F.count_distinct("first", "second").alias("n_pairs"), F.lit(0).alias("k"))
    return rows.join(strongest, "k").drop("k")


def style_bayes_predict(spark, sf):
    """The style recipe with naive Bayes (min-max scaled)."""
    from .recipe import PipelineSpec, fit

    docs = _raw_articles(spark, sf)
    spec = PipelineSpec(features="style", learner="nb", sentiment_lexicon=q.sentiment_lexicon(spark))
    return fit(spec, docs, tokens=q.token_table(spark, sf)).predict(docs.drop("label"), tokens=q.token_table(spark, sf))


def combined_bayes_predict(spark, sf):
    """Style and TF-IDF features together with naive Bayes."""
    from .recipe import PipelineSpec, fit

    docs = _raw_articles(spark, sf)
    spec = PipelineSpec(features="style_tfidf", learner="nb", sentiment_lexicon=q.sentiment_lexicon(spark))
    return fit(spec, docs, tokens=q.token_table(spark, sf)).predict(docs.drop("label"), tokens=q.token_table(spark, sf))


def lime_text(spark, sf):
    """Every benchmark item explained by the naive Bayes model of the documents."""
    docs, bags, stats = q._bayes(spark, sf, None)
    model = stats.model()
    items = q.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), tx.clean_ocr(F.col("text")).alias("text"))

    def predict_proba(rows: DataFrame) -> DataFrame:
        carry = [c for c in rows.columns if c not in ("doc_id", "text")]
        return model.predict_proba(terms.bags_in_row(rows), rows, carry)

    out = explain.explain_text(items, model.bag_proba(predict_proba), TEXT_SAMPLES)
    return out.select("doc_id", _name(stats.labels).alias("class"), "feature", F.round("weight", 6).alias("weight"), "rank")


def _name(names):
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("class_idx") + 1)


def _row_explainer(spark, sf):
    data, names = embeddings(spark, sf)
    fitted = learners.fit_learner(
        "xgb", data.select("doc_id", "label_idx", "features"), names, DIM, booster="gblinear"
    )

    return data, names, fitted


def lime_tabular(spark, sf):
    data, names, fitted = _row_explainer(spark, sf)
    bins = explain.TrainingBins.fit(data)
    out = explain.explain_rows(data, bins, explain.ArrayProba(fitted.array_proba()), explain.tabular_samples(DIM))
    return out.select("doc_id", _name(names).alias("class"), "feature_idx", F.round("weight", 6).alias("weight"), "rank")


def shap_values(spark, sf, samples: int = SHAP_SAMPLES):
    """Kernel SHAP of every embedding from ``samples`` coalitions.

    The background is one centroid per class, weighted by the class size: all training rows as
    background would pair every row with every other.
    """
    data, names, fitted = _row_explainer(spark, sf)
    out = _shap(data, explain.ArrayProba(fitted.array_proba()), samples)
    return out.select("doc_id", _name(names).alias("class"), "feature_idx", F.round("value", 6).alias("value"))


def _shap(data, predict_proba, samples):
    centroids = data.groupBy("label_idx").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col("features_array")[i]).alias(NAMES[i]) for i in range(DIM)]
    ).orderBy("label_idx").collect()  # one row per class
    background = np.array([[r[n] for n in NAMES] for r in centroids])
    shares = np.array([r.n for r in centroids], dtype=float)
    return explain.kernel_shap(data, background, shares / shares.sum(), predict_proba, samples)


def importance_checks(spark, sf):
    """Importances of all features are shares that add up to one."""
    _, fitted = _fit(spark, sf, "rf")
    rows = learners.importances(spark, fitted, NAMES, top=DIM)
    return rows.agg(
        F.count(F.lit(1)).alias("n_features"), F.count_distinct("feature").alias("n_names"),
        (F.abs(F.sum("importance") - 1) < 0.05).alias("adds_up"), (F.min("importance") >= 0).alias("positive"))


def planted_importance_checks(spark, sf):
    """Labels made from the signs of two components: a forest must find these two, and hardly anything else."""
    data, _ = embeddings(spark, sf)
    sign = lambda i: (F.col("features_array")[i] > 0).cast("int")
    rows = data.select("doc_id", (2 * sign(PLANTED[0]) + sign(PLANTED[1])).alias("label_idx"), "features")
    fitted = learners.fit_learner("rf", rows, ["0", "1", "2", "3"], DIM)
    planted = F.col("feature").isin(*[NAMES[i] for i in PLANTED])
    return learners.importances(spark, fitted, NAMES, top=DIM).agg(
        F.count(F.lit(1)).alias("n_features"),
        (F.min(F.when(planted, F.col("importance"))) > 3 * F.max(F.when(~planted, F.col("importance")))).alias("found"))


def shap_linear_checks(spark, sf):
    """Of a linear score every value is known: weight times the distance from the mean."""
    data, _ = embeddings(spark, sf)
    weights = [(i % 7 - 3) / 10 for i in range(DIM)]
    w = F.array(*[F.lit(x) for x in weights])
    column = np.array(weights)

    def score(x: np.ndarray) -> np.ndarray:
        dot = x @ column
        return np.column_stack([dot, 1.0 - dot])

    means = data.agg(F.array(*[F.avg(F.col("features_array")[i]) for i in range(DIM)])).first()[0]  # one row
    found = _shap(data, explain.ArrayProba(score), SHAP_SAMPLES).join(data.select("doc_id", "features_array"), "doc_id")
    known = (F.get("features_array", F.col("feature_idx")) - F.get(F.array(*[F.lit(x) for x in means]), F.col("feature_idx"))) * F.get(
        w, F.col("feature_idx")) * F.when(F.col("class_idx") == 0, 1.0).otherwise(-1.0)
    return found.agg(F.count(F.lit(1)).alias("n_values"), F.sum((F.abs(F.col("value") - known) < 1e-6).cast("bigint")).alias("n_right"))


def shap_checks(spark, sf):
    """Per row and class the values add up to f(row) - f(background)."""
    data, _, fitted = _row_explainer(spark, sf)
    sums = _shap(data, explain.ArrayProba(fitted.array_proba()), SHAP_SAMPLES).groupBy("doc_id", "class_idx").agg(
        F.sum("value").alias("total"), F.first("base").alias("base"), F.count(F.lit(1)).alias("n"))
    scored = fitted.transform(data).select("doc_id", F.posexplode("proba").alias("class_idx", "p"))
    return sums.join(scored, ["doc_id", "class_idx"]).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.sum((F.abs(F.col("base") + F.col("total") - F.col("p")) < 1e-6).cast("bigint")).alias("n_exact"),
        F.sum((F.col("n") == DIM).cast("bigint")).alias("n_full"))


def lime_text_checks(spark, sf):
    """At most ten distinct words an item, ranked without gaps, each of them a word of the item."""
    items = q.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    per_item = lime_text(spark, sf).join(items, "doc_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"), F.count_distinct("feature").alias("features"),
        F.sum(F.contains("text", "feature").cast("int")).alias("held"))
    return per_item.agg(
        F.count(F.lit(1)).alias("n_items"), F.sum((F.col("n") <= 10).cast("bigint")).alias("n_short"),
        F.sum(((F.col("n") == F.col("last")) & (F.col("n") == F.col("features"))).cast("bigint")).alias("n_ranked"),
        F.sum((F.col("held") == F.col("n")).cast("bigint")).alias("n_held"))


MODELS = [
    text_svm_cv, text_svm_cv_accuracy, text_svm_checks, importance_checks, shap_checks, lime_text_checks,
    xgb_split_counts, lgbm_split_counts, split_count_checks, svc_grid, rf_grid, rf_grid_top,
    kernel_error_checks, svm_kernel_predict, planted_importance_checks, shap_linear_checks,
    svm_predict, svm_rbf_predict, rf_predict, gb_predict, xgb_linear_predict, lgbm_forest_predict, mlp_predict,
    svm_pair_weights, class_pairs, rf_importance, text_svm_predict, style_bayes_predict, combined_bayes_predict,
    lime_text, lime_tabular, shap_values,
]


def registered():
    return {f.__name__: f for f in MODELS}
