"""Rows scored where they are drawn: the same explanations as by a model of tables, and no shuffled sample."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from pressmark.operators import explain, learners

DIM = 5


def rows(spark, classes=3, n=40):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, DIM))
    data = [(i, int(i % classes), [float(v) for v in x[i] + (i % classes)]) for i in range(n)]
    data.append(data[3])   # a repeated row
    return spark.createDataFrame(data, "doc_id bigint, label_idx int, features_array array<double>").withColumn(
        "features", array_to_vector("features_array"))


def linear(data, classes=3):
    return learners.fit_learner("xgb", data.select("doc_id", "label_idx", "features"), [str(i) for i in range(classes)], DIM, booster="gblinear")


def values(frame, column):
    return {(r.doc_id, r.class_idx, r.feature_idx): r[column] for r in frame.collect()}


@pytest.mark.parametrize("classes", [2, 3])
def test_shares_equal_the_table_model(spark, classes):
    data = rows(spark, classes)
    fitted = linear(data, classes)
    x, proba = zip(*[(r.features_array, r.proba) for r in fitted.transform(data).collect()])
    assert np.abs(fitted.array_proba()(np.array(x)) - np.array(proba)).max() < 1e-12


def test_explanations_equal_the_table_path(spark):
    data = rows(spark)
    fitted = linear(data)
    arrays = explain.ArrayProba(fitted.array_proba())
    background, shares = np.array([[0.0] * DIM, [1.0] * DIM]), np.array([0.25, 0.75])
    bins = explain.TrainingBins.fit(data)
    for made, column in ((lambda f: explain.kernel_shap(data, background, shares, f, 40), "value"),
                         (lambda f: explain.explain_rows(data, bins, f, 700, top=3), "weight")):
        want, got = values(made(fitted.transform), column), values(made(arrays), column)
        assert want.keys() == got.keys() and max(abs(want[k] - got[k]) for k in want) < 1e-9


def test_only_rows_are_shuffled(spark):
    data = rows(spark)
    arrays = explain.ArrayProba(linear(data).array_proba())
    bins = explain.TrainingBins.fit(data)
    for found in (explain.kernel_shap(data, np.zeros((1, DIM)), np.ones(1), arrays, 40), explain.explain_rows(data, bins, arrays, 50)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        # one exchange, of the rows by key in a fixed number of parts
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1 and plan.count("MapInPandas") == 1


def test_other_learners_have_no_array_form(spark):
    assert learners.FittedLearner("rf", object(), ["a"]).array_proba() is None
