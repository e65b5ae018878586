"""Trees grown in tasks follow Spark ML's rules, and no node of a large forest reaches the driver."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pressmark.operators import forest, learners


def made(spark, n=400, dim=4, seed=3, values=12):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, size=(n, dim)).astype(float)
    y = ((x[:, 0] > 5).astype(int) + (x[:, 2] + rng.normal(size=n) > 8)).astype(int)
    return spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i].tolist())) for i in range(n)], ["doc_id", "label_idx", "features"])


@pytest.mark.parametrize("given,spark_given", [({}, {}), ({"criterion": "entropy", "min_samples_leaf": 4}, {"impurity": "entropy", "minInstancesPerNode": 4})])
def test_whole_trees_equal_those_of_spark(spark, monkeypatch, given, spark_given):
    rows = made(spark)
    plain = RandomForestClassifier(
        labelCol="label", numTrees=2, bootstrap=False, featureSubsetStrategy="all", maxDepth=30, seed=1, **spark_given).fit(learners._labelled(rows))
    monkeypatch.setattr(learners, "DRIVER_ROWS", 0)
    fitted = learners.fit_learner("rf", rows, ["a", "b", "c"], 4, n_estimators=2, bootstrap=False, max_features=None, **given)
    assert isinstance(fitted.model, forest.DeepForest)
    want = {r.doc_id: r.probability.toArray() for r in plain.transform(learners._labelled(rows)).collect()}
    got = {r.doc_id: np.array(r.proba) for r in fitted.transform(rows).collect()}
    assert got.keys() == want.keys()
    assert np.mean([np.abs(got[d] - want[d]).max() < 1e-9 for d in want]) > 0.97    # equal gains may be taken in another order
    assert np.abs(fitted.model.featureImportances.toArray() - plain.featureImportances.toArray()).max() < 0.02
    nodes = learners.saved_nodes(spark, fitted, "unused")
    assert abs(nodes.count() - plain.totalNumNodes) <= 0.05 * plain.totalNumNodes
    assert nodes.where("node = 0").agg(F.min("n_rows"), F.max("n_rows")).first()[:] == (400, 400)


def test_a_grown_tree_parts_every_row(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 32, size=(500, 6)).astype(np.uint8)
    y = rng.integers(0, 3, size=500)
    monkeypatch.setattr(forest, "CELLS", 500)     # nodes of a level in many parts
    weight = np.where(y == 0, 0.1, 1.7)
    for w in (None, weight):
        t = forest.grow(x, y, w, forest.Rules(3, 2, bootstrap=False), 7)
        shares = t["dist"][forest.leaves(x, t["feature"], t["cut"], t["left"])]
        inner = t["feature"] >= 0
        assert len(t["feature"]) == 2 * inner.sum() + 1 and (t["left"][inner] > 0).all()
        assert np.mean(shares[np.arange(500), y] == 1.0) > 0.9 and np.allclose(shares.sum(axis=1), 1)
        assert abs(t["importance"].sum() - 1) < 1e-12 and t["raw"][0] == 500
        assert np.array_equal(t["raw"][t["left"][inner]] + t["raw"][t["left"][inner] + 1], t["raw"][inner])


def test_large_forests_are_tables(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(learners, "DRIVER_ROWS", 0)
    monkeypatch.setattr(forest, "SCORE_BYTES", 4000)   # several groups of trees
    monkeypatch.setattr(forest, "BLOCK_ROWS", 50)
    rows = made(spark, values=200)
    fitted = learners.fit_learner("rf", rows, ["a", "b", "c"], 4, n_estimators=20, max_features=2, class_weight="balanced")
    assert isinstance(fitted.model, forest.DeepForest) and fitted.model.n_trees == 20
    out = {r.doc_id: r for r in fitted.transform(rows).collect()}
    assert len(out) == 400 and np.mean([r.predicted == "abc"[r.label_idx] for r in out.values()]) > 0.9
    assert all(abs(sum(r.proba) - 1) < 1e-9 and max(r.proba) == r.proba["abc".index(r.predicted)] for r in out.values())
    assert abs(fitted.model.featureImportances.toArray().sum() - 1) < 1e-9
    counts = learners.split_counts(spark, fitted, list("wxyz"), "unused")
    inner = fitted.model.nodes().where("feature_idx >= 0").count()
    assert counts.agg(F.sum("n_splits")).first()[0] == inner > 20
    fitted.save(str(tmp_path / "forest"), spark)
    again = learners.FittedLearner.load(str(tmp_path / "forest"), spark)
    assert {r.doc_id: r.proba for r in again.transform(rows).collect()} == {d: r.proba for d, r in out.items()}
    # one value per feature, null labels, null features
    flat = spark.createDataFrame([(i, i % 2, Vectors.dense([1.0, 2.0])) for i in range(20)], ["doc_id", "label_idx", "features"])
    one = learners.fit_learner("rf", flat, ["a", "b"], 2, n_estimators=3)
    assert {tuple(r.proba) for r in one.transform(flat).collect()} and one.model.nodes().count() == 3
    for broken in (flat.withColumn("label_idx", F.when(F.col("doc_id") > 3, F.col("label_idx"))),
                   flat.withColumn("features", F.when(F.col("doc_id") > 3, F.col("features")))):
        with pytest.raises(Exception):
            learners.fit_learner("rf", broken, ["a", "b"], 2, n_estimators=3)


def test_few_values_and_quantiles_part_the_bins(spark):
    rows = spark.createDataFrame([(Vectors.dense([float(i % 3), float(i)]),) for i in range(1000)], ["features"])
    few, many = forest.thresholds_of(rows, 2)
    assert few.tolist() == [0.5, 1.5] and len(many) == 31 and np.abs(np.diff(many) - 1000 / 32).max() < 3
    bins = forest.binned(np.array([[0.0, 0.0], [2.0, 999.0], [1.0, many[4]]]), [few, many])
    assert bins.tolist() == [[0, 0], [2, 31], [1, 4]]


def test_a_search_measures_a_text_once(spark, monkeypatch):
    """Style features of all folds come from one pass over the texts, with the scores of features taken per fold."""
    from pressmark.operators import style
    from pressmark.plans import recipe, search

    texts = [(i, "ab"[i % 2], ("Ja! Nee? 12. " if i % 2 else "Een lange zin zonder meer. ") * (1 + i % 5) + '"Goed", zei hij.' * (i % 3)) for i in range(60)]
    articles = spark.createDataFrame(texts, "doc_id bigint, label string, raw_text string")
    spec = recipe.PipelineSpec(features="style", learner="rf", blocks=("Basic", "Quote"))
    space, seen, basic = {"n_estimators": [2, 4], "max_depth": [3]}, [], style.basic_features
    monkeypatch.setattr(style, "basic_features", lambda *a, **k: seen.append(1) or basic(*a, **k))
    once = search.score_candidates(spec, space, articles, k=3).orderBy("candidate_id").collect()
    assert len(seen) == 1
    monkeypatch.setattr(recipe, "measured", lambda *a, **k: None)
    per_fold = search.score_candidates(spec, space, articles, k=3).orderBy("candidate_id").collect()
    assert [(r.candidate_id, r.mean_score, r.std_score) for r in once] == [(r.candidate_id, r.mean_score, r.std_score) for r in per_fold]
