"""Searches that go on where they stopped, candidates fitted together, splits read from saved trees."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmark.operators import learners, terms, text_svm, vectors
from pressmark.plans import recipe, search

WORDS = {"a": "red green blue sun moon", "b": "iron steel blue coal moon", "c": "milk bread sun coal salt"}


@pytest.fixture(scope="module")
def articles(spark):
    rng = np.random.default_rng(4)
    rows = [(d, "abc"[d % 3], " ".join(rng.choice(WORDS["abc"[d % 3]].split() + ["the", "of", "red"], 6))) for d in range(90)]
    return spark.createDataFrame(rows, "doc_id bigint, label string, raw_text string")


def plain(table):
    return {r.candidate_id: (r.params, r.mean_score, r.std_score, r["rank"]) for r in table.collect()}


def test_a_stopped_search_goes_on(spark, articles, tmp_path, monkeypatch):
    spec = recipe.PipelineSpec(learner="nb", scaling=False, min_df=1, ngram_range=(1, 1))
    space = {"alpha": [0.1, 1.0, 50.0]}
    whole = plain(search.score_candidates(spec, space, articles, k=3))
    fits, fit = [], recipe.TrainingSet.fit

    def counted(self, parameters):
        if len(fits) == 4:
            raise RuntimeError("driver lost")
        fits.append(parameters["alpha"])
        return fit(self, parameters)

    monkeypatch.setattr(recipe.TrainingSet, "fit", counted)
    path = str(tmp_path / "ledger")
    with pytest.raises(RuntimeError):
        search.score_candidates(spec, space, articles, k=3, parallelism=1, ledger=path)
    first = len(fits)
    assert first == 4
    folder = f"{path}/{search.fingerprint(spec, 3, articles, None)}"
    entered = search.ScoreLedger(spark, folder).known()
    assert 3 <= len(entered) <= 4
    monkeypatch.setattr(recipe.TrainingSet, "fit", lambda self, parameters: fits.append(parameters["alpha"]) or fit(self, parameters))
    again = plain(search.score_candidates(spec, space, articles, k=3, parallelism=1, ledger=path))
    assert again == whole and len(fits) - first == 9 - len(entered)
    # nothing is left, so nothing is fitted; other articles are another search
    monkeypatch.setattr(recipe.TrainingSet, "fit", None)
    assert plain(search.score_candidates(spec, space, articles, k=3, ledger=path)) == whole
    other = articles.withColumn("raw_text", F.concat("raw_text", F.lit(" x")))
    assert search.fingerprint(spec, 3, other, None) != search.fingerprint(spec, 3, articles, None)


def test_features_of_a_fold_are_fitted_once(articles, monkeypatch):
    seen, make = [], recipe.training_set
    monkeypatch.setattr(recipe, "training_set", lambda *a, **k: seen.append(1) or make(*a, **k))
    spec = recipe.PipelineSpec(features="style", learner="rf", blocks=("Basic",))
    table = search.score_candidates(spec, {"n_estimators": [2, 3], "max_depth": [2]}, articles, k=2)
    assert len(seen) == 2 and table.count() == 2
    assert set(table.first().params) == {"max_depth", "n_estimators"}


def test_penalties_fitted_together_equal_each_alone(articles):
    docs = articles.select("doc_id", F.expr("ascii(label) - 97").alias("label_idx"), F.col("raw_text").alias("text"),
                           (F.col("doc_id") % 4).cast("int").alias("fold"))
    bags, slim = terms.bag_of_terms(docs, carry=["label_idx", "fold"]), docs.select("doc_id", "label_idx", "fold")
    close = {"rounds": 6, "gap": 1e-2, "gain": 1e-3}

    def margins(held, c):
        rows = text_svm.fit_text_svm(bags, slim, list("abc"), held, 2, False, c, **close).margins().collect()
        return {(r["set"], r["doc_id"]): np.array(r["margins"]) for r in rows}

    together = margins([0, 1, 0, 1], [0.1, 0.1, 5.0, 5.0])
    for start, c in ((0, 0.1), (2, 5.0)):
        alone = margins([0, 1], c)
        assert {(s + start, d) for s, d in alone} <= set(together)
        assert max(np.abs(together[s + start, d] - m).max() for (s, d), m in alone.items()) < 0.3
    assert any(np.abs(together[0, d] - together[2, d]).max() > 0.4 for s, d in together if s == 0)


def test_penalty_search_is_resumed_per_fold(spark, articles, tmp_path):
    spec = recipe.PipelineSpec(learner="svc", min_df=1, ngram_range=(1, 1))
    space = {search.PENALTY: [0.01, 1.0]}
    path = str(tmp_path / "ledger")
    folder = f"{path}/{search.fingerprint(spec, 3, articles, None)}"
    # a score entered before stays as it is
    search.ScoreLedger(spark, folder).add('{"penalty_parameter_c": 0.01}', 1, 0.0)
    table, best, model = search.search_recipes(spec, space, articles, k=3, ledger=path)
    scores = search.ScoreLedger(spark, folder).known()
    assert len(scores) == 6 and scores['{"penalty_parameter_c": 0.01}', 1] == 0.0
    assert best == {search.PENALTY: 1.0} and table.where("rank = 1").first().mean_score > 0.9
    assert model.predict(articles).count() == 90


def test_splits_equal_the_printed_trees(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, int(x[1] > 0) + int(x[3] > 0.5), x.tolist()) for i, x in enumerate(rng.normal(size=(200, 5)))]
    data = vectors.dense_vectors(spark.createDataFrame(rows, "doc_id bigint, label_idx int, a array<double>"), "a")
    for n, (tag, given) in enumerate((("xgb", {"n_estimators": 4}), ("rf", {"n_estimators": 5, "max_depth": 3}))):
        fitted = learners.fit_learner(tag, data.select("doc_id", "label_idx", "features"), ["x", "y", "z"], 5, **given)
        models = getattr(fitted.model, "models", None) or [fitted.model]
        want = Counter()
        for m in models:
            want.update(int(line.split("(feature ")[1].split(" ")[0]) for line in m.toDebugString.split("\n") if " If (feature " in f" {line.strip()}")
        counts = learners.split_counts(spark, fitted, list("abcde"), str(tmp_path / str(n))).collect()
        assert {r.feature: r.n_splits for r in counts} == {f: want[i] for i, f in enumerate("abcde")}
        assert max(counts, key=lambda r: r.gain).feature in "bd" and min(r.gain for r in counts) >= 0
    linear = learners.fit_learner("xgb", data.select("doc_id", "label_idx", "features"), ["x", "y", "z"], 5, booster="gblinear")
    with pytest.raises(ValueError):
        learners.split_counts(spark, linear, list("abcde"), str(tmp_path / "linear"))
