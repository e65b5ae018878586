"""Naive Bayes on plain TF-IDF is fitted from sums of blocks, with the results of features as rows."""

import pytest

from pressmark.operators import terms
from pressmark.plans import recipe

SPEC = recipe.PipelineSpec(learner="nb", scaling=False, min_df=2, learner_parameters={"alpha": 0.3})


def articles(spark, extra=()):
    rows = [(i, "abc"[i % 3], " ".join(f"w{(i * j) % (7 + i % 3)}{i % 3}" for j in range(i % 11))) for i in range(80)]
    return spark.createDataFrame([*rows, *extra], "doc_id bigint, label string, raw_text string")


def shares(model, docs):
    return sorted((r.doc_id, r.predicted, [round(x, 9) for x in r.proba]) for r in model.predict_proba(docs).collect())


@pytest.mark.parametrize("extra", [(), ((3, "a", "w01 w12 w22"), (3, "b", "w01"))])
def test_sums_of_blocks_equal_rows_of_features(spark, monkeypatch, tmp_path, extra):
    docs, weighed, weigh = articles(spark, extra), [], terms.TfIdfModel.weigh
    monkeypatch.setattr(terms.TfIdfModel, "weigh", lambda *a: weighed.append(1) or weigh(*a))
    model = recipe.training_set(SPEC, docs, counted=True).fit({"alpha": 0.3})
    assert bool(weighed) == bool(extra)     # a repeated id goes by rows
    other = docs.where("doc_id > 20").select("doc_id", "raw_text")   # texts the model has not counted
    got, got_other = shares(model, docs), shares(model, other)
    recipe.save(model, str(tmp_path / "model"))
    again = shares(recipe.load(spark, str(tmp_path / "model")), docs)
    want = recipe.fit(SPEC, docs)
    assert shares(want, docs) == got == again and shares(want, other) == got_other
    assert want.bayes.priors == model.bayes.priors and want.bayes.n_features == model.bayes.n_features
