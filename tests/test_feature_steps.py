"""A fitted user step: learned on the training documents, applied to others, saved and loaded."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from pressmark.plans import recipe


@dataclass(frozen=True)
class AboveMean(recipe.FeatureStep):
    """Keep the features whose training mean lies above a share of the mean of all."""

    share: float = 1.0

    def fit(self, features, labelled):
        means = features.join(labelled, "doc_id").groupBy("feature").agg(F.sum("value").alias("m"))
        return means.join(means.agg(F.avg("m").alias("all")).hint("broadcast"), F.col("m") >= self.share * F.col("all")).select("feature")

    def apply(self, features, state):
        return features.join(state, "feature", "left_semi").select(*features.columns)


def test_steps_are_fitted_saved_and_loaded(spark, tmp_path):
    rows = [(d, "ab"[d % 2], ("red sun " if d % 2 else "blue moon ") * 2 + f"word{d % 7} common") for d in range(40)]
    articles = spark.createDataFrame(rows, "doc_id bigint, label string, raw_text string")
    spec = recipe.PipelineSpec(learner="nb", min_df=2, ngram_range=(1, 1), scaling=False,
                               feature_steps=(recipe.BestByChi2(6), AboveMean(0.5)))
    model = recipe.fit(spec, articles)
    assert model.features.states[0].count() == 6
    used = {r["feature"] for r in model.bayes.table.collect()}
    assert used == {r["feature"] for r in model.features.states[1].collect()}
    assert {"TFIDF__red", "TFIDF__sun", "TFIDF__blue", "TFIDF__moon"} <= used and len(used) < 6
    recipe.save(model, str(tmp_path / "m"))
    again = recipe.load(spark, str(tmp_path / "m"))
    assert again.spec.feature_steps == spec.feature_steps
    key = lambda m: sorted((r["doc_id"], r["predicted"], [round(x, 9) for x in r["proba"]]) for r in m.predict_proba(articles).collect())
    assert key(model) == key(again) and all(p == "ab"[d % 2] for d, p, _ in key(model))
