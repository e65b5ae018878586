from pressmark.plans import recipe


def test_plain_recipe_keeps_no_long_features(spark, tmp_path, monkeypatch):
    settled = []
    monkeypatch.setattr(recipe, "settle", lambda df, f=recipe.settle: settled.append(df.columns) or f(df))
    rows = [(i, "ab"[i % 2], " ".join(f"w{(i * j) % (4 + i % 2)}{i % 2}" for j in range(2, 9))) for i in range(40)]
    articles = spark.createDataFrame(rows, "doc_id bigint, label string, raw_text string")
    spec = recipe.PipelineSpec(learner="nb", scaling=False)
    model = recipe.fit(spec, articles)
    out = {r.doc_id: (r.predicted, [round(p, 9) for p in r.proba]) for r in model.predict_proba(articles).collect()}
    assert not any("feature" in c for c in settled)
    prepared = recipe.prepare(spec, articles)
    long = model.proba_of_features(model.features.transform(prepared), prepared.select("doc_id")).collect()
    assert {r.doc_id: (r.predicted, [round(p, 9) for p in r.proba]) for r in long} == out
    recipe.save(model, str(tmp_path / "m"))
    again = recipe.load(spark, str(tmp_path / "m")).predict_proba(articles).collect()
    assert {r.doc_id: (r.predicted, [round(p, 9) for p in r.proba]) for r in again} == out
