"""Samples scored where they are drawn give the explanations of samples scored as rows."""

from pyspark.sql import functions as F

from pressmark.operators import bayes, explain, terms


def test_bags_explain_as_rows_do(spark):
    words = ["Boom", "vis", "zee", "a", "boom", "land", "BERG", "wind", "rots_2", "éé"]
    docs = spark.createDataFrame(
        [(i, i % 2, " ".join(words[(i * j + j * j) % (5 + 5 * (i % 2))] for j in range(12))) for i in range(60)],
        "doc_id bigint, label_idx int, text string")
    bags = terms.bag_of_terms(docs, carry=["label_idx"])
    model = bayes.fit_text_bayes(bags, docs.select("doc_id", "label_idx"), ["x", "y"], min_df=2).model()

    def by_rows(rows):
        return model.predict_proba(terms.bags_in_row(rows), rows, [c for c in rows.columns if c not in ("doc_id", "text")])

    items = spark.createDataFrame(
        [(1, "Boom vis, boom; a zee-land BERG?"), (2**62, "wind rots_2 éé éé"), (3, "onbekend"), (4, "vis"), (5, "vis"), (5, "vis"),
         (6, "ΟΔΟΣ.vis.land ΒΣ'boom"), (7, "a b c"), (8, "?!"), (9, None), (None, "vis zee")], "doc_id bigint, text string")
    want = explain.explain_text(items, by_rows, samples=60).collect()
    got = explain.explain_text(items, model.bag_proba(by_rows), samples=60).collect()
    key = lambda r: (r.doc_id or -1, r["class_idx"] or 0, r["feature"] or "")
    want, got = sorted(want, key=key), sorted(got, key=key)
    assert [key(r) for r in got] == [key(r) for r in want] and len({r.doc_id for r in got}) == 9
    for g, w in zip(got, want):
        assert (g["weight"] is None and w["weight"] is None) or abs(g["weight"] - w["weight"]) < 1e-9


def test_no_sample_is_shuffled(spark):
    """The exchanges after the samples are drawn hold surrogates only: one row per text and word."""
    table = spark.createDataFrame([("boom", 9, 1.5, [-1.0, -2.0])], "term string, df bigint, idf double, lp array<double>")
    model = explain.BagProba(lambda rows: rows.join(table, "term").drop("term", "df"), [-0.5, -0.9], None)
    items = spark.createDataFrame([(i, f"boom vis w{i}") for i in range(20)], "doc_id bigint, text string")
    out = explain.explain_text(items, model, samples=40)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    drawn = plan[:plan.index("Generate inline")]
    assert "Repartition" not in drawn[drawn.index("MapInPandas"):]
    assert out.where(F.col("rank") == 1).count() == 20
