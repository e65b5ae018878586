"""Sentiment counts the words of the lexicon only, and moves no text."""

from pressmark.operators import style


def test_words_outside_the_lexicon_are_not_counted(spark):
    docs = spark.createDataFrame(
        [(1, "Good good bad day"), (2, "nothing here"), (3, None), (4, "bad"), (4, "good"), (None, "good")], "doc_id bigint, text string")
    lexicon = spark.createDataFrame([("good", 0.6, 0.5), ("BAD", -0.3, 0.2)], "word string, polarity double, subjectivity double")
    out = style.sentiment_features(docs, lexicon)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "REPARTITION" not in plan
    got = sorted((r.doc_id or 0, round(r.polarity, 9), round(r.subjectivity, 9)) for r in out.collect())
    assert got == [(0, 0.0, 0.0), (1, 0.3, 0.4), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 0.15, 0.35), (4, 0.15, 0.35)]
