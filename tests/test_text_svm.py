"""Many linear support vector models in one run against dense solutions of the same problems."""

import math
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmark.operators import svm, terms, text_svm
from pressmark.plans import recipe
from pressmark.session import shared_folder

WORDS = {"a": "red green blue sun moon", "b": "iron steel blue coal moon", "c": "milk bread sun coal salt"}


def corpus(spark, n=60):
    rng = np.random.default_rng(4)
    rows = []
    for d in range(n):
        label = "abc"[d % 3]
        own = WORDS[label].split()
        rows.append((d, label, " ".join(rng.choice(own + ["the", "of"], 9)), d % 4))
    return rows, spark.createDataFrame(rows, "doc_id bigint, label string, text string, fold int")


def dense_tfidf(rows, train, min_df):
    """Weights of all rows with the idf of the training rows, by hand."""
    def grams(text):
        t = text.split()
        return Counter(t + [f"{x} {y}" for x, y in zip(t, t[1:])])

    bags = [grams(r[2]) for r in rows]
    df = Counter(t for i in train for t in bags[i])
    names = sorted(t for t, n in df.items() if n >= min_df)
    idf = {t: math.log((1 + len(train)) / (1 + df[t])) + 1 for t in names}
    x = np.array([[(1 + math.log(b[t])) * idf[t] if b[t] else 0.0 for t in names] for b in bags])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), names


def dual_solution(x, y, cap, passes=400):
    x = np.hstack([x, np.full((len(x), 1), text_svm.BIAS)])
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    for _ in range(passes):
        for i in range(len(x)):
            new = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / (x[i] @ x[i]), 0.0), cap[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


@pytest.mark.parametrize("numbers,off", [(10**7, 0.25), (3000, 0.45)])
def test_every_fold_and_pair_comes_close_to_its_own_solution(spark, monkeypatch, numbers, off):
    monkeypatch.setattr(text_svm, "BLOCK_NUMBERS", numbers)
    rows, docs = corpus(spark)
    docs = docs.withColumn("label_idx", F.expr("ascii(label) - 97"))
    bags = terms.bag_of_terms(docs, carry=["label_idx", "fold"])
    held = [None, 1, 3]
    fitted = text_svm.fit_text_svm(bags, docs.select("doc_id", "label_idx", "fold"), list("abc"), held, 2, False, rounds=25, gap=1e-3, gain=1e-3)
    blocks = fitted.blocks.count()
    assert (blocks > 2) == (numbers < 10**7)
    found = defaultdict(dict)
    for r in fitted.margins().collect():
        found[r["set"]][r["doc_id"]] = np.array(r["margins"])
    for s, fold in enumerate(held):
        train = [i for i, r in enumerate(rows) if r[3] != fold]
        test = range(len(rows)) if fold is None else [i for i, r in enumerate(rows) if r[3] == fold]
        assert sorted(found[s]) == list(test)
        x, _ = dense_tfidf(rows, train, 2)
        sizes = Counter(rows[i][1] for i in train)
        for p, (i, j) in enumerate(svm.class_pairs(3)):
            mine = [r for r in train if rows[r][1] in ("abc"[i], "abc"[j])]
            y = np.array([1.0 if rows[r][1] == "abc"[i] else -1.0 for r in mine])
            cap = np.array([len(train) / (3 * sizes[rows[r][1]]) for r in mine])
            w = dual_solution(x[mine], y, cap)
            want = x @ w[:-1] + text_svm.BIAS * w[-1]
            got = np.array([found[s][d][p] for d in test])
            assert np.abs(got - want[list(test)]).max() < off
            assert np.corrcoef(got, want[list(test)])[0, 1] > 0.99


def test_the_recipe_predicts_saves_and_names_weights(spark, tmp_path):
    _, docs = corpus(spark, 90)
    articles = docs.select("doc_id", "label", F.col("text").alias("raw_text"))
    spec = recipe.PipelineSpec(learner="svc", quote_removal=False)
    model = recipe.fit(spec, articles)
    scored = model.predict_proba(articles.drop("label")).join(articles, "doc_id").collect()
    assert sum(r["predicted"] == r["label"] for r in scored) >= 85
    assert all(abs(sum(r["proba"]) - 1) < 1e-9 for r in scored)
    strongest = model.pair_weights(3)
    assert strongest.groupBy("first", "second").count().count() == 3
    top = {r["feature"] for r in strongest.where("first = 'a' and second = 'b' and weight > 0").collect()}
    assert top & {"TFIDF__red", "TFIDF__green", "TFIDF__sun"}
    recipe.save(model, str(tmp_path / "m"))
    again = recipe.load(spark, str(tmp_path / "m")).predict_proba(articles.drop("label"))
    assert sorted((r["doc_id"], r["predicted"]) for r in again.collect()) == sorted((r["doc_id"], r["predicted"]) for r in scored)
    folds = recipe.cross_validate(spec, articles, k=3)
    assert folds.count() == 90 and folds.where("truth = predicted").count() >= 75


def test_terms_counted_in_their_row(spark):
    rows, docs = corpus(spark)
    docs = docs.union(spark.createDataFrame([(100, "a", "", 0), (101, "a", None, 0)], docs.schema))
    key = lambda df: sorted((r["doc_id"], r["label"], r["term"], r["tf"]) for r in df.collect())
    assert key(terms.bags_in_row(docs, carry=["label"])) == key(terms.bag_of_terms(docs, carry=["label"]))
    assert "Exchange" not in terms.bags_in_row(docs)._jdf.queryExecution().toString().split("Physical Plan")[1]


def test_rounds_do_not_pile_up_on_disk(spark):
    _, docs = corpus(spark)
    docs = docs.withColumn("label_idx", F.expr("ascii(label) - 97"))
    bags = terms.bag_of_terms(docs, carry=["label_idx", "fold"])

    def left(rounds):
        count = lambda: [len(list(Path(folder).glob(kind))) for folder, kind in (
            (urlparse(spark.sparkContext.getCheckpointDir()).path, "rdd-*"), (shared_folder(spark), "round-*"))]
        before = count()
        fitted = text_svm.fit_text_svm(bags, docs.select("doc_id", "label_idx", "fold"), list("abc"), [None], 2, False, rounds=rounds, gap=-1, gain=-9)
        assert fitted.rounds == rounds and fitted.margins().count() == 60
        return [b - a for a, b in zip(before, count())]

    left(1)
    assert left(6)[1] == 1
    assert left(6)[0] <= left(2)[0] + 1
