import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pressmark.operators import annotation, bayes, comparison, explain, labels, learners, metrics, scaling, style, svm, terms, vectors
from pressmark.plans import lookup as lk, model_queries, recipe, search
from pressmark.plans.staging import keep

WORDS = "aap noot mies wim zus jet teun vuur gijs lam kees bok".split()


def corpus(n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = "AB"[i % 2] if i % 7 else "C"
        shift = {"A": 0, "B": 3, "C": 6}[label]
        picked = [WORDS[(shift + int(x)) % len(WORDS)] for x in rng.integers(0, 6, rng.integers(3, 12))]
        rows.append((i, label, " ".join(picked)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, label string, text string")


def grams(text):
    t = text.lower().split()
    return Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])


class Brute:
    """TF-IDF, optional inter-quartile scaling and naive Bayes with plain loops."""

    def __init__(self, train, min_df=5, alpha=0.1, scaled=False):
        n = len(train)
        bags = {d: grams(t) for d, _, t in train}
        df = Counter(t for b in bags.values() for t in b)
        self.idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items() if c >= min_df}
        w = {d: self.weigh(b) for d, b in bags.items()}
        self.scale = {}
        for t in self.idf if scaled else ():
            q = np.quantile([w[d].get(t, 0.0) for d in w], [0.25, 0.75])
            if q[1] > q[0]:
                self.scale[t] = q[1] - q[0]
        self.labels = sorted({x for _, x, _ in train})
        sums = {c: defaultdict(float) for c in self.labels}
        for d, label, _ in train:
            for t, x in w[d].items():
                sums[label][t] += x / self.scale.get(t, 1.0)
        self.prior = {c: math.log(sum(x == c for _, x, _ in train) / n) for c in self.labels}
        self.lp = {}
        for c in self.labels:
            z = math.log(sum(sums[c].values()) + alpha * len(self.idf))
            self.lp[c] = {t: math.log(sums[c][t] + alpha) - z for t in self.idf}

    def weigh(self, bag):
        raw = {t: (1 + math.log(c)) * self.idf[t] for t, c in bag.items() if t in self.idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    def scores(self, text):
        w = self.weigh(grams(text))
        return [self.prior[c] + sum(x / self.scale.get(t, 1.0) * self.lp[c][t] for t, x in w.items()) for c in self.labels]


@pytest.mark.parametrize("scaled", [False, True])
@pytest.mark.parametrize("limit", [lk.BROADCAST_BYTES, 0])
def test_text_bayes_per_fold_equals_brute_force(spark, monkeypatch, scaled, limit):
    monkeypatch.setattr(lk, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(lk, "HOT_KEYS", 3)
    rows = corpus() + [(900, "A", "onbekend"), (901, "B", "")]
    k = 3
    docs = frame(spark, rows).withColumn("fold", (F.col("doc_id") % k).cast("int")).withColumn(
        "label_idx", F.when(F.col("label") == "A", 0).when(F.col("label") == "B", 1).otherwise(2))
    bags = keep(terms.bag_of_terms(docs, carry=["label_idx", "fold"]))
    stats = bayes.fit_text_bayes(bags, docs, ["A", "B", "C"], list(range(k)), scaling=scaled)
    got = {r.doc_id: [r.score_0, r.score_1, r.score_2] for r in stats.model().scores(bags, docs).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for fold in range(k):
        brute = Brute([r for r in rows if r[0] % k != fold], scaled=scaled)
        for d, _, text in rows:
            if d % k == fold:
                assert np.allclose(got[d], brute.scores(text), atol=1e-9)


def test_recipe_equals_fused_path_and_survives_saving(spark, tmp_path):
    rows = corpus()
    articles = frame(spark, rows).withColumnRenamed("text", "raw_text")
    model = recipe.fit(recipe.PipelineSpec(learner="nb"), articles)
    brute = Brute(rows, scaled=True)
    out = {r.doc_id: r for r in model.predict_proba(articles).collect()}
    for d, _, text in rows:
        s = np.array(brute.scores(text))
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert np.allclose(out[d].proba, p, atol=1e-8) and abs(sum(out[d].proba) - 1) < 1e-12
    recipe.save(model, str(tmp_path / "m"))
    again = recipe.load(spark, str(tmp_path / "m"))
    assert sorted(map(str, again.predict_proba(articles).collect())) == sorted(map(str, out.values()))


@pytest.mark.parametrize("learner,parameters", [
    ("svc", {"max_iter": 20}), ("svc", {"kernel": "rbf", "fourier_size": 16, "max_iter": 5}), ("gb", {"n_estimators": 2, "max_depth": 2}),
])
def test_saved_learners_predict_the_same(spark, tmp_path, learner, parameters):
    articles = frame(spark, corpus(30)).withColumnRenamed("text", "raw_text")
    model = recipe.fit(recipe.PipelineSpec(learner=learner, learner_parameters=parameters, min_df=4, ngram_range=(1, 1)), articles)
    recipe.save(model, str(tmp_path / "m"))
    again = recipe.load(spark, str(tmp_path / "m"))
    a, b = ({r.doc_id: r for r in m.predict_proba(articles).collect()} for m in (model, again))
    assert all(a[d].predicted == b[d].predicted and np.allclose(a[d].proba, b[d].proba) for d in a)


def test_linear_scores_need_no_vectors(spark):
    articles = frame(spark, corpus(40)).withColumnRenamed("text", "raw_text")
    model = recipe.fit(recipe.PipelineSpec(learner="svc", min_df=2), articles)
    docs = articles.select("doc_id", "raw_text").unionByName(spark.createDataFrame([(900, ""), (901, "zzz")], "doc_id bigint, raw_text string"))
    fitted = model.learner.model
    weights = {r["feature"]: r["w"] for r in fitted.coefficients.collect()}
    margins = {r.doc_id: np.array(fitted.intercepts) for r in docs.collect()}
    # the recipe's own steps, one after the other, and the table's weights
    for r in model.features.transform(recipe.prepare(model.spec, docs)).collect():
        margins[r.doc_id] = margins[r.doc_id] + r.value * np.array(weights[r.feature])
    scored = {r.doc_id: r for r in model.predict_proba(docs).collect()}
    assert len(scored) == 42
    pairs = svm.class_pairs(len(model.labels))
    for d, m in margins.items():
        votes, chance = np.zeros(len(model.labels)), np.zeros(len(model.labels))
        for p, (i, j) in enumerate(pairs):
            votes[i if m[p] > 0 else j] += 1
            q = 1 / (1 + np.exp(-(m[p] * fitted.slopes[p] + fitted.offsets[p])))
            chance += np.eye(len(votes))[i] * q + np.eye(len(votes))[j] * (1 - q)
        assert scored[d].predicted == model.labels[int(votes.argmax())]
        assert np.allclose(scored[d].proba, chance / chance.sum(), atol=1e-9)
    for r in model.pair_weights(3).collect():
        p = pairs.index((model.labels.index(r["first"]), model.labels.index(r["second"])))
        column = np.array([w[p] for w in weights.values()])
        assert weights[r["feature"]][p] == r["weight"]
        same = column[np.sign(column) == np.sign(r["weight"])]
        assert (np.abs(same) > abs(r["weight"]) + 1e-15).sum() <= r["rank"] - 1
    dense = svm.PairwiseSvmModel(["a", "b"], np.zeros((1, 3)), np.zeros(1), np.ones(1), np.zeros(1))
    with pytest.raises(ValueError):
        svm.pair_weights(spark, dense, ["too", "few"])
    with pytest.raises(ValueError):
        model.importances()


def test_only_a_linear_kernel_has_weights(spark):
    articles = frame(spark, corpus(30)).withColumnRenamed("text", "raw_text")
    spec = recipe.PipelineSpec(learner="svc", learner_parameters={"kernel": "rbf", "fourier_size": 8, "max_iter": 3}, min_df=4)
    with pytest.raises(ValueError):
        recipe.fit(spec, articles).pair_weights()


def test_importances_of_a_recipe_add_up(spark):
    articles = frame(spark, corpus(40)).withColumnRenamed("text", "raw_text")
    spec = recipe.PipelineSpec(learner="rf", learner_parameters={"n_estimators": 5, "max_depth": 4}, min_df=2)
    model = recipe.fit(spec, articles)
    rows = model.importances(10_000).collect()
    assert len(rows) == model.space.size and abs(sum(r.importance for r in rows) - 1) < 0.02


def test_style_recipes_ask_for_their_tables(spark):
    articles = frame(spark, corpus(20)).withColumnRenamed("text", "raw_text")
    lexicon = spark.createDataFrame([("een", 0.1, 0.2)], "word string, polarity double, subjectivity double")
    for spec in (recipe.PipelineSpec(features="style", learner="nb"), recipe.PipelineSpec(features="style", learner="nb", sentiment_lexicon=lexicon)):
        with pytest.raises(ValueError):
            recipe.fit(spec, articles)
    fitted = recipe.fit(recipe.PipelineSpec(features="style", learner="nb", blocks=("Basic", "Quote")), articles)
    assert fitted.predict(articles).count() == 20


def test_gradient_boosting_takes_the_square_root_by_default():
    assert learners._subset("auto", "sqrt") == "sqrt" and learners._subset("auto") == "all"


def test_explanations_take_large_ids_and_texts_without_words(spark):
    docs = spark.createDataFrame([(2**62, "goed slecht"), (2**62 + 1, "goed"), (5, "?!"), (6, "")], "doc_id bigint, text string")

    def predict_proba(rows):
        p = F.when(F.contains("text", F.lit("goed")), 0.9).otherwise(0.2)
        return rows.withColumn("proba", F.array(1 - p, p)).drop("text")

    rows = explain.explain_text(docs, predict_proba, samples=50).collect()
    best = {r.doc_id: r.feature for r in rows if r["rank"] == 1}
    assert best == {2**62: "goed", 2**62 + 1: "goed"}
    assert {(r.doc_id, r.feature, r["rank"]) for r in rows if r["rank"] == 0} == {(5, None, 0), (6, None, 0)}


def test_long_cache_entries_are_not_broadcast_by_guess(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(60)], "doc_id bigint, text string")
    token = F.struct(F.lit(0).alias("sent_idx"), F.lit(0).alias("tok_idx"), *[F.lit("x").alias(c) for c in ("word", "lemma", "morph", "pos", "ner")])
    cache = docs.select(F.sha1("text").alias("sha")).distinct().withColumn("tokens", F.array_repeat(token, 5000))
    for limit in (None, 0):
        hits = annotation.cache_hits(docs, cache, limit_bytes=limit)
        assert hits.count() == 60 and hits.where(F.size("tokens") == 5000).count() == 60


def test_a_recipe_explains_its_predictions(spark):
    articles = frame(spark, corpus(40)).withColumnRenamed("text", "raw_text")
    spec = recipe.PipelineSpec(learner="nb", scaling=False, quote_removal=False, min_df=2, ngram_range=(1, 1))
    model = recipe.fit(spec, articles)
    rows = model.explain(articles.limit(6), samples=200, top=3).collect()
    predicted = {r.doc_id: r.predicted for r in model.predict(articles).collect()}
    texts = {r.doc_id: r.raw_text for r in articles.collect()}
    assert {r.doc_id for r in rows} == {r.doc_id for r in articles.limit(6).collect()}
    assert all(r["class"] == predicted[r.doc_id] and r.feature in texts[r.doc_id] and r["rank"] <= 3 for r in rows)
    with pytest.raises(ValueError):
        recipe.fit(recipe.PipelineSpec(features="style", learner="nb", blocks=("Basic",)), articles).explain(articles)


def test_own_steps_run_after_the_others(spark, tmp_path):
    articles = frame(spark, corpus(30)).withColumnRenamed("text", "raw_text")
    spec = recipe.PipelineSpec(learner="nb", min_df=1, ngram_range=(1, 1), steps=[lambda d: d.withColumn("text", F.concat("text", F.lit(" extra")))])
    model = recipe.fit(spec, articles)
    assert "TFIDF__extra" in {r.feature for r in model.bayes.table.collect()}
    with pytest.raises(ValueError):
        recipe.save(model, str(tmp_path / "m"))


def test_the_best_parameters_are_fitted_on_everything(spark):
    articles = frame(spark, corpus(40)).withColumnRenamed("text", "raw_text")
    spec = recipe.PipelineSpec(learner="nb", scaling=False, min_df=1, ngram_range=(1, 1))
    table, best, model = search.search_recipes(spec, {"alpha": [0.1, 1000.0]}, articles, k=2)
    rows = {r.params["alpha"]: r for r in table.collect()}
    assert len(rows) == 2 and rows[str(best["alpha"])]["rank"] == 1
    assert model.spec.learner_parameters["alpha"] == best["alpha"] and model.predict(articles).count() == 40


def test_new_annotations_are_appended(spark, tmp_path):
    def tagger(frames):
        for f in frames:
            yield pd.DataFrame({"sha": f["sha"], "tokens": [
                [{"sent_idx": 0, "tok_idx": i, "word": w, "lemma": w, "morph": "", "pos": "N", "ner": "O"} for i, w in enumerate(t.split())]
                for t in f["text"]]})

    path = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "een twee"), (2, "drie"), (3, "een twee")], "doc_id bigint, text string")
    more = spark.createDataFrame([(4, "vier vijf zes"), (5, "drie")], "doc_id bigint, text string")
    assert annotation.refresh_cache(first, path, tagger).count() == 2
    files = spark.read.parquet(path).count()
    cache = annotation.refresh_cache(first.unionByName(more), path, tagger)
    assert files == 2 and spark.read.parquet(path).count() == 3 and cache.count() == 3
    tokens = annotation.annotated_tokens(first.unionByName(more), cache).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in tokens} == {1: 2, 2: 1, 3: 2, 4: 3, 5: 1}
    assert annotation.refresh_cache(more, path, tagger).count() == 3


def test_cross_validation_of_other_learners(spark):
    articles = frame(spark, corpus(40)).withColumnRenamed("text", "raw_text")
    spec = recipe.PipelineSpec(learner="rf", learner_parameters={"n_estimators": 5, "max_depth": 4}, min_df=2)
    out = recipe.cross_validate(spec, articles, k=2)
    assert out.count() == 40 and out.select("doc_id").distinct().count() == 40
    assert metrics.plain_accuracy(out).first().accuracy > 0.5
    nb = recipe.cross_validate(recipe.PipelineSpec(learner="nb", scaling=False), articles, k=4)
    assert nb.count() == 40


def test_tfidf_norms_are_one(spark):
    bags = keep(terms.bag_of_terms(frame(spark, corpus())))
    out = terms.fit_tfidf(bags, 60).weigh(bags).groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-12 for r in out)


def test_scalers(spark):
    rows = spark.createDataFrame(
        [(i, "a", float(i)) for i in range(8)] + [(i, "b", 5.0) for i in range(8)] + [(0, "c", 2.0), (1, "c", 4.0)],
        "doc_id bigint, feature string, value double")
    iqr = {(r.doc_id, r.feature): r.value for r in scaling.fit_iqr_scaler(rows, 8).transform(rows).collect()}
    assert iqr[(7, "a")] == 7 / 3.5 and iqr[(3, "b")] == 5.0
    assert np.isclose(iqr[(1, "c")], 4.0 / 0.5)  # six zeros left out: quartiles 0 and 0.5
    unit = {(r.doc_id, r.feature): r.value for r in scaling.fit_unit_range_scaler(rows, 8).transform(rows).collect()}
    assert unit[(7, "a")] == 1.0 and unit[(3, "b")] == 0.0 and unit[(1, "c")] == 1.0 and unit[(0, "c")] == 0.5


def predictions(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id bigint, pipeline_id string, pipeline_idx int, predicted string, truth string")


def test_majority_and_agreement(spark):
    p = predictions(spark, [(1, f"p{i}", i, x, t) for i, x, t in
                            [(0, "A", "A"), (1, "B", "A"), (2, "B", "A"), (3, "A", "A")]] +
                    [(2, f"p{i}", i, "C", "UNL") for i in range(4)])
    got = {r.doc_id: (r.prevailing, r.voters, r.n_votes) for r in comparison.majority_vote(p).collect()}
    assert got == {1: ("A", "p0,p3", 2), 2: ("C", "p0,p1,p2,p3", 4)}
    members = {(r.pipelines, r.predicted, r.doc_id, r.flag) for r in comparison.agreement_members(p).collect()}
    assert members == {("p0,p3", "A", 1, "correct"), ("p1,p2", "B", 1, "wrong"), ("p0,p1,p2,p3", "C", 2, "unlabeled")}


def test_metrics_of_odd_classes(spark):
    p = spark.createDataFrame([(i, "A", x) for i, x in enumerate("AAAAAABBBBXX")], "doc_id bigint, truth string, predicted string")
    r = metrics.evaluate(p).first()
    assert r.recall_micro == r.precision_micro == 0.5 and np.isclose(r.precision_macro, 1 / 3) and r.cohens_kappa == 0
    few = metrics.evaluate(p.limit(5)).first()
    assert few.accuracy is None and few["std"] is None and few.cohens_kappa is None
    dense = metrics.dense_confusion(metrics.confusion(p), ["A", "B", "X", "Y"])
    assert dense.count() == 16 and dense.agg(F.sum("n")).first()[0] == 12


def test_numeric_labels_sort_as_numbers(spark):
    got = labels.label_list(spark.createDataFrame([("10",), ("9",), ("2",)], "label string"))
    assert got == ["2", "9", "10"]
    with pytest.raises(ValueError):
        labels.label_list(spark.createDataFrame([], "label string"))


def test_linguistic_features(spark):
    tokens = spark.createDataFrame([
        (1, "moeten", "WW(pv)", "O"), (1, "Moeten", "N(soort)", "O"), (1, "ik", "VNW(pers)", "O"), (1, "Ik", "VNW(pers)", "O"),
        (1, "Den Haag", "SPEC", "B-LOC"), (1, "den haag", "SPEC", "B-LOC"), (1, "haag", "SPEC", "B-LOC"), (1, "erg", "BW()", "O"),
        (1, "drie", "TW(hoofd)", "I-X")], "doc_id bigint, lemma string, pos string, ner string")
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "")], "doc_id bigint, text string")
    out = {r.doc_id: r for r in style.linguistic_features(tokens, docs, style.lexicon_frame(spark)).collect()}
    one = out[1]
    assert (one.modal_verbs_perc, one.pronoun_1_perc, one.intensifiers_perc, one.number_perc) == (0.1, 0.1, 0.1, 0.1)
    assert (one.named_entities_perc, one.unique_named_entities_perc) == (0.3, 0.2)
    assert all(out[2][c] == 0 for c in style.LINGUISTIC)
    found = style.entity_strings(tokens).first()
    assert found.maximal == ["den haag"] and found.contained == ["haag"]


def separable(spark, n=90, dim=4, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=dim) + 4 * np.eye(dim)[i % 3]]) for i in range(n)]
    data = spark.createDataFrame(rows, "doc_id bigint, label_idx int, a array<double>")
    return vectors.dense_vectors(data, "a").withColumnRenamed("a", "features_array")


@pytest.mark.parametrize("tag,parameters", [
    ("svc", {}), ("svc", {"kernel": "rbf", "gamma": 0.1}), ("rf", {"n_estimators": 10, "class_weight": "balanced"}),
    ("gb", {"n_estimators": 3}), ("xgb", {"n_estimators": 3, "subsample": 0.8}), ("xgb", {"booster": "gblinear"}),
    ("lgbm", {"n_estimators": 3, "num_leaves": 8}), ("mlp", {"hidden_layer_sizes": "8,4"}),
])
def test_learners_separate(spark, tag, parameters):
    data = separable(spark).cache()
    fitted = learners.fit_learner(tag, data.select("doc_id", "label_idx", "features"), ["x", "y", "z"], 4, **parameters)
    out = fitted.transform(data).collect()
    assert np.mean([r.predicted == "xyz"[r.label_idx] for r in out]) > 0.9
    assert all(abs(sum(r.proba) - 1) < 1e-6 for r in out)


def test_boosting_query_fits_the_default_rounds(spark, monkeypatch):
    """The query takes the learner's 100 rounds (only the fit is replaced, by one of a single round)."""
    rounds, fit = [], learners.fit_learner

    def counted(tag, train, names, dim, **parameters):
        rounds.append((tag, learners.parameters(tag, **parameters).n_estimators))
        return fit(tag, train, names, dim, n_estimators=1, max_depth=1)

    monkeypatch.setattr(learners, "fit_learner", counted)
    out = model_queries.gb_predict(spark, "/root/testdata/sf0.001")
    assert rounds == [("gb", 100)] and out.columns == ["doc_id", "truth", "predicted", "confidence"]


def test_learner_registry():
    with pytest.raises(ValueError, match="unknown learner"):
        learners.parameters("knn")
    with pytest.raises(ValueError, match="unknown parameter"):
        learners.parameters("nb", beta=1)
    assert learners.parameters("mlp", hidden_layer_sizes="30,10").hidden() == [30, 10]


def test_pair_weights(spark):
    model = svm.PairwiseSvmModel(["a", "b"], np.array([[0.5, -2.0, 0.0, 1.0]]), np.zeros(1), np.ones(1), np.zeros(1))
    got = [(r.feature, r["weight"], r["rank"]) for r in svm.pair_weights(spark, model, list("wxyz"), top=1).orderBy("weight").collect()]
    assert got == [("x", -2.0, 1), ("z", 1.0, 1)]


def test_lime_text_finds_the_deciding_word(spark):
    docs = spark.createDataFrame([(7, "goed boek, een goed verhaal over niets")], "doc_id bigint, text string")

    def predict_proba(rows):
        p = F.when(F.col("text").contains("goed"), 0.9).otherwise(0.2)
        return rows.withColumn("proba", F.array(1 - p, p))

    out = explain.explain_text(docs, predict_proba, samples=300, top=3).orderBy("rank").collect()
    assert out[0].feature == "goed" and out[0]["class_idx"] == 1 and 0.5 < out[0]["weight"] < 0.75 and out[0].fit > 0.9


def test_lime_rows_and_shap(spark):
    data = separable(spark, 30)

    def predict_proba(rows):
        p = F.lit(1) / (1 + F.exp(-F.get(F.transform(F.array("v"), lambda x: x), F.lit(0))))
        from pyspark.ml.functions import vector_to_array
        first = rows.withColumn("v", vector_to_array("features")[2])
        return first.withColumn("proba", F.array(1 - p, p)).drop("v")

    bins = explain.TrainingBins.fit(data)
    out = explain.explain_rows(data, bins, predict_proba, samples=400, top=2).where("rank = 1").collect()
    assert len(out) == 30 and np.mean([r.feature_idx == 2 for r in out]) > 0.95
    background = np.zeros((1, 4))
    shap = explain.kernel_shap(data, background, np.ones(1), predict_proba, samples=64).where("class_idx = 1").collect()
    truth = {r.doc_id: 1 / (1 + math.exp(-r.features_array[2])) for r in data.collect()}
    for r in shap:
        want = truth[r.doc_id] - 0.5 if r.feature_idx == 2 else 0.0
        assert abs(r["value"] - want) < 1e-6 and abs(r.base - 0.5) < 1e-12


def test_grid_search(spark):
    seen = search.grid_search({"alpha": [1, 2], "beta": ["x"]}, lambda p, fold: p["alpha"] + fold / 10, spark, k=3)
    rows = {r.params["alpha"]: r for r in seen.collect()}
    assert rows["2"]["rank"] == 1 and np.isclose(rows["1"].mean_score, 1.1) and np.isclose(rows["1"].std_score, np.std([1, 1.1, 1.2]))
    assert search.top_candidates(seen, 1).count() == 1


def test_a_column_of_ids_is_no_label(spark, monkeypatch):
    monkeypatch.setattr(labels, "MAX_LABELS", 5)
    rows = spark.range(6).select(F.col("id").cast("string").alias("label"))
    assert labels.label_list(rows.limit(5)) == ["0", "1", "2", "3", "4"]
    with pytest.raises(ValueError):
        labels.label_list(rows)


def test_chi2_by_hand(spark):
    w = spark.createDataFrame([(0, "t", 1.0), (1, "t", 3.0)], "doc_id bigint, term string, w double")
    y = spark.createDataFrame([(0, "A"), (1, "B"), (2, "B"), (3, "B")], "doc_id bigint, label string")
    # expected: A 1, B 3
    assert abs(terms.chi2_scores(w, y).first().chi2) < 1e-12
    w2 = spark.createDataFrame([(0, "t", 4.0)], "doc_id bigint, term string, w double")
    assert np.isclose(terms.chi2_scores(w2, y).first().chi2, (4 - 1) ** 2 / 1 + 3)


def test_plans_have_no_cartesian_product_or_one_task_window(spark):
    docs = frame(spark, corpus()).withColumn("label_idx", F.lit(0))
    bags = terms.bag_of_terms(docs)
    model = terms.fit_tfidf(bags, 60)
    plan = model.weigh(bags)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan
    # the text is hashed on doc_id once; counting and norms reuse it
    assert plan.count("Exchange hashpartitioning(doc_id") + plan.count("REPARTITION_BY_NUM") <= 2


def test_a_deep_forest_keeps_the_nodes_of_its_rows(spark):
    """Passes send no trees; the forest is the one grown without."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame(
        [(i, int(rng.integers(3)), Vectors.dense(rng.normal(size=6).tolist())) for i in range(300)],
        ["doc_id", "label_idx", "features"])
    fitted = learners.fit_learner("rf", rows, ["a", "b", "c"], 6, n_estimators=4)
    plain = RandomForestClassifier(labelCol="label", numTrees=4, featureSubsetStrategy="5", maxDepth=30, seed=learners.SEED).fit(learners._labelled(rows))
    assert fitted.model.getCacheNodeIds()
    assert fitted.model.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]
