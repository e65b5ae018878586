"""From a pipeline description to a fitted model and its predictions.

A spec names the steps; ``fit`` composes the DataFrame transforms in this order,
leaving out what is switched off:

  clean -> (lowercase) -> (stop words) -> (base forms) -> features -> (scaling) -> learner

Quotes are removed inside the TF-IDF, sentiment and linguistic blocks only, so the
basic and quote blocks still see them.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import annotation, bayes, explain, folds as fold_ops, labels as label_ops, learners, scaling, style, svm, terms, text_svm, vectors
from ..operators.text_bags import TextBags
from ..session import scratch_path
from .ranks import hash_key
from .staging import keep, settle, stored

TFIDF, STYLE, STYLE_TFIDF = "tfidf", "style", "style_tfidf"


class FeatureStep:
    """A user's own fitted step over long features (doc_id, feature, value); a dataclass of plain parameters.

    What ``fit`` learns from the training documents is a table; it is applied to every later document, and
    saved and loaded with the recipe.
    """

    def fit(self, features: DataFrame, labelled: DataFrame) -> DataFrame:
        """State from the training features and (doc_id, label_idx)."""
        raise NotImplementedError

    def apply(self, features: DataFrame, state: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class BestByChi2(FeatureStep):
    """Keep the ``k`` features with the largest chi2 against the label (rounded to six digits, then by name)."""

    k: int = 100

    def fit(self, features: DataFrame, labelled: DataFrame) -> DataFrame:
        scores = terms.chi2_scores(features, labelled.withColumnRenamed("label_idx", "label"), "feature", "value")
        return terms.select_k_best(scores.withColumn("chi2", F.round("chi2", 6)), self.k, "feature").select("feature")

    def apply(self, features: DataFrame, state: DataFrame) -> DataFrame:
        # at most k rows
        return features.join(F.broadcast(state), "feature", "left_semi").select(*features.columns)


@dataclass(frozen=True)
class PipelineSpec:
    features: str = TFIDF
    learner: str = "svc"
    learner_parameters: Mapping = field(default_factory=dict)
    lowercase: bool = False
    quote_removal: bool = True
    scaling: bool = True
    stop_words: Sequence[str] = ()
    dictionary: DataFrame | None = None          # (form, base) for word normalisation
    sentiment_lexicon: DataFrame | None = None   # (word, polarity, subjectivity)
    lexicon: DataFrame | None = None             # (category, lemma); the Dutch lists by default
    linguistic: Sequence[str] = tuple(style.LINGUISTIC)
    min_df: int = terms.MIN_DF
    ngram_range: tuple[int, int] = (1, 2)
    blocks: Sequence[str] = ("Basic", "Quote", "Sentiment", "Linguistic")
    steps: Sequence[Callable[[DataFrame], DataFrame]] = ()  # (doc_id, text, ...) -> the same, after all steps above
    feature_steps: Sequence[FeatureStep] = ()    # fitted on the training features, after extraction and scaling


def prepare(spec: PipelineSpec, docs: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Replace the raw text by the pre-processed ``text``."""
    out = tx.clean_ocr(F.col(raw))
    if spec.lowercase:
        out = tx.lowercase(out)
    if spec.stop_words:
        out = tx.remove_stop_words(out, spec.stop_words)
    rows = docs.select(*[c for c in docs.columns if c != raw], out.alias("text"))
    if spec.dictionary is not None:
        rows = annotation.normalise_text(rows, spec.dictionary)
    for step in spec.steps:
        rows = step(rows)
    return rows


def _unquoted(spec: PipelineSpec, docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", tx.remove_quotes(F.col("text"))) if spec.quote_removal else docs


def style_blocks(spec: PipelineSpec, docs: DataFrame, tokens: DataFrame | None) -> dict[str, DataFrame]:
    """Wide feature blocks by name: those of ``spec.blocks``; a block without its input table is an error."""
    unknown = set(spec.blocks) - {"Basic", "Quote", "Sentiment", "Linguistic"}
    if unknown:
        raise ValueError(f"unknown feature block(s) {sorted(unknown)}")
    if "Sentiment" in spec.blocks and spec.sentiment_lexicon is None:
        raise ValueError("the Sentiment block needs a sentiment lexicon; leave it out of the spec's blocks otherwise")
    if "Linguistic" in spec.blocks and tokens is None:
        raise ValueError("the Linguistic block needs a token table; leave it out of the spec's blocks otherwise")
    if is_measured(docs):
        return {name: docs.select("doc_id", *columns) for name, columns in MEASURED.items() if name in spec.blocks}
    blocks = {}
    plain = _unquoted(spec, docs)
    if "Basic" in spec.blocks:
        blocks["Basic"] = style.basic_features(docs)
    if "Quote" in spec.blocks:
        blocks["Quote"] = style.quote_features(docs)
    if "Sentiment" in spec.blocks:
        blocks["Sentiment"] = style.sentiment_features(plain, spec.sentiment_lexicon)
    if "Linguistic" in spec.blocks:
        lexicon = spec.lexicon if spec.lexicon is not None else style.lexicon_frame(docs.sparkSession)
        blocks["Linguistic"] = style.linguistic_features(tokens, plain, lexicon, selected=spec.linguistic)
    return blocks


# style blocks that are numbers of a text by itself
MEASURED = {"Basic": style.BASIC, "Quote": style.QUOTE}


def is_measured(docs: DataFrame) -> bool:
    return "text" not in docs.columns and set(sum(MEASURED.values(), [])) <= set(docs.columns)


def measured(spec: PipelineSpec, articles: DataFrame, raw: str = "raw_text") -> DataFrame | None:
    """The documents with their style features in place of the text, for recipes that need no more of it: searches measure a text once, not once a fold."""
    if spec.features != STYLE or not set(spec.blocks) <= set(MEASURED) or spec.dictionary is not None or spec.steps:
        return None
    carry = [c for c in articles.columns if c not in ("doc_id", raw)]
    basic = style.basic_features(prepare(spec, articles, raw), carry=[*carry, "text"])
    return settle(style.quote_features(basic, carry=[*carry, *style.BASIC]))


@dataclass
class FeatureModel:
    """Fitted feature extraction: docs -> long (doc_id, feature, value), already scaled."""

    spec: PipelineSpec
    tfidf: terms.TfIdfModel | None
    scalers: list[scaling.ScalerModel]
    states: list[DataFrame] = field(default_factory=list)   # one table per feature step

    def raw(self, docs: DataFrame, tokens: DataFrame | None, bags: TextBags | None = None,
            held: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Features before scaling; ``bags`` are those of ``docs`` if there are some, ``held`` keeps the style features."""
        parts = {}
        if self.spec.features != TFIDF:
            for name, block in style_blocks(self.spec, docs, tokens).items():
                parts[name] = style.to_long(block if held is None else held(block))
        if self.tfidf is not None:
            bags = bags or TextBags(_unquoted(self.spec, docs), ngram_range=self.spec.ngram_range)
            parts["TFIDF"] = self.tfidf.weigh(bags).select(
                "doc_id", F.col("term").alias("feature"), F.col("w").alias("value")
            )
        return style.feature_union(parts)

    def transform(self, docs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
        features = self.raw(docs, tokens)
        for scaler in self.scalers:
            features = scaler.transform(features)
        for step, state in zip(self.spec.feature_steps, self.states, strict=True):
            features = step.apply(features, state)
        return features


def fit_features(spec: PipelineSpec, docs: DataFrame, n_docs: int, tokens: DataFrame | None) -> tuple[FeatureModel, DataFrame]:
    """The fitted model and the features of the training documents."""
    if spec.features not in EXTRACTORS:
        raise ValueError(f"unknown feature recipe {spec.features!r}, use one of {sorted(EXTRACTORS)}")
    return EXTRACTORS[spec.features](spec, docs, n_docs, tokens)


def _fit_features(spec, docs, n_docs, tokens):
    tfidf = bags = None
    if spec.features != STYLE:
        bags = TextBags(_unquoted(spec, docs), ngram_range=spec.ngram_range)
        tfidf = terms.fit_tfidf(bags, n_docs, spec.min_df)
    model = FeatureModel(spec, tfidf, [])
    # naive Bayes reads its features a few times only: the terms' share is weighed again, many times the texts it comes from
    again = spec.learner == "nb" and bags is not None
    held = (lambda f: f) if again else settle
    features = held(model.raw(docs, tokens, bags, settle if again else None))
    fits: list[Callable] = []
    if spec.scaling:
        fits.append(lambda f: scaling.fit_iqr_scaler(f, n_docs))
    if spec.learner == "nb" and spec.features != TFIDF:
        fits.append(lambda f: scaling.fit_unit_range_scaler(f, n_docs))
    for fit_one in fits:
        scaler = fit_one(features)
        model.scalers.append(scaler)
        features = held(scaler.transform(features))
    for step in spec.feature_steps:
        state = settle(step.fit(features, docs.select("doc_id", "label_idx")))
        model.states.append(state)
        features = settle(step.apply(features, state))
    return model, features


# recipe name -> fit; a plug-in adds an entry
EXTRACTORS: dict[str, Callable] = {TFIDF: _fit_features, STYLE: _fit_features, STYLE_TFIDF: _fit_features}


@dataclass
class FittedPipeline:
    spec: PipelineSpec
    labels: list[str]
    features: FeatureModel
    bayes: bayes.LongBayesModel | None = None
    learner: learners.FittedLearner | None = None
    space: vectors.VectorSpace | None = None
    _weights: DataFrame | None = None
    _counted: tuple[DataFrame, bayes.TextBayesModel] | None = None   # documents whose terms are counted already, and the model over them

    def predict_proba(self, docs: DataFrame, tokens: DataFrame | None = None, raw: str = "raw_text") -> DataFrame:
        """(doc_id, predicted, proba) for (doc_id, raw text)."""
        if self._counted is not None and docs.select("doc_id", raw).sameSemantics(self._counted[0]):
            _, model = self._counted
            return self._named(model.scores(model.bags, docs.select("doc_id")))
        return self.proba_of(prepare(self.spec, docs.select("doc_id", raw), raw), tokens)

    def proba_of(self, prepared: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
        """(doc_id, predicted, proba) for texts that are prepared already."""
        ids = prepared.select("doc_id")
        if self.learner is not None and isinstance(self.learner.model, svm.TextSvmModel):
            bags = terms.bags_in_row(_unquoted(self.spec, prepared), ngram_range=self.spec.ngram_range)
            return self.learner.named(self.learner.model.score_bags(bags, ids)).select("doc_id", "predicted", "proba")
        if self.bayes is not None and self.spec.features == TFIDF and not self.features.scalers and not self.spec.feature_steps:
            return self._named(self._text_bayes().scores(TextBags(_unquoted(self.spec, prepared), ngram_range=self.spec.ngram_range), ids))
        return self.proba_of_features(self.features.transform(prepared, tokens), ids)

    def proba_of_features(self, long: DataFrame, ids: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """(doc_id, predicted, proba) of documents ``ids`` with long features; ``rows`` are their vectors if there are some."""
        if self.bayes is not None:
            return self._named(self.bayes.scores(long, ids))
        if self.linear:
            scored = self.learner.named(self.learner.model.score_long(long, self.weights(), self.space.size, ids))
        else:
            scored = self.learner.transform(self.space.vectors(long, ids) if rows is None else rows)
        return scored.select("doc_id", "predicted", "proba")

    def _named(self, scores: DataFrame) -> DataFrame:
        return scores.select(
            "doc_id", bayes.argmax_label(self.labels).alias("predicted"), bayes.softmax(len(self.labels)).alias("proba")
        )

    def _text_bayes(self) -> bayes.TextBayesModel:
        """Naive Bayes on plain TF-IDF: idf and log probabilities of a term in one table."""
        tfidf = self.features.tfidf
        named = tfidf.table.withColumn("feature", F.concat(F.lit("TFIDF__"), "term")).join(self.bayes.table, "feature")
        table = stored(named.select("term", "df", F.array("idf").alias("idf"), F.array("lp").alias("lp")))
        return bayes.TextBayesModel(table, tfidf.n_terms, self.labels, [self.bayes.priors], [None])

    @property
    def linear(self) -> bool:
        """Linear support vectors score long features; no vector is built."""
        return isinstance(self.learner.model, svm.PairwiseSvmModel) and self.learner.projection is None

    def weights(self) -> DataFrame:
        """(feature, w): the coefficients of every feature over all class pairs."""
        if self._weights is None:
            table = self.learner.model.coefficient_table(self.space.index.sparkSession)
            self._weights = settle(self.space.index.join(table, "idx").select("feature", "w"))
        return self._weights

    def pair_weights(self, top: int = 10) -> DataFrame:
        """The strongest features of every class pair; only a linear kernel has them."""
        if self.learner is None or not self.linear:
            raise ValueError("only linear support vectors have weights per feature")
        names = None if self.space is None else self.space.index
        return svm.pair_weights(SparkSession.active(), self.learner.model, names, top)

    def importances(self, top: int = 30) -> DataFrame:
        """Relative importance of the features of a tree learner."""
        if self.learner is None or self.learner.tag not in ("rf", "gb", "xgb", "lgbm"):
            raise ValueError("only tree learners have importances")
        return learners.importances(self.space.index.sparkSession, self.learner, self.space.index, top)

    def split_counts(self) -> DataFrame:
        """(feature, n_splits, gain) of a tree learner's features."""
        if self.learner is None or self.learner.tag not in ("rf", "gb", "xgb", "lgbm"):
            raise ValueError("only tree learners have splits")
        spark = self.space.index.sparkSession
        return learners.split_counts(spark, self.learner, self.space.index, scratch_path(spark, "trees"))

    def explain(self, docs: DataFrame, samples: int = explain.SAMPLES, top: int = explain.FEATURES, raw: str = "raw_text") -> DataFrame:
        """(doc_id, class, feature, weight, rank): the words that speak for the predicted class.

        Words are removed from the prepared text, so the recipe must work on text alone.
        """
        if self.spec.features != TFIDF:
            raise ValueError("texts are explained for TF-IDF recipes; use explain.explain_rows for feature rows")

        def proba(rows: DataFrame) -> DataFrame:
            carried = [c for c in rows.columns if c != "text"]
            return rows.select(*carried).join(self.proba_of(rows).select("doc_id", "proba"), "doc_id")

        out = explain.explain_text(prepare(self.spec, docs.select("doc_id", raw), raw), proba, samples, top)
        named = F.get(F.array(*[F.lit(n) for n in self.labels]), F.col("class_idx"))
        return out.select("doc_id", named.alias("class"), "feature", "weight", "rank")

    def predict(self, docs: DataFrame, tokens: DataFrame | None = None, raw: str = "raw_text") -> DataFrame:
        return self.predict_proba(docs, tokens, raw).select("doc_id", "predicted")


@dataclass
class TrainingSet:
    """Labelled documents with fitted features: what any number of learner settings can be fitted on."""

    spec: PipelineSpec
    labels: list[str]
    features: FeatureModel
    long: DataFrame | None                   # features of the documents
    ids: DataFrame                           # (doc_id, label_idx)
    space: vectors.VectorSpace | None = None
    rows: DataFrame | None = None            # vectors, for learners that need them
    sums: bayes.TextBayesStatistics | None = None   # naive Bayes on plain TF-IDF: what every alpha is fitted from
    articles: DataFrame | None = None        # the documents ``sums`` were counted on

    def fit(self, parameters: Mapping) -> FittedPipeline:
        spec = replace(self.spec, learner_parameters=dict(parameters))
        if spec.learner == "nb":
            alpha = learners.parameters("nb", **parameters).alpha
            if self.sums is not None:
                model = self.sums.model(alpha)
                named = model.table.select(F.concat(F.lit("TFIDF__"), "term").alias("feature"), F.col("lp")[0].alias("lp"))
                long = bayes.LongBayesModel(named, model.n_terms, self.labels, model.priors[0])
                return FittedPipeline(spec, self.labels, self.features, bayes=long, _counted=(self.articles, model))
            return FittedPipeline(spec, self.labels, self.features, bayes=bayes.fit_long_bayes(self.long, self.ids, self.labels, alpha))
        fitted = learners.fit_learner(spec.learner, self.rows, self.labels, self.space.size, **parameters)
        return FittedPipeline(spec, self.labels, self.features, learner=fitted, space=self.space)


def training_set(
    spec: PipelineSpec, articles: DataFrame, tokens: DataFrame | None = None, raw: str = "raw_text", counted: bool = False,
) -> TrainingSet:
    """Fit every step before the learner on (doc_id, label, raw text).

    ``counted``: naive Bayes on plain TF-IDF keeps the sums of the texts' terms instead of features, for several
    settings or for scoring the same documents.
    """
    train, names = _encoded(spec, articles, raw)
    ids = train.select("doc_id", "label_idx")
    if counted and is_text_bayes(spec) and _once(ids):
        # the terms of a text are summed in its block; no row per document and term
        bags = TextBags(_unquoted(spec, train), ["label_idx"], spec.ngram_range)
        sums = bayes.fit_text_bayes(bags, ids, names, [None], spec.min_df)
        tfidf = terms.TfIdfModel(sums.idf.select("term", "df", F.col("idf")[0].alias("idf")), sum(sums.documents[0]), sums.n_terms)
        return TrainingSet(spec, names, FeatureModel(spec, tfidf, []), None, ids, sums=sums, articles=articles.select("doc_id", raw))
    model, features = fit_features(spec, train, train.count(), tokens)
    if spec.learner == "nb":
        return TrainingSet(spec, names, model, features, ids)
    space = vectors.fit_vector_space(features)
    return TrainingSet(spec, names, model, features, ids, space, settle(space.vectors(features, ids)))


def _encoded(spec: PipelineSpec, articles: DataFrame, raw: str) -> tuple[DataFrame, list[str]]:
    names = label_ops.label_list(articles)
    index = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label").cast("string")) - 1
    if is_measured(articles):
        return settle(articles.select("doc_id", index.cast("int").alias("label_idx"), *sum(MEASURED.values(), []))), names
    return settle(prepare(spec, articles.select("doc_id", index.cast("int").alias("label_idx"), raw), raw)), names


def fit(spec: PipelineSpec, articles: DataFrame, tokens: DataFrame | None = None, raw: str = "raw_text") -> FittedPipeline:
    """Fit every step on (doc_id, label, raw text)."""
    if is_text_svm(spec):
        train, names = _encoded(spec, articles, raw)
        return _fit_text_svm(spec, train, names, train.count())
    return training_set(spec, articles, tokens, raw).fit(spec.learner_parameters)


def is_text_bayes(spec: PipelineSpec) -> bool:
    """Naive Bayes on plain TF-IDF."""
    return spec.learner == "nb" and spec.features == TFIDF and EXTRACTORS[TFIDF] is _fit_features and not (spec.scaling or spec.feature_steps)


def _once(ids: DataFrame) -> bool:
    """Does every document come once, under an id and with a label?"""
    row = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.count("label_idx").alias("labelled")).first()
    return row["n"] == row["ids"] == row["labelled"] > 0


def is_text_svm(spec: PipelineSpec) -> bool:
    """The default recipe: TF-IDF and linear support vectors."""
    if spec.feature_steps:
        return False
    return spec.learner == "svc" and spec.features == TFIDF and learners.parameters("svc", **spec.learner_parameters).kernel == "linear"


def _fit_text_svm(spec: PipelineSpec, train: DataFrame, names: list[str], n_docs: int) -> FittedPipeline:
    """All class pairs on all documents, and on four fifths of them to calibrate on the rest, in one run."""
    aside = F.pmod(hash_key(F.col("doc_id"), "|calibrate"), F.lit(svm.CALIBRATION_SHARE)) == 0
    rows = train.withColumn("fold", F.when(aside, 0).otherwise(1))
    bags = keep(terms.bag_of_terms(_unquoted(spec, rows), carry=["label_idx", "fold"], ngram_range=spec.ngram_range))
    given = learners.parameters("svc", **spec.learner_parameters)
    fitted = text_svm.fit_text_svm(
        bags, rows.select("doc_id", "label_idx", "fold"), names, [None, 0], spec.min_df, spec.scaling, given.penalty_parameter_c)
    slopes, offsets = svm.calibrate(fitted.margins().where("set = 1"), len(names))
    table, intercepts = fitted.table(0)
    model = svm.TextSvmModel(names, table, intercepts, slopes, offsets, fitted.n_terms)
    return FittedPipeline(spec, names, _text_features(spec, table, n_docs, fitted.n_terms), learner=learners.FittedLearner("svc", model, names))


def _text_features(spec: PipelineSpec, table: DataFrame, n_docs: int, n_terms: int) -> FeatureModel:
    """The feature steps of a text model's table."""
    tfidf = terms.TfIdfModel(table.select("term", "df", "idf"), n_docs, n_terms)
    scale = table.where("scale <> 1").select("feature", F.lit(0.0).alias("shift"), "scale")
    return FeatureModel(spec, tfidf, [scaling.ScalerModel(scale, n_terms)] if spec.scaling else [])


def cross_validate(
    spec: PipelineSpec, articles: DataFrame, k: int = 10, seed: int = fold_ops.SEED, tokens: DataFrame | None = None,
    raw: str = "raw_text", parallelism: int = 2,
) -> DataFrame:
    """Out-of-fold predictions (doc_id, fold, truth, predicted); every step is fitted per training set.

    TF-IDF with naive Bayes trains all folds in one pass over the terms, TF-IDF with linear support
    vectors all folds and class pairs in the same rounds; other learners run one fit per fold from a
    small thread pool.
    """
    folded = keep(fold_ops.shuffled_folds(articles, k, seed))
    if is_text_svm(spec):
        return _text_svm_folds(spec, folded, k, raw)[0]
    if spec.learner == "nb" and spec.features == TFIDF and not spec.feature_steps:
        names = label_ops.label_list(articles)
        index = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label").cast("string")) - 1
        docs = _unquoted(spec, prepare(spec, folded.select("doc_id", "label", "fold", index.cast("int").alias("label_idx"), raw), raw))
        bags = TextBags(docs, ["label_idx", "fold"], spec.ngram_range)
        slim = folded.select("doc_id", "label", "fold", index.cast("int").alias("label_idx"))
        stats = bayes.fit_text_bayes(
            bags, slim.select("doc_id", "label_idx", "fold"), names, list(range(k)), spec.min_df, spec.scaling
        )
        model = stats.model(learners.parameters("nb", **spec.learner_parameters).alpha)
        return model.predict(bags, slim, ["fold", "label"]).withColumnRenamed("label", "truth")

    def one(fold: int) -> DataFrame:
        test = folded.where(F.col("fold") == fold)
        model = fit(spec, folded.where(F.col("fold") != fold), tokens, raw)
        return test.select("doc_id", "fold", F.col("label").alias("truth")).join(model.predict(test, tokens, raw), "doc_id")

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _text_svm_folds(spec: PipelineSpec, folded: DataFrame, k: int, raw: str) -> tuple[DataFrame, text_svm.FittedTextSvm]:
    """Out-of-fold predictions (doc_id, fold, truth, predicted) of the default recipe, and the fitted models."""
    given = learners.parameters("svc", **spec.learner_parameters)
    votes, fitted = text_svm_candidates(spec, folded, list(range(k)), [given.penalty_parameter_c], raw)
    return votes.select("doc_id", "fold", "truth", "predicted"), fitted


def text_svm_candidates(
    spec: PipelineSpec, folded: DataFrame, held_out: Sequence[int], penalties: Sequence[float], raw: str = "raw_text",
) -> tuple[DataFrame, text_svm.FittedTextSvm]:
    """Out-of-fold predictions (doc_id, fold, truth, predicted, candidate) of the default recipe for several penalties.

    Candidate i has ``penalties[i]``; all candidates, folds and class pairs are fitted in the same rounds.
    """
    names = label_ops.label_list(folded)
    index = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label").cast("string")) - 1
    docs = settle(prepare(spec, folded.select("doc_id", "fold", index.cast("int").alias("label_idx"), raw), raw))
    bags = keep(terms.bag_of_terms(_unquoted(spec, docs), carry=["label_idx", "fold"], ngram_range=spec.ngram_range))
    sets = [(fold, c) for c in penalties for fold in held_out]
    fitted = text_svm.fit_text_svm(
        bags, docs.select("doc_id", "label_idx", "fold"), names, [fold for fold, _ in sets], spec.min_df, spec.scaling, [c for _, c in sets])
    name = lambda c: F.get(F.array(*[F.lit(n) for n in names]), F.col(c))
    return fitted.votes().select(
        "doc_id", "fold", name("label_idx").alias("truth"), name("predicted_idx").alias("predicted"),
        F.floor(F.col("set") / len(held_out)).cast("int").alias("candidate")), fitted


def score(models: Mapping[str, FittedPipeline], articles: DataFrame, truth: str = "label", run_id: str | None = None,
          tokens: DataFrame | None = None, raw: str = "raw_text") -> DataFrame:
    """Long predictions of several fitted pipelines on one corpus."""
    from ..operators.comparison import union_predictions

    per_pipeline = {
        name: articles.select("doc_id", F.col(truth).alias("truth")).join(model.predict(articles, tokens, raw), "doc_id")
        for name, model in models.items()
    }
    return union_predictions(per_pipeline, run_id)


# --- keeping fitted pipelines ---------------------------------------------------------


def save(model: FittedPipeline, path: str) -> None:
    """Write a fitted pipeline: its tables as parquet, its learner, one JSON line of settings."""
    if model.spec.steps:
        raise ValueError("a recipe with own steps cannot be saved: its functions are not data")
    spark = SparkSession.active()
    root = path.rstrip("/")
    if model.bayes is not None:
        model.bayes.table.write.parquet(f"{root}/bayes")
    else:
        if model.space is not None:
            model.space.index.write.parquet(f"{root}/space")
        model.learner.save(f"{root}/learner", spark)
    if model.features.tfidf is not None:
        model.features.tfidf.table.write.parquet(f"{root}/idf")
    for i, scaler in enumerate(model.features.scalers):
        scaler.table.write.parquet(f"{root}/scaler_{i}")
    for i, state in enumerate(model.features.states):
        state.write.parquet(f"{root}/state_{i}")
    tables = {}
    for name in ("dictionary", "sentiment_lexicon", "lexicon"):
        frame = getattr(model.spec, name)
        tables[name] = frame is not None
        if frame is not None:
            frame.write.parquet(f"{root}/{name}")
    plain = asdict(replace(model.spec, dictionary=None, sentiment_lexicon=None, lexicon=None, feature_steps=()))
    del plain["steps"]
    plain["feature_steps"] = [[type(x).__module__, type(x).__qualname__, asdict(x)] for x in model.spec.feature_steps]
    settings = {
        "spec": plain, "tables": tables, "labels": model.labels,
        "priors": model.bayes.priors if model.bayes else None,
        "n_features": model.bayes.n_features if model.bayes else model.space.size if model.space else 0, "scalers": [s.n_features for s in model.features.scalers],
        "tfidf": None if model.features.tfidf is None else [model.features.tfidf.n_docs, model.features.tfidf.n_terms],
    }
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.text(f"{root}/settings")


def load(spark, path: str) -> FittedPipeline:
    root = path.rstrip("/")
    settings = json.loads(spark.read.text(f"{root}/settings").first().value)
    plain = settings["spec"]
    for name in ("stop_words", "linguistic", "ngram_range", "blocks"):
        plain[name] = tuple(plain[name])
    plain["feature_steps"] = tuple(
        getattr(importlib.import_module(module), name)(**given) for module, name, given in plain["feature_steps"])
    for name, present in settings["tables"].items():
        plain[name] = spark.read.parquet(f"{root}/{name}") if present else None
    spec = PipelineSpec(**plain)
    tfidf = None
    if settings["tfidf"]:
        tfidf = terms.TfIdfModel(spark.read.parquet(f"{root}/idf"), *settings["tfidf"])
    scalers = [
        scaling.ScalerModel(spark.read.parquet(f"{root}/scaler_{i}"), n) for i, n in enumerate(settings["scalers"])
    ]
    states = [spark.read.parquet(f"{root}/state_{i}") for i in range(len(spec.feature_steps))]
    features, names, size = FeatureModel(spec, tfidf, scalers, states), settings["labels"], settings["n_features"]
    if settings["priors"] is None:
        space = vectors.VectorSpace(spark.read.parquet(f"{root}/space"), size) if size else None
        learner = learners.FittedLearner.load(f"{root}/learner", spark)
        return FittedPipeline(spec, names, features, learner=learner, space=space)
    table = bayes.LongBayesModel(spark.read.parquet(f"{root}/bayes"), size, names, settings["priors"])
    return FittedPipeline(spec, names, features, bayes=table)
