"""Registered queries around sources, sinks and stores: the documents written in a format and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import annotation, comparison, metrics, style
from ..operators.annotation_store import AnnotationStore
from ..session import scratch_path
from ..sources import archive, corpus
from . import queries as q
from . import recipe

#: Names of the dictionary columns in the order of the output.
COLUMNS = ["de", "en", "es", "fr", "n_chars"]
ALPHAS = {"nb_smooth": 1.0, "nb": 0.1}


def lines_corpus(spark, sf):
    """Documents as labelled lines; the page number holds the document's id."""
    path = scratch_path(spark, "lines")
    day = F.make_date((F.lit(1950) + F.col("doc_id") % 40).cast("int"), (F.lit(1) + F.col("doc_id") % 12).cast("int"), F.lit(9))
    line = F.concat_ws(
        " ", F.concat(F.lit("__label__"), F.col("lang")), F.concat(F.lit("DATE="), F.date_format(day, "dd/MM/yyyy")),
        F.concat(F.lit("NEWSPAPER="), F.col("source")), F.concat(F.lit("PAGE="), F.col("doc_id").cast("string")),
        F.lit("URLS=a,b"), F.lit("text:"), tx.clean_ocr(F.col("text")))
    q.documents(spark, sf).select(line.alias("value")).write.text(path)
    rows = corpus.require_articles(corpus.read_corpus(spark, path, "lines"))
    return rows.select(
        F.col("page").cast("bigint").alias("page"), "label", F.col("year").cast("bigint").alias("year"), "newspaper",
        F.size("urls").cast("bigint").alias("n_urls"), F.md5("raw_text").alias("digest"))


def line_numbers(spark, sf):
    """Line numbers over all files are 0, 1, 2, ... without a gap."""
    path = scratch_path(spark, "numbered")
    q.documents(spark, sf).select(F.concat(F.lit("__label__"), F.col("lang"), F.lit(" x")).alias("value")).write.text(path)
    rows, _ = corpus.read_labelled_lines(spark, path)
    return rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_distinct("doc_id").alias("n"))


def strict_load(spark, sf):
    """Lines with and without a label: the strict load refuses the whole, and takes the good ones alone."""
    start = F.when(F.col("doc_id") % 7 == 3, "plain ").otherwise(F.concat(F.lit("__label__"), F.col("lang"), F.lit(" ")))
    lines = q.documents(spark, sf).select(
        start.alias("start"), F.concat(start, F.lit("text: "), tx.clean_ocr(F.col("text"))).alias("value"))
    every, good = scratch_path(spark, "lines"), scratch_path(spark, "lines")
    lines.select("value").write.text(every)
    lines.where("start <> 'plain '").select("value").write.text(good)
    try:
        corpus.read_labelled_lines(spark, every, mode="strict")
        refused = False
    except ValueError as error:
        refused = str(error).startswith("Error in line ") and str(error).endswith(": no label")
    rows, bad = corpus.read_labelled_lines(spark, every)
    strict, none = corpus.read_labelled_lines(spark, good, mode="strict")
    kept = rows.agg(F.count(F.lit(1)).alias("n_good"), F.lit(0).alias("k"))
    strict_kept = strict.agg(F.count(F.lit(1)).alias("n_strict"), F.count_distinct("label").alias("n_labels"), F.lit(0).alias("k"))
    return kept.join(strict_kept, "k").join(bad.agg(F.count(F.lit(1)).alias("n_bad"), F.lit(0).alias("k")), "k").join(
        none.agg(F.count(F.lit(1)).alias("n_none"), F.lit(0).alias("k")), "k").drop("k").withColumn("refused", F.lit(refused))


def csv_corpus(spark, sf):
    """Texts with quotes, commas and line feeds through a CSV file with a header."""
    path = scratch_path(spark, "csv")
    docs = q.documents(spark, sf).select(F.col("lang").alias("label"), F.concat(F.lit('"a", '), F.col("text")).alias("text"), "source")
    docs.write.option("header", True).option("escape", '"').csv(path)
    rows = corpus.read_corpus(spark, path, "csv")
    return rows.groupBy("label", F.md5("raw_text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def stop_word_source(spark, sf):
    """A list of one word per line, with empty lines between."""
    path = scratch_path(spark, "words")
    q.documents(spark, sf).select("source").distinct().select(F.concat("source", F.lit("\n")).alias("value")).write.text(path)
    return corpus.read_stop_words(spark, path)


def prediction_sink(spark, sf):
    """Predictions as CSV per newspaper and year, read back with the folders' values."""
    path = scratch_path(spark, "predictions")
    rows = q.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("d"), F.col("doc_id") % 7).alias("date"), F.col("lang").alias("label"),
        F.col("source").alias("newspaper"), (F.col("doc_id") % 3 + 1950).cast("int").alias("year"))
    archive.write_predictions(rows, path)
    read = spark.read.schema("id string, date string, label string, newspaper string, year int").option("header", True).csv(path)
    return read.select("id", "date", "label", "newspaper", F.col("year").cast("bigint").alias("year"))


def corpus_store(spark, sf):
    """Two sources in one store, one of them read again."""
    path = scratch_path(spark, "store")
    docs = q.documents(spark, sf).select("doc_id", F.col("lang").alias("label"), "text")
    corpus.write_corpus(docs.where("label = 'en'"), path, "english")
    corpus.write_corpus(docs.where("label <> 'en'"), path, "other")
    return corpus.read_written_corpus(spark, path, "english").select("doc_id", "label", F.md5("text").alias("digest"))


def token_store(spark, sf):
    """Annotated tokens with sentence breaks, written and read; breaks are dropped."""
    path = scratch_path(spark, "tokens")
    words = q.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", " ")).alias("tok_idx", "word"))
    blank = F.when(F.col("word") != "", F.lit("x"))
    words.select(
        "doc_id", F.lit(0).alias("sent_idx"), "tok_idx", "word", *[blank.alias(c) for c in ("lemma", "morph", "pos", "ner")]).write.parquet(path)
    return corpus.read_tokens(spark, path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))


def _tagger(mark: str):
    """A batch tagger with one token a text: the number of its letters from A to Z."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"sha": frame["sha"], "tokens": [
                [{"sent_idx": 0, "tok_idx": 0, "word": str(sum(c.isascii() and c.isalpha() for c in t)), "lemma": "", "morph": "", "pos": "", "ner": mark}]
                for t in frame["text"]]})

    return run


def annotation_store(spark, sf):
    """Miss, annotate, append, hit: half of the documents first, then all by two writers at once, then one batch again.

    The second writer found its misses before the first had committed, so both bring the same texts.
    """
    store = AnnotationStore(spark, scratch_path(spark, "annotations"))
    docs = q.articles(spark, sf).select("doc_id", "text")
    store.annotate(docs.where("doc_id % 2 = 0"), _tagger("even"))
    late = annotation.annotate(store.misses(docs), _tagger("late"))
    store.annotate(docs, _tagger("all"))
    store.append(late)
    store.compact()
    store.vacuum()
    hits = store.hits(docs)
    return hits.select("doc_id", "sha", F.col("tokens")[0]["word"].cast("bigint").alias("n_letters"), F.col("tokens")[0]["ner"].alias("writer"))


def model_store(spark, sf):
    """A fitted recipe saved, loaded and applied."""
    path = scratch_path(spark, "model")
    docs = _articles(spark, sf)
    recipe.save(recipe.fit(_spec(0.1), docs), path)
    return recipe.load(spark, path).predict(docs.drop("label"))


def chi2_bayes_cv(spark, sf):
    """Naive Bayes on the 200 terms chosen by chi2: the choice is a user's step, fitted on the training folds only."""
    spec = recipe.PipelineSpec(learner="nb", scaling=False, quote_removal=False, feature_steps=(recipe.BestByChi2(200),))
    out = recipe.cross_validate(spec, _articles(spark, sf), k=3)
    return out.select("doc_id", F.col("fold").cast("bigint").alias("fold"), "truth", "predicted")


def score_pipelines(spark, sf):
    """Fitted recipes on one corpus, in long form with the truth."""
    return _scored(spark, sf).select("doc_id", "pipeline_id", "predicted", "truth")


def score_metrics(spark, sf):
    return q._rounded(metrics.evaluate(_scored(spark, sf), "pipeline_id"), 9, ("pipeline_id",))


def score_comparison(spark, sf):
    """How often each fitted recipe is right."""
    table = comparison.comparison_table(_scored(spark, sf))
    return table.groupBy("pipeline_id", "flag").agg(F.count(F.lit(1)).alias("n"))


def _spec(alpha: float) -> recipe.PipelineSpec:
    return recipe.PipelineSpec(learner="nb", scaling=False, quote_removal=False, learner_parameters={"alpha": alpha})


def _articles(spark, sf):
    return q.spread(q.documents(spark, sf).select("doc_id", F.col("lang").alias("label"), F.col("text").alias("raw_text")))


def _scored(spark, sf):
    docs = _articles(spark, sf)
    data = recipe.training_set(_spec(0.1), docs, counted=True)   # the recipes differ in alpha only
    return recipe.score({name: data.fit({"alpha": alpha}) for name, alpha in ALPHAS.items()}, docs)


def selected_features(spark, sf):
    """The feature columns a user keeps."""
    flags = {name: name in ("digits_perc", "sentences") for name in style.BASIC}
    return q._rounded(style.select_features(style.basic_features(q.articles(spark, sf)), flags))


def dict_vectoriser(spark, sf):
    """A dictionary of named values per document as columns, 0 where a name is missing."""
    return style.map_to_columns(_dictionaries(spark, sf), COLUMNS)


def dict_keys(spark, sf):
    return style.map_keys_of(_dictionaries(spark, sf))


def _dictionaries(spark, sf):
    features = F.create_map(F.col("lang"), F.lit(1.0), F.lit("n_chars"), F.col("n_chars").cast("double"))
    return q.documents(spark, sf).select("doc_id", features.alias("features"))


QUERIES = [
    lines_corpus, line_numbers, strict_load, csv_corpus, stop_word_source, prediction_sink, corpus_store, token_store, annotation_store, model_store, chi2_bayes_cv,
    score_pipelines, score_metrics, score_comparison, selected_features, dict_vectoriser, dict_keys,
]


def registered():
    return {f.__name__: f for f in QUERIES}
