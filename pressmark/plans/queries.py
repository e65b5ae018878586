"""The registered queries: every operator over the whole given tables.

Each function takes (spark, sf_dir) and returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import abbreviations, annotation, bayes, comparison, folds, labels, metrics, scaling, stems, style, terms
from ..operators.text_bags import TextBags
from ..sources import archive, corpus
from .search import NB_ALPHAS, top_candidates
from .staging import keep, spread

# Query parameters shared with the SQL side.
STOP_WORDS = ["the", "and", "of", "le", "la", "les", "de", "der", "die", "und", "el", "los", "que"]
LEXICON = {
    "pronoun_1": "me we", "pronoun_2": "tu you", "pronoun_3": "he she it",
    "modal_verb": "the und el", "modal_adverb": "of les", "intensifier": "la der and", "cogn_verb": "le die que",
}
SENTIMENT_ROWS = [
    ("the", 0.1, 0.2), ("and", -0.3, 0.4), ("le", 0.5, 0.9), ("la", -0.25, 0.75), ("und", 0.6, 0.1),
    ("die", -0.9, 1.0), ("el", 0.2, 0.3), ("que", -0.1, 0.05),
]
NEXT_LABEL = {"en": "fr", "fr": "de", "de": "es", "es": "en"}
PIPELINES = ["p0", "p1", "p2"]
ALPHAS = list(NB_ALPHAS)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def articles(spark, sf) -> DataFrame:
    """Cleaned corpus: (doc_id, label, text)."""
    rows = spread(documents(spark, sf).select("doc_id", F.col("lang").alias("label"), "text"))
    return rows.withColumn("text", tx.clean_ocr(F.col("text")))


def encoded(docs: DataFrame, names: list[str]) -> DataFrame:
    """Label index from the (small) label list, without a join."""
    return docs.withColumn(
        "label_idx", (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label")) - 1).cast("int")
    )


# --- text functions -------------------------------------------------------------------


def clean_ocr(spark, sf):
    return articles(spark, sf).select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n"))


def style_basic(spark, sf):
    return _rounded(style.basic_features(articles(spark, sf)))


def _rounded(df: DataFrame, digits: int = 9, but: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return df.select(*[c if c in but else F.round(c, digits).alias(c) for c in df.columns])


def quote_ratio(spark, sf):
    return style.quote_features(articles(spark, sf))


def remove_quotes(spark, sf):
    return articles(spark, sf).select(
        "doc_id", tx.quote_count(F.col("text")).alias("n_quotes"), F.md5(tx.remove_quotes(F.col("text"))).alias("digest")
    )


def stop_words(spark, sf):
    out = tx.remove_stop_words(F.col("text"), STOP_WORDS)
    return articles(spark, sf).select("doc_id", F.md5(out).alias("digest"))


def lowercase(spark, sf):
    return articles(spark, sf).select("doc_id", F.md5(tx.lowercase(F.col("text"))).alias("digest"))


def sentence_split(spark, sf):
    return articles(spark, sf).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.trim("sentence").alias("sentence")
    )


def _abbreviated(spark, sf):
    """The corpus with two words written as abbreviations, one of them with inner full stops."""
    text = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" nr. ")), F.lit(" la "), F.lit(" s.v. "))
    return articles(spark, sf).withColumn("text", text)


def abbreviation_list(spark, sf):
    return _rounded(abbreviations.learn(_abbreviated(spark, sf)), 6, ("type", "n", "n_stop"))


def abbreviation_sentences(spark, sf):
    """Sentences that learned abbreviations do not end."""
    docs = _abbreviated(spark, sf)
    rows = abbreviations.with_sentences(docs, abbreviations.known(abbreviations.learn(docs)))
    return rows.select("doc_id", F.size("sentences").cast("bigint").alias("n"), F.md5(F.array_join("sentences", "|")).alias("digest"))


def word_stems(spark, sf):
    """Every distinct word with its stem by rules."""
    return stems.stem_table(articles(spark, sf))


def long_sentences(spark, sf):
    chunks = tx.split_long_sentences(tx.sentences(F.col("text")), 10)
    return articles(spark, sf).select("doc_id", F.posexplode(chunks).alias("pos", "chunk")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "chunk"
    )


def character_frequency(spark, sf):
    return style.character_frequency(spread(documents(spark, sf).select("doc_id", "text")))


def normalise_text(spark, sf):
    docs = articles(spark, sf)
    dictionary = _dictionary(docs)
    return annotation.normalise_text(docs.select("doc_id", "text"), dictionary).select("doc_id", F.md5("text").alias("digest"))


def _dictionary(docs: DataFrame) -> DataFrame:
    """(form, base): words with a common ending lose it."""
    forms = docs.select(F.explode(tx.vector_terms(F.col("text"))).alias("form")).distinct()
    return forms.where(F.col("form").rlike("(tion|ung|ment)$")).select(
        "form", F.regexp_replace("form", "(tion|ung|ment)$", "").alias("base")
    )


# --- corpora --------------------------------------------------------------------------


def rendered_lines(spark, sf) -> DataFrame:
    """Documents as labelled lines."""
    day = F.format_string("%02d/%02d/%d", (F.col("doc_id") % 28 + 1).cast("int"), (F.col("doc_id") % 12 + 1).cast("int"),
                          (F.col("doc_id") % 40 + 1950).cast("int"))
    return spread(documents(spark, sf)).select(
        "doc_id",
        F.concat_ws(
            " ", F.concat(F.lit("__label__"), "lang"), F.concat(F.lit("DATE="), day),
            F.concat(F.lit("NEWSPAPER="), "source"), F.concat(F.lit("PAGE="), (F.col("doc_id") % 30).cast("string")),
            F.concat(F.lit("LENGTH="), F.col("n_chars").cast("string")),
            F.concat(F.lit("URLS=http://a/"), F.col("doc_id").cast("string"), F.lit(",http://b/"), F.col("doc_id").cast("string")),
            tx.clean_ocr(F.col("text")),
        ).alias("value"),
    )


def labelled_line_parse(spark, sf):
    parsed = corpus.parse_labelled_lines(rendered_lines(spark, sf))
    return parsed.where(F.col("error").isNull()).select(
        "doc_id", "label", F.date_format("date", "yyyy-MM-dd").alias("date"), "year", "newspaper", "page",
        F.array_join("urls", "|").alias("urls"), F.md5("raw_text").alias("digest"),
    )


def label_dictionary(spark, sf):
    return labels.label_dictionary(documents(spark, sf), "lang").select(F.col("label_idx").cast("bigint").alias("label_idx"), "label")


def label_encode(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("lang").alias("label"))
    return labels.encode_labels(docs, labels.label_dictionary(docs)).select(
        "doc_id", "label", F.col("label_idx").cast("bigint").alias("label_idx")
    )


def label_decode(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("lang").alias("label"))
    dictionary = labels.label_dictionary(docs)
    idx = labels.encode_labels(docs, dictionary).select("doc_id", "label_idx")
    return labels.decode_labels(idx, dictionary).select("doc_id", "label")


def label_by_year(spark, sf):
    orders = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("label"))
    return labels.label_distribution(orders)


def label_by_year_events(spark, sf):
    events = table(spark, sf, "events").select(F.year("ts").alias("year"), F.col("event_type").alias("label"))
    return labels.label_distribution(events)


def corpus_size(spark, sf):
    return labels.corpus_size(documents(spark, sf))


def duplicate_texts(spark, sf):
    return labels.duplicate_count(documents(spark, sf), "text")


# --- folds ----------------------------------------------------------------------------


def kfold(spark, sf):
    return folds.shuffled_folds(documents(spark, sf).select("doc_id")).select("doc_id", F.col("fold").cast("bigint").alias("fold"))


def stratified_kfold(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("lang").alias("label"))
    return folds.stratified_folds(docs).select("doc_id", "label", F.col("fold").cast("bigint").alias("fold"))


def holdout_split(spark, sf):
    return folds.holdout(documents(spark, sf).select("doc_id")).select("doc_id", F.col("is_test").cast("int").alias("is_test"))


# --- terms ----------------------------------------------------------------------------


def _bags(spark, sf, carry=()):
    return TextBags(articles(spark, sf), carry)


def term_df(spark, sf):
    return terms.document_frequency(terms.bag_of_terms(articles(spark, sf)))


def _fit_tfidf(spark, sf):
    bags = _bags(spark, sf)
    return bags, terms.fit_tfidf(bags, documents(spark, sf).count())


def tfidf_weights(spark, sf):
    bags, model = _fit_tfidf(spark, sf)
    return _rounded(model.weigh(bags), 6, ("doc_id", "term"))


def _as_features(weights: DataFrame) -> DataFrame:
    return weights.select("doc_id", F.col("term").alias("feature"), F.col("w").alias("value"))


def tfidf_scaled(spark, sf):
    bags, model = _fit_tfidf(spark, sf)
    features = _as_features(model.weigh(bags))  # counted again in every pass: the texts are far smaller
    scaler = scaling.fit_iqr_scaler(features, model.n_docs)
    return _rounded(scaler.transform(features), 6, ("doc_id", "feature"))


def chi2_select(spark, sf):
    bags, model = _fit_tfidf(spark, sf)
    scores = terms.chi2_scores(model.weigh(bags), articles(spark, sf).select("doc_id", "label"))
    best = terms.select_k_best(scores.withColumn("chi2", F.round("chi2", 6)), 100)
    return best.select("term", "chi2")


# --- scaling and feature blocks -------------------------------------------------------


def embedding_features(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "embeddings")).select(
        F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("i", "value")
    ).select("doc_id", F.format_string("e%02d", "i").alias("feature"), F.col("value").cast("double").alias("value"))


def robust_scale(spark, sf):
    features = embedding_features(spark, sf)
    return _rounded(scaling.fit_iqr_scaler(features).transform(features), 6, ("doc_id", "feature"))


def minmax_scale(spark, sf):
    features = embedding_features(spark, sf)
    return _rounded(scaling.fit_unit_range_scaler(features).transform(features), 6, ("doc_id", "feature"))


def sentiment_lexicon(spark) -> DataFrame:
    return spark.createDataFrame(SENTIMENT_ROWS, "word string, polarity double, subjectivity double")


def sentiment(spark, sf):
    return _rounded(style.sentiment_features(articles(spark, sf), sentiment_lexicon(spark)))


def token_table(spark, sf) -> DataFrame:
    """Annotated tokens derived from the texts: tags follow from the word itself."""
    split = articles(spark, sf).select("doc_id", F.posexplode(tx.words(F.col("text"))).alias("tok_idx", "word"))
    first = F.substring(F.md5("word"), 1, 1)
    tag = (
        F.when(F.col("word").rlike("^[0-9]+$"), "TW(hoofd)").when(first < "4", "WW(pv)").when(first < "8", "ADJ(prenom)")
        .when(first < "a", "BW()").when(first < "d", "VNW(pers)").otherwise("N(soort)")
    )
    begins = F.col("word").rlike("^[A-Z]")
    return split.select(
        "doc_id", "tok_idx", "word",
        F.when(first < "8", F.lower("word")).otherwise(F.col("word")).alias("lemma"),
        tag.alias("pos"), F.when(begins, "B-PER").otherwise("O").alias("ner"),
    )


def linguistic(spark, sf):
    features = style.linguistic_features(token_table(spark, sf), articles(spark, sf), style.lexicon_frame(spark, LEXICON))
    return _rounded(features)


def entity_frequency(spark, sf):
    return style.entity_frequency(token_table(spark, sf))


def maximal_entities(spark, sf):
    found = style.entity_strings(token_table(spark, sf))
    return found.select(
        "doc_id", F.size("entities").cast("bigint").alias("n_entities"),
        F.array_join("maximal", "|").alias("maximal"), F.array_join("contained", "|").alias("contained"),
    )


def style_vector(spark, sf):
    """All 20 style features as long rows with block names."""
    docs = keep(articles(spark, sf))
    blocks = {
        "Basic": style.basic_features(docs),
        "Quote": style.quote_features(docs),
        "Sentiment": style.sentiment_features(docs, sentiment_lexicon(spark)),
        "Linguistic": style.linguistic_features(token_table(spark, sf), docs, style.lexicon_frame(spark, LEXICON)),
    }
    union = style.feature_union({name: style.to_long(block) for name, block in blocks.items()})
    return _rounded(union, 9, ("doc_id", "feature"))


def feature_union(spark, sf):
    """Basic and TF-IDF blocks side by side in long form."""
    bags, model = _fit_tfidf(spark, sf)
    union = style.feature_union({
        "Basic": style.to_long(style.basic_features(articles(spark, sf))),
        "TFIDF": _as_features(model.weigh(bags)),
    })
    return _rounded(union, 6, ("doc_id", "feature"))


# --- annotation cache -----------------------------------------------------------------


def _cached_texts(spark, sf) -> DataFrame:
    """The annotated part of the corpus: texts of the documents with a quality label."""
    annotated = documents(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return annotated.select(tx.hash_text(F.col("text")).alias("sha")).distinct()


def cache_misses(spark, sf):
    return annotation.cache_misses(documents(spark, sf), _cached_texts(spark, sf)).select("sha")


def cache_hits(spark, sf):
    cache = _cached_texts(spark, sf).withColumn("n_tokens", F.lit(1).cast("bigint"))
    return annotation.cache_hits(documents(spark, sf).select("doc_id", "text"), cache).select("doc_id", "sha")


# --- naive Bayes ----------------------------------------------------------------------


def _bayes(spark, sf, n_folds: int | None = 10, fold=folds.shuffled_folds, scaled=False, alphas=None):
    docs = articles(spark, sf)
    names = labels.label_list(docs)
    docs = encoded(docs, names)
    carry = ["label_idx"]
    if n_folds:
        docs = fold(docs, n_folds)
        carry.append("fold")
    bags = TextBags(docs, carry)
    held = list(range(n_folds)) if n_folds else [None]
    stats = bayes.fit_text_bayes(bags, docs.select("doc_id", *carry), names, held, scaling=scaled)
    return docs, bags, stats


def nb_predict(spark, sf):
    docs, bags, stats = _bayes(spark, sf, None)
    return stats.model().predict(bags, docs, ["label"])


def nb_scaled_predict(spark, sf):
    docs, bags, stats = _bayes(spark, sf, None, scaled=True)
    scores = stats.model().scores(bags, docs, ["label"])
    return scores.select("doc_id", bayes.argmax_label(stats.labels).alias("predicted"), F.round("score_0", 4).alias("score_0"))


def nb_proba(spark, sf):
    docs, bags, stats = _bayes(spark, sf, None)
    proba = stats.model().predict_proba(bags, docs)
    return proba.select("doc_id", *[F.round(F.col("proba")[i], 6).alias(f"p_{n}") for i, n in enumerate(stats.labels)])


def nb_cv_predictions(spark, sf, scaled=False):
    docs, bags, stats = _bayes(spark, sf, scaled=scaled)
    out = stats.model().predict(bags, docs, ["fold", "label"])
    return out.select("doc_id", F.col("fold").cast("bigint").alias("fold"), F.col("label").alias("truth"), "predicted")


def nb_cv_scaled(spark, sf):
    return nb_cv_predictions(spark, sf, scaled=True)


def nb_cv_metrics(spark, sf):
    return _rounded(metrics.evaluate(keep(nb_cv_predictions(spark, sf))), 9, ())


def nb_quality_predict(spark, sf):
    """Second label set: quality of the labelled part of the corpus, scored on all documents."""
    docs = articles(spark, sf).select("doc_id", "text")
    known = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    names = labels.label_list(known)
    train = encoded(docs.join(known, "doc_id"), names)
    # only the labelled part is counted by row: a document counts once for every row of its label
    bags = terms.bag_of_terms(docs.join(known.select("doc_id"), "doc_id", "left_semi"))
    train_bags = keep(bags.join(train.select("doc_id", "label_idx"), "doc_id"))
    stats = bayes.fit_text_bayes(train_bags, train.select("doc_id", "label_idx"), names)
    return stats.model().predict(TextBags(docs), docs)


def nb_grid(spark, sf):
    from .search import naive_bayes_grid

    docs = articles(spark, sf)
    return _rounded(naive_bayes_grid(docs, ALPHAS), 9, ("candidate_id", "alpha", "rank"))


def nb_grid_top(spark, sf):
    """The report of the same search: ranks 1 to 3, ties included."""
    return top_candidates(nb_grid(spark, sf))


def bulk_score(spark, sf):
    """Documents as archive lines, parsed, scored and decoded to the sink's columns."""
    docs = spread(documents(spark, sf))
    lines = docs.select(
        F.col("source").alias("newspaper"), (F.col("doc_id") % 40 + 1950).cast("int").alias("year"),
        F.concat_ws("\t", F.col("doc_id").cast("string"), F.lit("x"), F.lit("y"),
                    F.concat(F.lit("DATE="), (F.col("doc_id") % 40 + 1950).cast("string")),
                    tx.clean_ocr(F.col("text"))).alias("value"),
    )
    rows = archive.parse_archive_lines(lines)
    _, _, stats = _bayes(spark, sf, None)
    incoming = rows.select(F.col("id").cast("bigint").alias("doc_id"), "id", "date", tx.clean_ocr(F.col("raw_text")).alias("text"))
    predicted = stats.model().predict(TextBags(incoming), incoming, ["id", "date"])
    return predicted.select("id", "date", F.col("predicted").alias("label"))


# --- evaluation and comparison --------------------------------------------------------


def _pseudo(label: Column, key: Column, name: str) -> Column:
    """A stand-in pipeline: right on 10 of 16 documents, else the next label."""
    other = F.lit(None).cast("string")
    for a, b in NEXT_LABEL.items():
        other = F.when(label == a, F.lit(b)).otherwise(other)
    digit = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{name}"))), 1, 1)
    return F.when(digit < "a", label).otherwise(other)


def predictions(spark, sf, unlabelled=False) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "lang")
    truth = F.col("lang")
    if unlabelled:
        known = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("known"))
        docs = docs.join(known, "doc_id", "left")
        truth = F.when(F.col("known") == 1, F.col("lang")).otherwise(F.lit(labels.UNLABELLED))
    # one pass over the documents; every document yields one row per pipeline
    per_doc = docs.select("doc_id", truth.alias("truth"), F.inline(F.array(*[
        F.struct(F.lit(p).alias("pipeline_id"), F.lit(i).alias("pipeline_idx"),
                 _pseudo(F.col("lang"), F.col("doc_id"), p).alias("predicted"))
        for i, p in enumerate(PIPELINES)
    ])))
    return per_doc


def confusion(spark, sf):
    counts = metrics.confusion(predictions(spark, sf), ["pipeline_id"])
    dense = metrics.dense_confusion(counts, labels.label_list(documents(spark, sf), "lang"), ["pipeline_id"])
    return dense.select("pipeline_id", "truth", "predicted", F.col("n").cast("bigint").alias("n"))


def confusion_norm(spark, sf):
    normalised = metrics.normalised_confusion(confusion(spark, sf), ["pipeline_id"])
    return normalised.select("pipeline_id", "truth", "predicted", F.round("share", 9).alias("share"))


def class_support(spark, sf):
    return metrics.class_support(confusion(spark, sf), ["pipeline_id"])


def pipeline_metrics(spark, sf):
    return _rounded(metrics.evaluate(predictions(spark, sf), "pipeline_id"), 9, ("pipeline_id",))


def percent_scores(spark, sf):
    results = metrics.evaluate(predictions(spark, sf), "pipeline_id")
    return metrics.as_percent(results)


def metric_compare(spark, sf):
    results = metrics.evaluate(predictions(spark, sf), "pipeline_id")
    return _rounded(metrics.compare_metrics(results), 9, ("pipeline_id", "metric"))


def accuracy(spark, sf):
    return _rounded(metrics.plain_accuracy(predictions(spark, sf), ["pipeline_id"]), 9, ("pipeline_id",))


def comparison_long(spark, sf):
    return comparison.comparison_table(predictions(spark, sf, unlabelled=True))


def comparison_wide(spark, sf):
    return comparison.wide_predictions(predictions(spark, sf), PIPELINES)


def agreement_sets(spark, sf):
    return comparison.agreement_sets(predictions(spark, sf, unlabelled=True))


def agreement_members(spark, sf):
    return comparison.agreement_members(predictions(spark, sf, unlabelled=True))


def majority_vote(spark, sf):
    return comparison.majority_vote(predictions(spark, sf, unlabelled=True))


CORE = [
    clean_ocr, style_basic, quote_ratio, remove_quotes, stop_words, lowercase, sentence_split, abbreviation_list, abbreviation_sentences, word_stems, long_sentences,
    character_frequency, normalise_text, labelled_line_parse, label_dictionary, label_encode, label_decode,
    label_by_year, label_by_year_events, corpus_size, duplicate_texts, kfold, stratified_kfold, holdout_split,
    term_df, tfidf_weights, tfidf_scaled, chi2_select, robust_scale, minmax_scale, sentiment, linguistic,
    entity_frequency, maximal_entities, style_vector, feature_union, cache_misses, cache_hits,
    nb_predict, nb_scaled_predict, nb_proba, nb_cv_predictions, nb_cv_scaled, nb_cv_metrics, nb_quality_predict,
    nb_grid, nb_grid_top, bulk_score, confusion, confusion_norm, class_support, pipeline_metrics, percent_scores, metric_compare,
    accuracy, comparison_long, comparison_wide, agreement_sets, agreement_members, majority_vote,
]


def registered():
    return {f.__name__: f for f in CORE}
