"""Style, quote, sentiment and linguistic feature blocks."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..plans.lookup import fits_broadcast, lookup, row_bytes

# Feature names and their order.
BASIC = [
    "question_marks_perc", "exclamation_marks_perc", "currency_symbols_perc", "digits_perc",
    "sentences", "avg_sentence_length",
]
QUOTE = ["direct_quotes_perc"]
SENTIMENT = ["polarity", "subjectivity"]
LINGUISTIC = [
    "adjectives_perc", "cogn_verbs_perc", "intensifiers_perc", "modal_adverbs_perc", "modal_verbs_perc",
    "named_entities_perc", "number_perc", "pronoun_1_perc", "pronoun_2_perc", "pronoun_3_perc",
    "unique_named_entities_perc",
]
STYLE = BASIC + QUOTE + SENTIMENT + LINGUISTIC

# One (category, lemma) per line, in lower case as the lookup wants them.
DUTCH_LEXICON = Path(__file__).parent.parent / "data" / "dutch_lexicon.csv"

# category -> (part-of-speech prefix or None, look the lemma up in lower case)
CATEGORIES = {
    "pronoun_1": ("VNW", False),
    "pronoun_2": ("VNW", False),
    "pronoun_3": ("VNW", False),
    "modal_verb": ("WW", True),
    "modal_adverb": ("BW", True),
    "intensifier": (None, True),
    "cogn_verb": ("WW", True),
}
_SHARE_OF = {
    "pronoun_1": "pronoun_1_perc", "pronoun_2": "pronoun_2_perc", "pronoun_3": "pronoun_3_perc",
    "modal_verb": "modal_verbs_perc", "modal_adverb": "modal_adverbs_perc",
    "intensifier": "intensifiers_perc", "cogn_verb": "cogn_verbs_perc",
}


def basic_features(docs: DataFrame, text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, ``carry`` and the six basic columns; counts are taken once per text."""
    t = F.col(text)
    counted = docs.select(
        "doc_id", *carry,
        tx.word_count(t).alias("n_words"),
        tx.sentence_count(t).alias("n_sentences"),
        F.regexp_count(t, F.lit("[?]")).alias("n_question"),
        F.regexp_count(t, F.lit("!")).alias("n_exclamation"),
        F.regexp_count(t, F.lit(tx.CURRENCY)).alias("n_currency"),
        F.regexp_count(t, F.lit(r"\p{Nd}")).alias("n_digits"),
    )
    words = F.col("n_words")
    return counted.select(
        "doc_id", *carry,
        tx.ratio(F.col("n_question"), words).alias(BASIC[0]),
        tx.ratio(F.col("n_exclamation"), words).alias(BASIC[1]),
        tx.ratio(F.col("n_currency"), words).alias(BASIC[2]),
        tx.ratio(F.col("n_digits"), words).alias(BASIC[3]),
        F.col("n_sentences").cast("double").alias(BASIC[4]),
        tx.ratio(words, F.col("n_sentences")).alias(BASIC[5]),
    )


def quote_features(docs: DataFrame, text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    t = F.col(text)
    return docs.select(
        "doc_id", *carry, tx.quote_count(t).alias("q"), tx.sentence_count(t).alias("s")
    ).select("doc_id", *carry, tx.ratio(F.col("q"), F.col("s")).alias(QUOTE[0]))


def lexicon_frame(spark, lexicon: Mapping[str, str] | None = None) -> DataFrame:
    """lexicon(category, lemma) from space-separated word lists; the Dutch lists by default."""
    if lexicon is None:
        with open(DUTCH_LEXICON, encoding="utf-8", newline="") as lines:
            rows = [(r["category"], r["lemma"]) for r in csv.DictReader(lines)]
    else:
        rows = [(category, lemma) for category, listed in lexicon.items() for lemma in listed.split()]
    return spark.createDataFrame(rows, "category string, lemma string")


def sentiment_features(docs: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """Mean polarity and subjectivity of the words found in lexicon(word, polarity, subjectivity)."""
    entries = lexicon.select(F.lower("word").alias("word"), "polarity", "subjectivity").dropDuplicates(["word"])
    listed = lexicon.count()
    if fits_broadcast(listed, row_bytes(entries)):
        # words the lexicon lacks go before anything is counted or moved
        words = docs.select("doc_id", F.explode(tx.words(F.lower(F.col(text)))).alias("word")).join(
            F.broadcast(entries.select("word")), "word", "left_semi")
    else:
        words = docs.repartition("doc_id").select("doc_id", F.explode(tx.words(F.lower(F.col(text)))).alias("word"))
    found = lookup(words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")), entries, "word", listed)
    means = found.groupBy("doc_id").agg(
        (F.sum(F.col("polarity") * F.col("n")) / F.sum("n")).alias("polarity"),
        (F.sum(F.col("subjectivity") * F.col("n")) / F.sum("n")).alias("subjectivity"),
    )
    return docs.select("doc_id").join(means, "doc_id", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SENTIMENT]
    )


def _categories_by_lemma(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy(F.lower("lemma").alias("lemma_key")).agg(
        F.collect_set("category").alias("categories")  # at most one entry per category
    )


def _in_category(category: str) -> Column:
    prefix, any_case = CATEGORIES[category]
    hit = F.array_contains("categories", category)
    if not any_case:
        hit = hit & (F.col("lemma") == F.col("lemma_key"))
    return hit if prefix is None else hit & F.col("pos").startswith(prefix)


def linguistic_features(
    tokens: DataFrame,
    docs: DataFrame,
    lexicon: DataFrame,
    text: str = "text",
    selected: Sequence[str] = tuple(LINGUISTIC),
) -> DataFrame:
    """Shares of token classes per document, divided by the word count of the text.

    ``tokens`` is (doc_id, word, lemma, pos, ner, ...); ``selected`` picks columns,
    which come out sorted by name.
    """
    table = _categories_by_lemma(lexicon)
    marked = lookup(
        tokens.select("doc_id", "lemma", "pos", "ner", F.lower("lemma").alias("lemma_key")),
        table, "lemma_key", lexicon.count(), bytes_per_row=200, how="left",
    )
    entity = F.col("ner").startswith("B")
    counts = [
        F.count(F.when(F.col("pos").startswith("TW"), 1)).alias("number_perc"),
        F.count(F.when(F.col("pos").startswith("ADJ"), 1)).alias("adjectives_perc"),
        F.count(F.when(entity, 1)).alias("named_entities_perc"),
        *[F.count(F.when(_in_category(c), 1)).alias(name) for c, name in _SHARE_OF.items()],
    ]
    # one row per (document, distinct entity lemma or none): both counts from one exchange
    per_lemma = marked.groupBy("doc_id", F.when(entity, F.lower("lemma")).alias("entity")).agg(*counts)
    summed = per_lemma.groupBy("doc_id").agg(
        F.count("entity").alias("unique_named_entities_perc"),
        *[F.sum(c).alias(c) for c in [x for x in LINGUISTIC if x != "unique_named_entities_perc"]],
    )
    sized = docs.select("doc_id", tx.word_count(F.col(text)).alias("n_words"))
    joined = sized.join(summed, "doc_id", "left")
    return joined.select(
        "doc_id",
        *[tx.ratio(F.coalesce(c, F.lit(0)), F.col("n_words")).alias(c) for c in sorted(selected)],
    )


def select_features(features: DataFrame, flags: Mapping[str, bool]) -> DataFrame:
    """Keep the flagged columns, sorted by name."""
    return features.select("doc_id", *sorted(name for name, on in flags.items() if on))


def to_long(features: DataFrame, block: str | None = None) -> DataFrame:
    """Wide numeric columns as (doc_id, feature, value), names prefixed ``block__``."""
    names = [c for c in features.columns if c != "doc_id"]
    prefix = f"{block}__" if block else ""
    return features.select(
        "doc_id",
        F.inline(F.array(*[
            F.struct(F.lit(prefix + n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names
        ])),
    )


def feature_union(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Long blocks (doc_id, feature, value) under prefixed names."""
    parts = [
        df.select("doc_id", F.concat(F.lit(f"{name}__"), "feature").alias("feature"), "value")
        for name, df in blocks.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def map_to_columns(rows: DataFrame, names: Sequence[str], column: str = "features") -> DataFrame:
    """Map column to one double column per name, 0 where the key is absent."""
    return rows.select(
        "doc_id", *[F.coalesce(F.col(column)[n], F.lit(0.0)).cast("double").alias(n) for n in names]
    )


def map_keys_of(rows: DataFrame, column: str = "features") -> DataFrame:
    """(feature): sorted distinct keys of a map column."""
    return rows.select(F.explode(F.map_keys(column)).alias("feature")).distinct().orderBy("feature")


# --- named entities and characters --------------------------------------------------


def entity_frequency(tokens: DataFrame, by: str = "lemma") -> DataFrame:
    return (
        tokens.where(F.col("ner").startswith("B")).groupBy(F.col(by).alias("entity"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def entity_strings(tokens: DataFrame) -> DataFrame:
    """(doc_id, entities, maximal, contained): distinct lower-cased entity strings of a
    document, those not part of another one, and the rest.

    All strings of a document joined by newlines are searched once per string: a
    maximal one occurs there exactly once.
    """
    per_doc = (
        tokens.where(F.col("ner").startswith("B"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_set(F.lower("lemma"))).alias("entities"))
        .withColumn("joined", F.array_join("entities", "\n"))
    )
    once = lambda e: F.length("joined") - F.length(F.replace(F.col("joined"), e, F.lit(""))) == F.length(e)
    maximal = per_doc.withColumn("maximal", F.filter("entities", lambda e: (F.length(e) > 0) & once(e)))
    return maximal.select("doc_id", "entities", "maximal", F.array_except("entities", "maximal").alias("contained"))


def character_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    return (
        docs.select(F.explode(F.split(F.col(text), "")).alias("character")).where(F.col("character") != "")
        .groupBy("character").agg(F.count(F.lit(1)).alias("n"))
    )
