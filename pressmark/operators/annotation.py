"""Content-addressed annotation: only texts not seen before go to the tagger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..plans.lookup import lookup
from ..plans.staging import settle

# Fixed value: longest sentence, in tokens, the tagger is given.
TAGGER_TOKENS = 250

# An annotated token in memory: two numbers and five short strings.
TOKEN_BYTES = 160

_TOKEN = "struct<sent_idx:int,tok_idx:int,word:string,lemma:string,morph:string,pos:string,ner:string>"
ANNOTATED = f"sha string, tokens array<{_TOKEN}>"


def cache_misses(docs: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """(sha, text): one row per distinct text the cache does not hold.

    Copies collapse to (sha, text) before anything is compared, on the map side.
    """
    distinct = docs.groupBy(tx.hash_text(F.col(text)).alias("sha")).agg(F.first(text).alias("text"))
    return distinct.join(cache.select("sha"), "sha", "left_anti")


def cache_hits(docs: DataFrame, cache: DataFrame, text: str = "text", limit_bytes: int | None = None) -> DataFrame:
    """Documents with their cached annotation; many copies of one text do not pile up in one task.

    An entry holds all tokens of a text, so its width is measured: the mean decides whether the
    cache is broadcast, the largest how many frequent texts are answered ahead of the shuffle.
    """
    hashed = docs.withColumn("sha", tx.hash_text(F.col(text)))
    tokens = F.size("tokens") if "tokens" in cache.columns else F.lit(1)
    rows, mean, largest = cache.agg(F.count(F.lit(1)), F.avg(tokens), F.max(tokens)).first()
    width = lambda n: 128 + TOKEN_BYTES * int(n or 0)
    return lookup(hashed, cache, "sha", rows, bytes_per_row=width(mean), limit_bytes=limit_bytes, widest_row=width(largest))


def tagger_input(misses: DataFrame) -> DataFrame:
    """(sha, text): sentences cut to the tagger's limit, joined by blanks."""
    sents = tx.split_long_sentences(tx.sentences(F.col("text")), TAGGER_TOKENS)
    return misses.select("sha", F.array_join(sents, " ").alias("text"))


def annotate(misses: DataFrame, tagger: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Run a user-supplied batch tagger: frames (sha, text) in, (sha, tokens) out."""
    return tagger_input(misses).mapInPandas(tagger, ANNOTATED)


def refresh_cache(docs: DataFrame, path: str, tagger: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                  text: str = "text") -> DataFrame:
    """The cache at ``path`` (made if there is none) after tagging the texts it lacks.

    New annotations are appended; an append that fails leaves the old entries as they were, and the next
    run tags what is still missing.  A text tagged twice by two runs keeps one entry.
    """
    spark = docs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([], ANNOTATED).write.parquet(path)
    read = lambda: spark.read.schema(ANNOTATED).parquet(path)
    annotate(cache_misses(docs, read(), text), tagger).write.mode("append").parquet(path)
    return read().dropDuplicates(["sha"])


def annotated_tokens(docs: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """tokens(doc_id, sent_idx, tok_idx, word, lemma, morph, pos, ner) without break rows."""
    rows = cache_hits(docs, cache, text).select("doc_id", F.inline("tokens"))
    return rows.dropna(how="any", subset=["word", "lemma", "morph", "pos", "ner"])


def normalise_text(docs: DataFrame, dictionary: DataFrame, text: str = "text") -> DataFrame:
    """Texts with every listed word replaced by its base form; all else stays in place.

    Each distinct form is looked up once per document, and only the listed ones come back to the text, which is
    hashed on doc_id once.  Rows of one doc_id share a text: their parts in the order of place, then part.
    """
    parts = lambda t: F.regexp_extract_all(t, F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+"), F.lit(0))
    rest = [c for c in docs.columns if c != text]
    table = settle(dictionary.select(F.lower("form").alias("form"), "base").dropDuplicates(["form"]))
    texts = docs.groupBy("doc_id").agg(F.collect_list(text).alias("_texts"))
    forms = texts.select("doc_id", F.explode(F.array_distinct(
        F.transform(F.flatten(F.transform("_texts", parts)), lambda p: F.lower(p)))).alias("form"))
    listed = lookup(forms, table, "form", table.count()).groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("form", "base"))).alias("_bases"))
    base = lambda p: F.coalesce(F.try_element_at("_bases", F.lower(p)), p)
    placed = F.sort_array(F.flatten(F.transform(
        "_texts", lambda t: F.transform(parts(t), lambda p, i: F.struct(i.alias("pos"), base(p).alias("p"))))))
    one, several = F.transform(parts(F.get("_texts", F.lit(0))), base), F.transform(placed, lambda s: s["p"])
    joined = texts.join(listed, "doc_id", "left").select(
        "doc_id", F.array_join(F.when(F.size("_texts") > 1, several).otherwise(one), "").alias(text))
    return docs.select(*rest).join(joined, "doc_id", "left").withColumn(text, F.coalesce(text, F.lit("")))
