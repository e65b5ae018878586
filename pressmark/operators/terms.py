"""Documents to weighted terms: bags of n-grams, document frequencies, TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx
from ..plans.lookup import broadcast_small, lookup
from ..plans.staging import settle, shuffle_width
from . import text_bags
from .text_bags import TextBags

MIN_DF = 5


def bag_of_terms(
    docs: DataFrame, text: str = "text", carry: Sequence[str] = (), ngram_range: tuple[int, int] = (1, 2)
) -> DataFrame:
    """(doc_id, *carry, term, tf).

    The raw text, several times smaller than its exploded terms, is what moves:
    it is hashed on doc_id once, and counting, norms and scores per document
    then need no further exchange.
    """
    tokens = docs.repartition(shuffle_width(docs), "doc_id").select("doc_id", *carry, tx.vector_terms(F.col(text)).alias("tokens"))
    grams = tokens.select("doc_id", *carry, F.explode(tx.ngrams(F.col("tokens"), *ngram_range)).alias("term"))
    return grams.groupBy("doc_id", *carry, "term").agg(F.count(F.lit(1)).alias("tf"))


def bags_in_row(
    docs: DataFrame, text: str = "text", carry: Sequence[str] = (), ngram_range: tuple[int, int] = (1, 2)
) -> DataFrame:
    """As ``bag_of_terms`` for scoring: terms are counted inside their row, so no text moves.

    The sorted terms of a document are cut where a term differs from the one before it.
    """
    tokens = docs.select("doc_id", *carry, tx.vector_terms(F.col(text)).alias("tokens"))
    grams = tokens.select("doc_id", *carry, F.sort_array(tx.ngrams(F.col("tokens"), *ngram_range)).alias("g"))
    starts = F.expr("filter(transform(g, (x, i) -> if(i > 0 and x = get(g, i - 1), null, i)), i -> i is not null)")
    counted = grams.withColumn("s", starts).select(
        "doc_id", *carry, F.expr("transform(s, (b, n) -> struct(get(g, b) as term, cast(coalesce(get(s, n + 1), size(g)) - b as bigint) as tf))").alias("t"))
    # an inner generator would have its emptiness test pushed below, with every step written into the next
    return counted.select("doc_id", *carry, F.inline_outer("t")).where("term IS NOT NULL")


def document_frequency(bags: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """(term, df) of the terms that occur in at least min_df documents."""
    return bags.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)


def term_frequency_weight(tf: Column) -> Column:
    """Sublinear term frequency."""
    return F.lit(1.0) + F.log(tf.cast("double"))


def idf(df: Column, n: Column) -> Column:
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + 1.0


@dataclass
class TfIdfModel:
    """idf table (term, df, idf) plus its counted size."""

    table: DataFrame
    n_docs: int
    n_terms: int
    limit_bytes: int | None = field(default=None)
    places: DataFrame | None = field(default=None)   # the same rows with the numbers of ``bags``
    bags: TextBags | None = field(default=None)

    def weigh(self, bags: DataFrame | TextBags) -> DataFrame:
        """(doc_id, *carry, term, w): L2-normalised weights of the known terms."""
        if isinstance(bags, TextBags):
            table = self.places if bags is self.bags else self.table
            places = bags.places(table, self.n_terms, ["idf"], 80, self.limit_bytes)
            kinds = [bags.rows.schema[c].dataType for c in bags.keys]
            schema = ", ".join(f"{c} {t.simpleString()}" for c, t in zip(bags.keys, kinds))
            return bags.visit(places, text_bags.weigh_terms(bags.keys, [to_arrow_type(t) for t in kinds]), f"{schema}, term string, w double")
        carry = [c for c in bags.columns if c not in ("doc_id", "term", "tf")]
        rows = lookup(
            bags, self.table, "term", self.n_terms, frequency=F.col("df"), limit_bytes=self.limit_bytes
        ).withColumn("raw", term_frequency_weight(F.col("tf")) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
        return rows.select("doc_id", *carry, "term", (F.col("raw") / norm).alias("w"))


def fit_tfidf(bags: DataFrame | TextBags, n_docs: int, min_df: int = MIN_DF) -> TfIdfModel:
    if isinstance(bags, TextBags):
        places = bags.vocabulary(min_df).withColumn("idf", idf(F.col("df"), F.lit(float(n_docs))))
        return TfIdfModel(places.select("term", "df", "idf"), n_docs, places.count(), places=places, bags=bags)
    table = settle(
        document_frequency(bags, min_df).withColumn("idf", idf(F.col("df"), F.lit(float(n_docs))))
    )
    return TfIdfModel(table, n_docs, table.count())


def chi2_scores(weights: DataFrame, labels: DataFrame, feature: str = "term", value: str = "w") -> DataFrame:
    """(feature, chi2) of every feature against the label, for non-negative values.

    ``weights`` is long (doc_id, feature, value); ``labels`` is (doc_id, label) and
    fixes the class shares.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))  # one row per class
    all_classes = F.sum("n_label").over(Window.partitionBy(F.lit(0)))
    shares = sizes.select("label", (F.col("n_label") / all_classes).alias("share"))
    observed = (
        weights.join(broadcast_small(labels.select("doc_id", "label")), "doc_id")
        .groupBy(feature, "label").agg(F.sum(value).alias("observed"))
    )
    # classes without the feature contribute their whole expected count:
    # sum (o-e)^2/e over all classes = sum_{o>0} o^2/e - total
    with_total = observed.groupBy(feature).agg(
        F.sum("observed").alias("total"),
        F.collect_list(F.struct("label", "observed")).alias("cells"),  # at most one per class
    ).select(feature, "total", F.inline("cells"))
    return (
        with_total.join(F.broadcast(shares), "label")
        .groupBy(feature)
        .agg(
            (
                F.sum(F.col("observed") * F.col("observed") / (F.col("total") * F.col("share")))
                - F.first("total")
            ).alias("chi2")
        )
    )


def select_k_best(scores: DataFrame, k: int, feature: str = "term") -> DataFrame:
    return scores.orderBy(F.col("chi2").desc(), F.col(feature)).limit(k)
