"""Multinomial naive Bayes as grouped sums and one lookup join.

``FoldedTextBayes`` trains TF-IDF + (optional) inter-quartile scaling + naive
Bayes for several training sets at once.  Each training set is "all documents
but fold v" (or all documents), so the term table is read once with one column
per training set, not exploded k - 1 times:

  norms    |d|_v = sqrt(sum_t (l * idf_v)^2)          per document
  sums     S[c,t,v] = idf_v(t) * sum_{d in c} l/|d|_v  per (term, label)
  scores   (1/|d|) * sum_t l * idf_v(t) * logp[c,t,v]  per document

with l = 1 + ln(tf).  idf_v, the norms and the sums are fitted per training set,
so nothing of a held-out fold leaks into its model.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.lookup import broadcast_small, fits_broadcast, lookup
from ..plans.quantiles import exact_quantiles
from ..plans.staging import keep, settle, stored
from . import text_bags
from .explain import BagProba, ProbaFn
from .text_bags import TextBags
from .terms import MIN_DF, idf as idf_of, term_frequency_weight

ALPHA = 0.1
MIN_ALPHA = 1e-10


def _in_training(v: int | None) -> Column:
    return F.lit(True) if v is None else F.col("fold") != F.lit(v)


@dataclass
class TextBayesModel:
    """Fitted tables: (term, df, idf[v], lp[v][c]) and log priors[v][c]."""

    table: DataFrame
    n_terms: int
    labels: list[str]
    priors: list[list[float]]
    held_out: list[int | None]
    limit_bytes: int | None = field(default=None)
    bags: TextBags | None = field(default=None)   # the texts whose blocks the table's places name

    @property
    def bytes_per_row(self) -> int:
        return 80 + 8 * len(self.held_out) * (len(self.labels) + 1)

    def _block_sums(self, bags: TextBags) -> DataFrame:
        """(doc_id, norm, s0, ...) of texts; of a folded block only its own fold's numbers travel."""
        n = len(self.labels)
        table = self.table if bags is self.bags else self.table.drop("blocks", "cols")
        if self.held_out == [None]:
            entries = table.withColumns({"idf": F.col("idf")[0], "lp": F.col("lp")[0]})
            places = bags.places(entries, self.n_terms, ["idf", "lp"], 80 + 8 * (n + 1), self.limit_bytes)
        else:
            # every block holds one fold: the entry of that fold's training set is all it needs
            at = bags.rows.groupBy("block").agg(F.first("fold").cast("int").alias("fold"))  # one row per block
            entries = bags.places(table, self.n_terms, ["idf", "lp"], self.bytes_per_row, self.limit_bytes)
            places = entries.join(F.broadcast(at), "block").select(
                "block", "col", F.element_at("idf", F.col("fold") + 1).alias("idf"), F.element_at("lp", F.col("fold") + 1).alias("lp"))
        places = places.where("idf IS NOT NULL AND lp IS NOT NULL")
        kind = bags.rows.schema["doc_id"].dataType
        sums = bags.visit(places, text_bags.score_sums(n, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, norm double, s array<double>")
        return sums.select("doc_id", "norm", *[F.col("s")[c].alias(f"s{c}") for c in range(n)])

    def scores(self, bags: DataFrame | TextBags, docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """(doc_id, *carry, score_0..score_{C-1}): joint log likelihood per class.

        Every document of ``docs`` survives; one without a known term keeps the
        prior.  With folds, each document is scored by the model that did not see
        its fold (column ``fold`` of ``bags`` and ``docs``).
        """
        folded = self.held_out != [None]
        which = F.col("fold") + 1 if folded else F.lit(1)
        group = ["doc_id", "fold"] if folded else ["doc_id"]
        if isinstance(bags, TextBags):
            return self._scored(self._block_sums(bags), docs, carry, group, which)
        keys = F.col("tf").isNotNull()
        rows = lookup(
            bags.select(*group, "term", "tf").where(keys), self.table, "term", self.n_terms,
            bytes_per_row=self.bytes_per_row, frequency=F.col("df"), limit_bytes=self.limit_bytes,
        ).select(
            *group,
            (term_frequency_weight(F.col("tf")) * F.element_at("idf", which)).alias("x"),
            F.element_at("lp", which).alias("p"),
        )
        summed = rows.groupBy(*group).agg(
            F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
            *[F.sum(F.col("x") * F.col("p")[c]).alias(f"s{c}") for c in range(len(self.labels))],
        ).drop("fold")
        return self._scored(summed, docs, carry, group, which)

    def _scored(self, summed: DataFrame, docs: DataFrame, carry: Sequence[str], group: Sequence[str], which: Column) -> DataFrame:
        wanted = docs.select("doc_id", *dict.fromkeys([*carry, *group[1:]]))
        joined = wanted.join(summed, "doc_id", "left")
        prior = F.array(*[F.array(*[F.lit(p) for p in per_v]) for per_v in self.priors])
        out = [
            (F.element_at(prior, which)[c] + F.coalesce(F.try_divide(f"s{c}", "norm"), F.lit(0.0))).alias(f"score_{c}")
            for c in range(len(self.labels))
        ]
        return joined.select("doc_id", *carry, *out)

    def predict(self, bags: DataFrame, docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """(doc_id, *carry, predicted): best class, the first label wins ties."""
        return self.scores(bags, docs, carry).select("doc_id", *carry, argmax_label(self.labels).alias("predicted"))

    def predict_proba(self, bags: DataFrame, docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """(doc_id, *carry, proba ARRAY in label order)."""
        return self.scores(bags, docs, carry).select("doc_id", *carry, softmax(len(self.labels)).alias("proba"))

    def bag_proba(self, by_rows: ProbaFn) -> BagProba:
        """The model of all documents for explanations; ``by_rows`` is ``predict_proba`` over texts."""
        table = self.table.select("term", "df", F.col("idf")[0].alias("idf"), F.col("lp")[0].alias("lp"))

        def known(rows: DataFrame) -> DataFrame:
            found = lookup(
                rows, table, "term", self.n_terms, bytes_per_row=self.bytes_per_row, frequency=F.col("df"), limit_bytes=self.limit_bytes)
            return found.where("idf IS NOT NULL").drop("term", "df")

        return BagProba(known, self.priors[0], by_rows)


def argmax_label(labels: Sequence[str], prefix: str = "score_", first: int = 0) -> Column:
    columns = [F.col(f"{prefix}{first + c}") for c in range(len(labels))]
    best = F.greatest(*columns) if len(columns) > 1 else columns[0]
    out = F.lit(labels[-1])
    for name, column in reversed(list(zip(labels, columns))):
        out = F.when(column == best, F.lit(name)).otherwise(out)
    return out


def softmax(n: int, prefix: str = "score_") -> Column:
    columns = [F.col(f"{prefix}{c}") for c in range(n)]
    best = F.greatest(*columns) if n > 1 else columns[0]
    powers = [F.exp(c - best) for c in columns]
    total = sum(powers[1:], powers[0])
    return F.array(*[p / total for p in powers])


@dataclass
class TextBayesStatistics:
    """What training needs whatever alpha is: sums per (term, label) and totals."""

    idf: DataFrame            # term, df, idf array, scale array
    sums: DataFrame           # term, s map label_idx -> array of sums per training set
    n_terms: int
    vocabulary: list[int]     # terms per training set
    totals: list[list[float]]  # [v][c] sum of all weights
    documents: list[list[int]]  # [v][c]
    labels: list[str]
    held_out: list[int | None]
    bags: TextBags | None = None

    def model(self, alpha: float = ALPHA) -> TextBayesModel:
        return self.models([alpha])

    def models(self, alphas: Sequence[float]) -> TextBayesModel:
        """One model for several alphas: its classes are the classes under the first alpha, then the second, ..."""
        k, n_labels = len(self.held_out), len(self.labels)
        per_v = []
        for v in range(k):
            logs = []
            for a in (max(alpha, MIN_ALPHA) for alpha in alphas):
                for c in range(n_labels):
                    denominator = math.log(self.totals[v][c] + a * self.vocabulary[v])
                    seen = F.coalesce(F.col("s")[F.lit(c)][v], F.lit(0.0))
                    logs.append(F.log(seen + a) - F.lit(denominator))
            per_v.append(F.array(*logs))
        table = (settle if self.bags is None else stored)(
            self.idf.join(self.sums, "term", "left").select(
                "term", "df", *([] if self.bags is None else ["blocks", "cols"]),
                F.zip_with("idf", "scale", lambda i, s: i).alias("idf"),
                # scores divide by the norm of the unscaled weights
                F.zip_with(F.array(*per_v), "scale", lambda p, s: F.transform(p, lambda x: x / s)).alias("lp"),
            )
        )
        priors = [
            [math.log(n) - math.log(sum(per)) if n else -math.inf for n in per] * len(alphas) for per in self.documents
        ]
        return TextBayesModel(table, self.n_terms, self.labels * len(alphas), priors, self.held_out, bags=self.bags)


def _sizes(docs: DataFrame, group: Sequence[str], held: Sequence[int | None], n_labels: int) -> list[list[int]]:
    """Documents per training set and label."""
    sizes = docs.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).collect()  # labels x folds rows
    return [[sum(r.n for r in sizes if r.label_idx == c and (v is None or r.fold != v)) for c in range(n_labels)] for v in held]


def _fold_idf(bags: DataFrame, n_docs: Sequence[int], held: Sequence[int | None], min_df: int):
    """(term, df, idf, dfs) with one entry per training set, and the sizes of the vocabularies."""
    k = len(held)
    if isinstance(bags, TextBags):
        known = [F.when(F.col("dfs")[i] >= min_df, idf_of(F.col("dfs")[i], F.lit(float(n)))) for i, n in enumerate(n_docs)]
        idf_table = bags.vocabulary(min_df, held).withColumn("idf", F.array(*known))
        return idf_table, _vocabulary_sizes(idf_table, k)
    # document frequency per training set: one pass, k conditional counts
    counts = bags.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        *[F.count(F.when(_in_training(v), 1)).alias(f"df{i}") for i, v in enumerate(held)],
    )
    known = [F.when(F.col(f"df{i}") >= min_df, idf_of(F.col(f"df{i}"), F.lit(float(n)))) for i, n in enumerate(n_docs)]
    kept_any = F.greatest(*[F.col(f"df{i}") for i in range(k)], F.lit(0)) >= min_df
    idf_table = settle(
        counts.where(kept_any).select(
            "term", "df", F.array(*known).alias("idf"), F.array(*[F.col(f"df{i}") for i in range(k)]).alias("dfs")
        )
    )
    return idf_table, _vocabulary_sizes(idf_table, k)


def _vocabulary_sizes(idf_table: DataFrame, k: int):
    return idf_table.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.col("idf")[i]).alias(f"n{i}") for i in range(k)]
    ).first()


def _fold_norms(bags: DataFrame, idf_table: DataFrame, n_terms: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The bags' known terms with idf, and (doc_id, norm0, norm1, ...) per training set."""
    local = term_frequency_weight(F.col("tf"))
    known_bags = lookup(
        bags, idf_table.select("term", "df", "idf"), "term", n_terms, bytes_per_row=80 + 8 * k, frequency=F.col("df")
    )
    squares = [F.sum((local * F.col("idf")[i]) * (local * F.col("idf")[i])).alias(f"q{i}") for i in range(k)]
    norms = known_bags.groupBy("doc_id").agg(*squares).select(
        "doc_id", *[F.sqrt(f"q{i}").alias(f"norm{i}") for i in range(k)]
    )
    return known_bags, norms


def fold_weights(
    bags: DataFrame, docs: DataFrame, held_out: Sequence[int | None], n_labels: int, min_df: int = MIN_DF, scaling: bool = True
) -> tuple[DataFrame, int, list[list[int]]]:
    """((term, df, idf, scale) with one entry per training set, number of terms, documents per training set and label)."""
    held = list(held_out)
    documents = _sizes(docs, ["label_idx", "fold"], held, n_labels)
    n_docs = [sum(per) for per in documents]
    idf_table, stats = _fold_idf(bags, n_docs, held, min_df)
    norms = None
    if not isinstance(bags, TextBags):
        _, norms = _fold_norms(bags, idf_table, stats["n"], len(held))
    table = _with_scale(idf_table, bags, keep(norms) if scaling and norms is not None else norms, docs, held, n_docs, scaling, min_df)
    return settle(table.select("term", "df", "idf", "scale")), stats["n"], documents


def fit_text_bayes(
    bags: DataFrame | TextBags,
    docs: DataFrame,
    labels: Sequence[str],
    held_out: Sequence[int | None] = (None,),
    min_df: int = MIN_DF,
    scaling: bool = False,
) -> TextBayesStatistics:
    """Sufficient statistics for every training set named in ``held_out``.

    ``bags`` is (doc_id, label_idx[, fold], term, tf), partitioned by doc_id and
    kept by the caller, or the texts as ``TextBags``, whose terms are counted in their block and never move one
    by one; ``docs`` holds (doc_id, label_idx[, fold]).
    """
    held = list(held_out)
    folded = held != [None]
    k = len(held)
    group = ["label_idx", "fold"] if folded else ["label_idx"]
    documents = _sizes(docs, group, held, len(labels))
    n_docs = [sum(per) for per in documents]
    idf_table, stats = _fold_idf(bags, n_docs, held, min_df)
    vocabulary = [stats[f"n{i}"] for i in range(k)]
    texts = isinstance(bags, TextBags)
    if texts:
        norms = None
        places = bags.places(idf_table, stats["n"], ["dfs"], 80 + 8 * k)
        by_block = bags.visit(places, text_bags.sum_terms(n_docs, held, min_df, bags.keys.index("label_idx")), "term string, label_idx int, s array<double>")
        sums = by_block.groupBy("term", "label_idx").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k)])
    else:
        local = term_frequency_weight(F.col("tf"))
        known_bags, norms = _fold_norms(bags, idf_table, stats["n"], k)
        if scaling:
            norms = keep(norms)

        # A broadcast vocabulary drops the rare terms (most of them) before the sums at no
        # cost; otherwise the sums run over all terms and the rare ones go with the join below.
        # Both sides are hashed on doc_id already; the norms (one row per document) are the build side.
        counted = known_bags.drop("idf", "df") if fits_broadcast(stats["n"], 80 + 8 * k) else bags
        with_norm = counted.join(norms.hint("shuffle_hash"), "doc_id")
        sums = with_norm.groupBy("term", "label_idx").agg(
            *[
                F.coalesce(F.sum(F.when(_in_training(v), local / F.col(f"norm{i}"))), F.lit(0.0)).alias(f"s{i}")
                for i, v in enumerate(held)
            ]
        )
    idf_table = _with_scale(idf_table, bags, norms, docs, held, n_docs, scaling, min_df)
    # terms outside a vocabulary have idf null and drop out of that training set
    weighted = sums.join(idf_table, "term").select(
        "term", "label_idx",
        F.array(*[
            F.coalesce(F.col(f"s{i}") * F.col("idf")[i] / F.col("scale")[i], F.lit(0.0)) for i in range(k)
        ]).alias("s"),
    )
    weighted = (stored if texts else settle)(weighted)
    totals_rows = weighted.groupBy("label_idx").agg(*[F.sum(F.col("s")[i]).alias(f"t{i}") for i in range(k)]).collect()
    totals = [[0.0] * len(labels) for _ in held]
    for r in totals_rows:
        for i in range(k):
            totals[i][r.label_idx] = r[f"t{i}"]
    per_term = weighted.groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct("label_idx", "s"))).alias("s")  # one entry per class
    )
    return TextBayesStatistics(
        idf_table.select("term", "df", "idf", "scale", *(["blocks", "cols"] if texts else [])), per_term, stats["n"], vocabulary,
        totals, documents, list(labels), held, bags if texts else None
    )


def _with_scale(idf_table, bags, norms, docs, held, n_docs, scaling, min_df) -> DataFrame:
    """Add ``scale``: the inter-quartile range of a term's weights, 1 where that is 0.

    Weights are never negative, so the 75 % quantile of a term is 0 unless more
    than a quarter of the documents hold it; few terms do, and only their weights
    are ranked.
    """
    k = len(held)
    if not scaling:
        return idf_table.withColumn("scale", F.array_repeat(F.lit(1.0), k))
    frequent = F.filter(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.element_at("dfs", i + 1) > F.element_at(F.array(*[F.lit(0.25 * (n - 1)) for n in n_docs]), i + 1),
    )
    candidates = settle(
        idf_table.where(F.size(frequent) > 0)
        .select("term", "idf", F.explode(frequent).alias("v"))
        .where(F.element_at("idf", F.col("v") + 1).isNotNull())
    )
    n_candidates = candidates.count()  # sum(df) bounds it by 4 x k x terms per document
    terms = candidates.groupBy("term").agg(
        F.first("idf").alias("idf"), F.collect_list("v").alias("vs")
    )
    if isinstance(bags, TextBags):
        entries = idf_table.join(broadcast_small(terms.select("term", "vs")), "term", "left")
        places = bags.places(entries, n_candidates, ["dfs", "vs"], 120 + 16 * k)
        values = bags.visit(places, text_bags.candidate_values(n_docs, held, min_df), "term string, v int, value double").select(
            F.struct("term", "v").alias("key"), "value")   # counted again in every pass: the texts are far smaller
    else:
        rows = lookup(bags, terms, "term", n_candidates, bytes_per_row=120 + 16 * k)
        rows = rows.join(norms.hint("shuffle_hash"), "doc_id")
        held_map = F.array(*[F.lit(-1 if v is None else v) for v in held])
        norm_array = F.array(*[F.col(f"norm{i}") for i in range(k)])
        fold = F.col("fold") if held != [None] else F.lit(-2)
        values = (
            rows.withColumn("fold_", fold)
            .select("term", "tf", "idf", "fold_", norm_array.alias("norms"), F.explode("vs").alias("v"))
            .where(F.element_at(held_map, F.col("v") + 1) != F.col("fold_"))
            .select(
                F.struct("term", "v").alias("key"),
                (
                    term_frequency_weight(F.col("tf")) * F.element_at("idf", F.col("v") + 1)
                    / F.element_at("norms", F.col("v") + 1)
                ).alias("value"),
            )
        )
        values = keep(values)
    sizes = F.element_at(F.array(*[F.lit(n) for n in n_docs]), F.col("key")["v"] + 1)
    quartiles = exact_quantiles(values, [0.25, 0.75], total=sizes)
    ranges = quartiles.groupBy(F.col("key")["term"].alias("term")).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("key")["v"].alias("v"), (F.col("q")[1] - F.col("q")[0]).alias("iqr")))
        ).alias("iqrs")
    )
    iqr = lambda i: F.try_element_at("iqrs", F.lit(i))
    scale = F.array(*[F.when(iqr(i) > 0, iqr(i)).otherwise(F.lit(1.0)) for i in range(k)])
    ranges = settle(ranges)
    joined = idf_table.join(broadcast_small(ranges), "term", "left")
    return joined.select(*idf_table.columns, scale.alias("scale"))


# --- naive Bayes over any long, non-negative features -------------------------------


@dataclass
class LongBayesModel:
    """(feature, lp array) and priors for long features (doc_id, feature, value)."""

    table: DataFrame
    n_features: int
    labels: list[str]
    priors: list[float]

    def scores(self, features: DataFrame, docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        rows = lookup(
            features.select("doc_id", "feature", "value"), self.table, "feature", self.n_features,
            bytes_per_row=80 + 8 * len(self.labels),
        )
        summed = rows.groupBy("doc_id").agg(
            *[F.sum(F.col("value") * F.col("lp")[c]).alias(f"s{c}") for c in range(len(self.labels))]
        )
        joined = docs.select("doc_id", *carry).join(summed, "doc_id", "left")
        return joined.select(
            "doc_id", *carry,
            *[(F.lit(p) + F.coalesce(f"s{c}", F.lit(0.0))).alias(f"score_{c}") for c, p in enumerate(self.priors)],
        )

    def predict(self, features: DataFrame, docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        return self.scores(features, docs, carry).select("doc_id", *carry, argmax_label(self.labels).alias("predicted"))

    def predict_proba(self, features: DataFrame, docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        return self.scores(features, docs, carry).select("doc_id", *carry, softmax(len(self.labels)).alias("proba"))


def fit_long_bayes(
    features: DataFrame, docs: DataFrame, labels: Sequence[str], alpha: float = ALPHA
) -> LongBayesModel:
    """``features`` (doc_id, feature, value >= 0), ``docs`` (doc_id, label_idx)."""
    a = max(alpha, MIN_ALPHA)
    n_by_label = {r.label_idx: r.n for r in docs.groupBy("label_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(n_by_label.values())
    priors = [math.log(n_by_label[c]) - math.log(n) if n_by_label.get(c) else -math.inf for c in range(len(labels))]
    checked = features.withColumn(
        "value", F.when(F.col("value") < 0, F.raise_error("naive Bayes needs non-negative features")).otherwise(F.col("value"))
    )
    sums = settle(
        checked.join(broadcast_small(docs.select("doc_id", "label_idx")), "doc_id")
        .groupBy("feature", "label_idx").agg(F.sum("value").alias("s"))
    )
    totals = {r.label_idx: r.t for r in sums.groupBy("label_idx").agg(F.sum("s").alias("t")).collect()}
    per_feature = settle(
        sums.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("label_idx", "s"))).alias("s"))
    )
    n_features = per_feature.count()
    lp = F.array(*[
        F.log(F.coalesce(F.col("s")[F.lit(c)], F.lit(0.0)) + a)
        - F.lit(math.log(totals.get(c, 0.0) + a * n_features))
        for c in range(len(labels))
    ])
    return LongBayesModel(per_feature.select("feature", lp.alias("lp")), n_features, list(labels), priors)
