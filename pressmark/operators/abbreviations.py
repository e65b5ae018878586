"""Abbreviations learned from corpus counts, and sentences that they do not end.

A type (a lower-cased token without its final full stop) is an abbreviation if its full stop is far more
frequent than chance: the log-likelihood ratio of Kiss and Strunk (2006), weighted by shortness, inner
full stops and occurrences without a full stop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx

# Fixed values of the published method.
THRESHOLD = 0.3
P_ABBREVIATION = 0.99
# Letters, with single full stops between or behind.
TYPE = r"^\p{L}+(\.\p{L}+)*\.?$"
MOST = 50_000              # learned abbreviations that are applied as one constant


def type_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, n, n_stop): tokens of every type, and those with a final full stop."""
    tokens = docs.select(F.explode(F.split(text, " ")).alias("token")).where(F.col("token").rlike(TYPE))
    stop = F.endswith("token", F.lit("."))
    return tokens.groupBy(F.lower(F.rtrim("token", F.lit("."))).alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(stop.cast("bigint")).alias("n_stop"))


def scored(counts: DataFrame) -> DataFrame:
    """``counts`` with ``score``; one row with the totals reaches the driver."""
    total, stops = counts.agg(F.sum("n"), F.sum("n_stop")).first()
    chance = min(max((stops or 0) / max(total or 1, 1), 1e-9), 1 - 1e-9)
    rest = F.col("n") - F.col("n_stop")
    likelihood = lambda p: F.col("n_stop") * F.log(F.lit(p)) + rest * F.log(F.lit(1 - p))
    letters = F.length(F.translate("type", ".", "")).cast("double")
    ratio = -2.0 * (likelihood(chance) - likelihood(P_ABBREVIATION))
    periods = F.length("type") - letters + 1
    return counts.withColumn("score", ratio * F.exp(-letters) * periods * F.pow(letters, -rest.cast("double")))


def learn(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(type, n, n_stop, score) of the abbreviations of a corpus."""
    return scored(type_counts(docs, text)).where((F.col("score") >= threshold) & (F.col("n_stop") > 0))


def known(table: DataFrame) -> list[str]:
    """The learned types, as a constant for ``sentences``; a list of unexpected size is refused."""
    found = [r["type"] for r in table.select("type").limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} abbreviations: raise the threshold")
    return sorted(found)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` worked out once a row: inside a lambda it would be once an element."""
    return F.transform(F.array(value), body)[0]


def _joined(pieces: Column, follows: Column) -> Column:
    """Neighbouring pieces as one where ``follows`` (one flag per piece) says that a piece goes on."""

    def cut(x: Column) -> Column:
        p, f = x["p"], x["f"]
        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: ~F.get(f, i))
        return _once(starts, lambda s: F.transform(
            s, lambda b, n: F.array_join(F.slice(p, b + 1, F.coalesce(F.get(s, n + 1), F.size(p)) - b), "")))

    return _once(F.struct(pieces.alias("p"), follows.alias("f")), cut)


def with_sentences(docs: DataFrame, abbreviations: list[str], text: str = "text") -> DataFrame:
    """``docs`` with ``sentences``: a full stop ends one only before a blank and not behind an abbreviation.

    A null text has none, as has a text without anything but marks.
    """
    pieces = docs.withColumn("_p", tx.sentences(F.col(text)))
    inner = pieces.withColumn("_f", F.transform("_p", lambda p, i: (i > 0) & ~F.startswith(p, F.lit(" "))))
    whole = inner.withColumn("_p", F.when(F.size("_p") > 0, _joined(F.col("_p"), F.col("_f"))).otherwise(F.col("_p")))
    last = lambda p: F.lower(F.regexp_extract(p, r"([^ ]*)\.$", 1))
    short = F.transform("_p", lambda p: F.endswith(p, F.lit(".")) & last(p).isin(abbreviations)) if abbreviations else None
    if short is None:
        return whole.withColumn("sentences", F.col("_p")).drop("_p", "_f")
    marked = whole.withColumn("_s", short).withColumn("_f", F.transform("_s", lambda s, i: (i > 0) & F.coalesce(F.get("_s", i - 1), F.lit(False))))
    return marked.withColumn("sentences", F.when(F.size("_p") > 0, _joined(F.col("_p"), F.col("_f"))).otherwise(F.col("_p"))).drop(
        "_p", "_f", "_s")
