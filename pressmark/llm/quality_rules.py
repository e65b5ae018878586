"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Two base rules are fixed.  Further rules reject a document when a measure exceeds a cutoff; the
cutoffs come from labelled documents.  A cutoff is used only if an exact binomial bound guarantees,
for every stratum on its own, that it rejects at most ``risk`` of the good documents:

* good documents of the stratum are the holdout, those a cutoff rejects are its errors;
* P(Bin(n, risk per rule) <= errors) must not exceed delta / (strata x rules) (Bonferroni);
* the cutoffs of one rule are tried from the mildest on, up to the first that fails, which needs no
  further correction.

Together all rules reject more than ``risk`` of a stratum's good documents with probability at most
``delta``.  A stratum with too few labels keeps all documents that pass the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.lookup import broadcast_small
from .common import let, settled

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
GRAM = 5

RISK = 0.02
DELTA = 0.05
#: Rule -> (numerator, denominator, cutoffs from the mildest on); a ratio above the cutoff is rejected.
RULES = {
    "symbols": ("n_symbols", "word_chars", [0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03]),
    "capitals": ("n_capitals", "word_chars", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "lines": ("n_dup_lines", "n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "repeats": ("n_repeat_words", "n_words", [0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06]),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines"]


def repeated_words(words: Column, gram: int = GRAM) -> Column:
    """Words that lie in a window of ``gram`` words found twice or more in the text."""

    def with_hashes(h: Column) -> Column:
        windows = F.when(F.size(h) >= gram, F.transform(
            F.sequence(F.lit(0), F.size(h) - gram), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(gram)])))

        def covered(sorted_: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(sorted_, k)["h"] == x["h"], F.lit(False))
            places = F.array_sort(F.transform(
                F.filter(sorted_, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
            return F.aggregate(
                places, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-gram).alias("last")),
                lambda acc, i: F.struct(
                    (acc["n"] + F.least(F.lit(gram), i - acc["last"])).cast("bigint").alias("n"), i.alias("last")),
                lambda acc: acc["n"])

        def counted(w: Column) -> Column:
            placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            # most texts repeat nothing and need no sorting
            return F.when(F.size(F.array_distinct(w)) < F.size(w), let(placed, covered)).otherwise(
                F.lit(0).cast("bigint"))

        return F.when(F.size(h) >= gram, let(windows, counted)).otherwise(F.lit(0).cast("bigint"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), with_hashes)


def measures(text: Column) -> Column:
    """struct of MEASURES; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("bigint")
    by_word = let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(
        F.size(x).cast("bigint").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return let(F.struct(by_word.alias("w"), by_line.alias("l")), lambda s: F.struct(
        s["w"]["n_words"].alias("n_words"), s["w"]["word_chars"].alias("word_chars"),
        kept("[^#*$%&|<>]+").alias("n_symbols"), s["l"]["n_dup_lines"].alias("n_dup_lines"),
        s["w"]["n_repeat_words"].alias("n_repeat_words"), kept("[^A-Z]+").alias("n_capitals"),
        s["l"]["n_lines"].alias("n_lines")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def ratio(rule: str) -> Column:
    over, under, _ = RULES[rule]
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def at_most(errors: Column, n: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= errors), summed in logarithms; 1 where errors exceed the expected number anyway."""
    odds = F.log(F.lit(risk / (1 - risk)))
    first = n * F.log(F.lit(1 - risk))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(term, acc["total"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(acc["total"] - top))).alias("total"))

    total = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(errors, F.lit(1))), F.struct(first.alias("term"), first.alias("total")),
        lambda acc, i: F.when(i <= errors, step(acc, i)).otherwise(acc), lambda acc: acc["total"])
    return F.when(errors > n * risk, F.lit(1.0)).otherwise(F.exp(total))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one column a rule): the strictest guaranteed cutoff, null where none is.

    ``labels``: (doc_id, quality); rows with quality 1 are the good documents, null ids count for none.
    """
    good = measured.join(labels.where(F.col("quality") == 1).select("doc_id").distinct(), "doc_id")
    # each document says, for every rule, how many cutoffs reject it; counting that is one small aggregation
    rejected = F.explode(F.array(*[F.struct(
        F.lit(rule).alias("rule"),
        sum((ratio(rule) > c).cast("int") for c in RULES[rule][2]).alias("hits")) for rule in RULES]))
    counts = settled(good.select("stratum", rejected.alias("r")).groupBy("stratum", "r.rule", "r.hits").agg(
        F.count(F.lit(1)).alias("n")), "holdout")
    strata = counts.select("stratum").distinct().count()
    totals = counts.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("hits", "n")).alias("counts"))
    grid = F.create_map(*[x for rule, (_, _, cuts) in RULES.items() for x in (
        F.lit(rule), F.array(*[F.lit(c) for c in cuts]))])
    each = totals.select("stratum", "rule", "n", "counts", F.posexplode(grid[F.col("rule")]).alias("k", "cutoff"))
    # cutoffs are nested: the (k+1)-mildest cuts out every document that k+1 or more cutoffs reject
    errors = F.aggregate(
        F.filter("counts", lambda c: c["hits"] > F.col("k")), F.lit(0).cast("bigint"), lambda n, c: n + c["n"])
    tested = each.withColumn("errors", errors).withColumn(
        "passes", at_most(F.col("errors"), F.col("n"), risk / len(RULES)) <= delta / max(1, strata * len(RULES)))
    in_order = Window.partitionBy("stratum", "rule").orderBy("k")
    chosen = tested.withColumn("so_far", F.min("passes").over(in_order)).where("so_far")
    return chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))


def judged(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """(doc_id, text_hash, MEASURES, base_failed, kept) of every row of ``docs`` (doc_id, text, the stratum column).

    Null and empty texts fail the base rules.  A null stratum is a stratum of its own.  Rows with a null
    or repeated doc_id are judged like any other.  Empty labels: only the base rules hold.
    """
    measured = _measured(docs, stratum)
    cutoffs = settled(thresholds(measured, labels, risk, delta), "cutoffs")
    found = _verdict(measured, cutoffs)
    return found.select("doc_id", "text_hash", *MEASURES, "base_failed", "kept")


def _measured(docs: DataFrame, stratum: str) -> DataFrame:
    return settled(docs.select(
        F.col("doc_id"), _stratum(stratum).alias("stratum"), F.xxhash64("text").alias("text_hash"),
        measures(F.col("text")).alias("m"),
    ).select("doc_id", "stratum", "text_hash", "m.*"), "measures")


def _stratum(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _verdict(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add base_failed and kept; the cutoffs, one row a stratum, go to every task if their counted size allows."""
    exceeds = F.lit(False)
    for rule in RULES:
        exceeds = exceeds | F.coalesce(ratio(rule) > F.col(rule), F.lit(False))
    rows = measured.join(broadcast_small(cutoffs), "stratum", "left").withColumn("base_failed", base_failed())
    # one condition, so that no part of it is evaluated a second time below the join
    return rows.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~exceeds))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns unchanged.

    The texts are measured again where they stand: that costs less than bringing all of them together
    with their verdicts.
    """
    cutoffs = settled(thresholds(_measured(docs, stratum), labels), "cutoffs")
    rows = docs.select(F.struct("*").alias("row"), _stratum(stratum).alias("stratum"), measures(F.col("text")).alias("m"))
    return _verdict(rows.select("row", "stratum", "m.*"), cutoffs).where("kept").select("row.*")


def statement(risk: float = RISK, delta: float = DELTA) -> str:
    """The same rows from DuckDB."""
    word = r"[^\x20\x09-\x0D]+"
    hits = " UNION ALL ".join(
        f"SELECT lang, '{rule}' AS rule, {' + '.join(f'({over} / greatest({under}, 1) > {c})::INT' for c in cuts)} AS hits FROM good"
        for rule, (over, under, cuts) in RULES.items())
    grid = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {k} AS k, {c}::DOUBLE AS cutoff" for rule, (_, _, cuts) in RULES.items()
        for k, c in enumerate(cuts))
    share = risk / len(RULES)
    exceeds = " OR ".join(
        f"coalesce({over} / greatest({under}, 1) > (SELECT min(cutoff) FROM chosen c WHERE c.rule = '{rule}' AND c.lang = m.lang), false)"
        for rule, (over, under, _) in RULES.items())
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '{word}') AS ws,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
            FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(ws) - {GRAM - 2})) AS i,
            unnest(list_transform(range(1, len(ws) - {GRAM - 2}), lambda j: array_to_string(ws[j:j + {GRAM - 1}], ' '))) AS g
            FROM d WHERE len(ws) >= {GRAM}),
        f AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        r AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least({GRAM}, i - coalesce(
            lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{GRAM})) AS n FROM f) GROUP BY doc_id),
        m AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
            (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
            length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals, len(ls)::BIGINT AS n_lines
            FROM d LEFT JOIN r USING (doc_id)),
        good AS (SELECT m.* FROM m JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id)),
        h AS ({hits}), grid AS ({grid}), s AS (SELECT lang, rule, count(*) AS n FROM h GROUP BY ALL),
        t AS (SELECT s.lang, s.rule, s.n, k, cutoff, (SELECT count(*) FROM h WHERE h.lang = s.lang AND h.rule = s.rule AND hits > k) AS e
            FROM s JOIN grid USING (rule)),
        p AS (SELECT *, CASE WHEN e > n * {share} THEN 1 ELSE list_sum(list_transform(range(0, e + 1), lambda i:
            exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln({1 - share})))) END
            <= {delta} / ({len(RULES)} * (SELECT count(DISTINCT lang) FROM good)) AS passes FROM t),
        chosen AS (SELECT * FROM p QUALIFY bool_and(passes) OVER (PARTITION BY lang, rule ORDER BY k)),
        b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed, {exceeds} AS exceeds FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT exceeds AS kept FROM b"""
