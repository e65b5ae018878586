"""Secret scans: known forms and high-entropy strings (DataFrame functions only).

Known forms are the base patterns.  Beyond them a candidate string of one character class is
reported if the Shannon entropy of some window reaches the class's threshold; the entropy follows
from counts that change by one character entering and one leaving.  Known forms and tokens that hold
an allow-listed word are cut out of a candidate; what is left is judged on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN_CHARS = 6

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_-]{{{WINDOW},}}"
#: Bits a character: digits with a-f in either case, one case with digits, and letters mixed with digits.
#: Other classes are prose.
HEX_BITS = 3.0
ONE_CASE_BITS = 3.4
MIXED_BITS = 3.75
#: A token that holds one of these is documentation or a counter, not a secret.
ALLOWED = ["EXAMPLE", "example", "0123456789", "1234567890", "abcdefghij", "ABCDEFGHIJ", "xxxxxxxx", "XXXXXXXX", "00000000"]

BLOCK = 256


def running(values: Column) -> Column:
    """Running totals of an array, in blocks so that the work stays close to its length."""

    def plain(a: Column) -> Column:
        return F.aggregate(
            a, F.array().cast("array<bigint>"),
            lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("bigint")) + x)))

    def blocks(a: Column) -> Column:
        starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))).otherwise(
            F.array().cast("array<int>"))
        inner = F.transform(starts, lambda b: plain(F.slice(a, b * BLOCK + 1, BLOCK)))

        def shifted(found: Column) -> Column:
            totals = plain(F.transform(found, lambda b: F.get(b, F.size(b) - 1)))
            return let(totals, lambda t: F.flatten(F.transform(
                found, lambda b, k: F.transform(b, lambda x: x + F.coalesce(F.get(t, k - 1), F.lit(0).cast("bigint"))))))

        return let(inner, shifted)

    return let(values, blocks)


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All matches, leftmost and non-overlapping: array of (start, kind, end, value); places in code points."""
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")

    def found(parts: Column) -> Column:
        hits, gaps, values = parts["hits"], parts["gaps"], parts["values"]
        lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("bigint"))
        return let(running(lengths), lambda ends: F.transform(hits, lambda h, i: F.struct(
            (F.get(ends, i) - F.length(h)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
            F.get(ends, i).alias("end"), F.get(values, i).alias("value"))))

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))
    return F.when(text.rlike(pattern), let(parts, found)).otherwise(empty)


def peak_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any ``window`` neighbouring characters."""

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(0.0)

    def slide(chars: Column) -> Column:
        def count(begin: Column, n: Column, c: Column) -> Column:
            return F.size(F.filter(F.slice(chars, begin, n), lambda x: x == c)).cast("double")

        def step(acc: Column, i: Column) -> Column:
            # i from 1; the window before it starts at i - window
            start = F.greatest(i - window, F.lit(1))
            leaving = F.when(i > window, count(start, F.lit(window), F.get(chars, i - window - 1))).otherwise(0.0)
            begin = F.greatest(i - window + 1, F.lit(1))
            entering = F.when(i > 1, count(begin, F.greatest(i - begin, F.lit(0)), F.get(chars, i - 1))).otherwise(0.0)
            total = acc["total"] - weight(leaving) + weight(leaving - 1) + weight(entering + 1) - weight(entering)
            bits = F.when(i >= window, F.lit(window).cast("double"))
            peak = F.greatest(acc["peak"], F.coalesce(F.log2(bits) - total / bits, F.lit(0.0)))
            return F.struct(total.alias("total"), peak.alias("peak"))

        return F.aggregate(
            F.sequence(F.lit(1), F.size(chars)), F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("peak")),
            step, lambda acc: acc["peak"])

    return let(F.split(value, ""), slide)


def allowed_token(allowed: list[str]) -> str:
    """Pattern of a token, as delimited by / _ and -, that holds an allow-listed word."""
    words = "|".join(rf"\Q{word}\E" for word in allowed)
    return f"(?<![A-Za-z0-9+])[A-Za-z0-9+]*(?:{words})[A-Za-z0-9+]*"


def pieces(run: Column, base: Column, allowed: list[str]) -> Column:
    """What base spans and allow-listed tokens leave of a candidate, as candidates of WINDOW or more characters."""
    token = allowed_token(allowed) if allowed else None
    touching = F.filter(base, lambda x: (x["start"] < run["end"]) & (run["start"] < x["end"]))
    cuts = F.transform(touching, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    if token:
        cuts = F.concat(cuts, F.transform(matches(run["value"], token, "entropy"), lambda x: F.struct(
            (x["start"] + run["start"]).alias("start"), (x["end"] + run["start"]).alias("end"))))

    def left(found: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            gap = F.struct(acc["at"].alias("start"), x["start"].alias("end"))
            out = F.when(x["start"] - acc["at"] >= WINDOW, F.concat(acc["out"], F.array(gap))).otherwise(acc["out"])
            return F.struct(out.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

        ends = F.concat(F.array_sort(found), F.array(F.struct(run["end"].alias("start"), run["end"].alias("end"))))
        start = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"), run["start"].alias("at"))
        gaps = F.aggregate(ends, start, step, lambda acc: acc["out"])
        return F.transform(gaps, lambda g: F.struct(
            g["start"].alias("start"), run["kind"].alias("kind"), g["end"].alias("end"),
            F.substring(run["value"], (g["start"] - run["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int")).alias("value")))

    return let(cuts, lambda found: F.when(F.size(found) > 0, left(found)).otherwise(F.array(run)))


def suspicious(value: Column) -> Column:
    letters = value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    # a cut leaves delimiters at the ends, which say nothing of the class
    bits = F.when(value.rlike("^[/_-]*[0-9A-Fa-f]+[/_-]*$"), HEX_BITS).when(
        value.rlike("^[/_-]*([0-9a-z]+|[0-9A-Z]+)[/_-]*$"), ONE_CASE_BITS).otherwise(MIXED_BITS)
    return F.when(letters, peak_entropy(value) >= bits).otherwise(False)


def spans(text: Column, allowed: list[str] | None = None) -> Column:
    """struct(base, found): arrays of (start, kind, end); ``found`` are entropy spans that touch no base span."""
    allowed = ALLOWED if allowed is None else allowed
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    assign = F.filter(matches(text, ASSIGN, "assign", 1), lambda s: F.length(s["value"]) >= ASSIGN_CHARS)
    base = F.array_sort(F.transform(
        F.concat(assign, matches(text, ACCESS, "access"), matches(text, HEX, "hex")), place))

    def with_base(b: Column) -> Column:
        left = F.flatten(F.transform(matches(text, CANDIDATE, "entropy"), lambda s: pieces(s, b, allowed)))
        new = F.filter(left, lambda s: suspicious(s["value"]))
        return F.struct(b.alias("base"), F.transform(new, place).alias("found"))

    return let(base, with_base)


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, any others) plus ``base_spans`` and ``all_spans``: arrays of (start, kind, end).

    ``kind`` is an index into KINDS; places count code points, the end is exclusive.  Null and empty
    texts have none.  Every row stays, repeated ones included; other columns pass whatever their
    names, but for the two added ones, which are replaced.
    """
    own = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    rows = docs.select(F.struct(*own).alias("row"), spans(F.coalesce(F.col("text"), F.lit("")), allowed).alias("spans"))
    return rows.select(
        *[F.col("row")[c].alias(c) for c in own], F.col("spans.base").alias("base_spans"),
        F.array_sort(F.concat("spans.base", "spans.found")).alias("all_spans"))


def redact(scanned: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """The scanned rows with every span's characters replaced by ``mark``; overlapping spans are one."""

    def masked(text: Column, found: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            # text before the span, then the mark; a span inside an earlier one adds nothing
            gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
            return F.when(
                s["start"] >= acc["at"],
                F.struct(F.concat(acc["out"], F.array(gap, F.lit(mark))).alias("out"), s["end"].alias("at"))
            ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))
        return F.aggregate(found, start, step, lambda acc: F.concat(
            F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))

    return scanned.withColumn("text", F.when(
        F.size("all_spans") > 0, masked(F.col("text"), F.col("all_spans"))).otherwise(F.col("text")))
