"""Dutch stems without a dictionary: the published Snowball rules as columns over distinct words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the published rules.
VOWELS = "aeiouyè"
ACCENTED, PLAIN = "äáëéïíöóüú", "aaeeiioouu"
V, C = f"[{VOWELS}]", f"[^{VOWELS}]"


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _undouble(word: Column) -> Column:
    return F.when(word.rlike("(kk|dd|tt)$"), _cut(word, 1)).otherwise(word)


def _in(word: Column, n: int, region: str) -> Column:
    """The last ``n`` letters lie in the region that begins behind ``region`` letters."""
    return F.length(word) - n >= F.col(region)


def _en(word: Column, n: int) -> Column:
    """An ending of ``n`` letters that the rule for -en removes."""
    rest = _cut(word, n)
    return _in(word, n, "p1") & rest.rlike(f"{C}$") & ~F.endswith(rest, F.lit("gem"))


def with_stems(words: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with ``stem``; lower-case words are expected, a null word has no stem."""
    w = F.col("_w")
    marked = F.regexp_replace(F.translate(word, ACCENTED, PLAIN), "^y", "Y")
    marked = F.regexp_replace(F.regexp_replace(marked, f"({V})y", "$1Y"), f"({V})i({V})", "$1I$2")
    rows = words.withColumn("_w", marked)
    # the regions behind the first, and the second, consonant that follows a vowel
    first = F.length(F.regexp_extract("_w", f"^.*?{V}{C}", 0))
    both = F.length(F.regexp_extract("_w", f"^.*?{V}{C}.*?{V}{C}", 0))
    end = F.length("_w")
    rows = rows.withColumn("p1", F.when(first > 0, F.greatest(first, F.lit(3))).otherwise(end)).withColumn(
        "p2", F.when(both > 0, both).otherwise(end))

    ends = lambda s: F.endswith("_w", F.lit(s))
    s_ending = lambda n: _in(w, n, "p1") & _cut(w, n).rlike(f"[^{VOWELS}j]$")
    rows = rows.withColumn("_w", (
        F.when(ends("heden"), F.when(_in(w, 5, "p1"), F.concat(_cut(w, 5), F.lit("heid"))).otherwise(w))
        .when(ends("ene"), F.when(_en(w, 3), _undouble(_cut(w, 3))).otherwise(w))
        .when(ends("en"), F.when(_en(w, 2), _undouble(_cut(w, 2))).otherwise(w))
        .when(ends("se"), F.when(s_ending(2), _cut(w, 2)).otherwise(w))
        .when(ends("s"), F.when(s_ending(1), _cut(w, 1)).otherwise(w)).otherwise(w)))

    e_ending = lambda x: F.endswith(x, F.lit("e")) & _in(x, 1, "p1") & _cut(x, 1).rlike(f"{C}$")
    rows = rows.withColumn("_e", e_ending(w))
    rows = rows.withColumn("_w", F.when(F.col("_e"), _undouble(_cut(w, 1))).otherwise(w))

    rows = rows.withColumn("_h", ends("heid") & _in(w, 4, "p2") & ~ends("cheid"))
    rows = rows.withColumn("_w", F.when(F.col("_h"), _cut(w, 4)).otherwise(w))
    rows = rows.withColumn("_w", F.when(F.col("_h") & ends("en") & _en(w, 2), _undouble(_cut(w, 2))).otherwise(w))

    ig = lambda x: F.endswith(x, F.lit("ig")) & _in(x, 2, "p2") & ~F.endswith(x, F.lit("eig"))
    three, four = _cut(w, 3), _cut(w, 4)
    rows = rows.withColumn("_w", (
        F.when(ends("end") | ends("ing"), F.when(_in(w, 3, "p2"), F.when(ig(three), _cut(three, 2)).otherwise(_undouble(three))).otherwise(w))
        .when(ends("ig"), F.when(ig(w), _cut(w, 2)).otherwise(w))
        .when(ends("lijk"), F.when(_in(w, 4, "p2"), F.when(e_ending(four), _undouble(_cut(four, 1))).otherwise(four)).otherwise(w))
        .when(ends("baar"), F.when(_in(w, 4, "p2"), four).otherwise(w))
        .when(ends("bar"), F.when(_in(w, 3, "p2") & F.col("_e"), three).otherwise(w)).otherwise(w)))

    stem = w
    for vowel in "aeou":
        stem = F.regexp_replace(stem, f"({C}){vowel}{vowel}([^{VOWELS}I])$", f"$1{vowel}$2")
    return rows.withColumn("stem", F.lower(stem)).drop("_w", "_e", "_h", "p1", "p2")


def stem_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, stem) of every distinct lower-cased word of letters: each word is stemmed once, however frequent."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return with_stems(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
