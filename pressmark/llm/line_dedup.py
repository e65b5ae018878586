"""Line dedup over content-defined chunks of lines (DataFrame functions only).

A rolling hash over the hashes of two neighbouring lines says whether they are a boundary.  A chunk
consists of the lines of a boundary, or reaches from one boundary to the next if lines between them
belong to neither.  Nothing outside a chunk's own lines decides about it, so a passage has the same
chunks wherever it stands, and an inserted or deleted line changes none but those it lies in.  A chunk
whose bytes occur more than once in the corpus stays where it occurs first; the lines of all its other
places are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lookup import lookup
from .common import let, settled

#: Two neighbouring lines are a boundary unless their rolling hash is divisible by this.
DIVISOR = 5
#: Multiplier of the rolling hash.
FACTOR = 31
#: Repeated chunks are broadcast up to this size; beyond it only the most frequent ones are.
BROADCAST_BYTES = 32 << 20


def line_value(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """Chunks of a text in order: array of (place, lines, body), place being the first line from 0.

    Chunks overlap.  A text of one line has none.
    """

    def cut(lines: Column) -> Column:
        def piece(place: Column, n: Column) -> Column:
            return F.struct(place.alias("place"), n.alias("lines"), F.array_join(F.slice(lines, place + 1, n), "\n").alias("body"))

        def around(bounds: Column) -> Column:
            gaps = F.filter(
                F.zip_with(bounds, F.slice(bounds, 2, F.greatest(F.size(bounds) - 1, F.lit(0))),
                           lambda a, b: F.struct(a.alias("place"), (b - a + 2).alias("lines"))),
                lambda g: g["lines"] > 4)
            return F.concat(
                F.transform(bounds, lambda i: piece(i, F.lit(2))), F.transform(gaps, lambda g: piece(g["place"], g["lines"])))

        def with_values(values: Column) -> Column:
            rolled = lambda i: F.get(values, i) * FACTOR + F.get(values, i + 1)
            return let(F.filter(
                F.sequence(F.lit(0), F.size(lines) - 2), lambda i: F.pmod(rolled(i), F.lit(divisor)) != 0), around)

        return F.when(F.size(lines) > 1, let(F.transform(lines, line_value), with_values))

    return let(F.split(text, "\n"), cut)


def chunk_places(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(doc_id, text_hash, place, lines, body) of every chunk that is not blank."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(chunks(F.col("text"), divisor))).where(
        F.col("body").rlike(r"[^\s]"))


def repeated_chunks(places: DataFrame) -> DataFrame:
    """(digest, n, first) of every chunk whose bytes occur at more than one place; ``first`` is its first place.

    Chunks are grouped by their bytes.  Two different chunks with one digest would both be left out,
    so a digest stands for its bytes from here on.
    """
    here = F.struct("doc_id", "text_hash", "place")
    by_bytes = places.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("first"), F.max(here).alias("last"))
    return by_bytes.groupBy(F.md5("body").alias("digest")).agg(
        F.count(F.lit(1)).alias("bodies"), F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
    ).where((F.col("bodies") == 1) & ~F.col("first").eqNullSafe(F.col("last"))).select("digest", "n", "first")


def line_dedup(docs: DataFrame, divisor: int = DIVISOR, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, any others) without repeated chunks, plus n_lines and n_removed.

    The first place is the smallest (doc_id, hash of the text, position); a null doc_id comes first.  A
    chunk that overlaps its own first place does not repeat it.  Of every line at least one copy stays.
    Equal rows (same doc_id, same text) are one document and are treated alike.  A null text stays null
    (0 lines), an empty one empty (1 line); a text of repeated chunks only becomes empty.  Every row
    stays; an empty table gives an empty one.  Other columns keep their values whatever their names, but
    for n_lines and n_removed.
    """
    places = chunk_places(docs, divisor)
    first = settled(repeated_chunks(places), "line-chunks")
    found = lookup(
        places.select("doc_id", "text_hash", "place", "lines", F.md5("body").alias("digest")), first, "digest", first.count(),
        bytes_per_row=160, frequency=F.col("n"), limit_bytes=broadcast_bytes)
    at_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (
        F.col("place") < F.col("first.place") + F.col("lines"))
    # what leaves a document: no more chunks than it has lines
    gone = found.where(~at_first).groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(
        F.collect_set(F.struct("place", "lines")).alias("gone"))
    joined = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash")).join(
        gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    out = F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["place"], g["place"] + g["lines"] - 1))))
    return without_lines(docs, joined.withColumn("out", out))


def without_lines(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of ``docs`` (column row) without the lines whose places are listed in the column out, if it is not null."""

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("out"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("out").isNull(), F.col("row.text")).otherwise(let(F.split("row.text", "\n"), kept))
    done = joined.select(
        "row", text.alias("text"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n"))).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("out"), F.lit(0)).cast("bigint").alias("n_removed"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return done.select(
        *[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in own], "n_lines", "n_removed")


def neighbours(text: Column) -> Column:
    """A digest of every pair of neighbouring lines in order; null where both are blank."""

    def digests(lines: Column) -> Column:
        n = F.size(lines) - 1
        return F.zip_with(F.slice(lines, 1, n), F.slice(lines, 2, n), lambda a, b: F.when(
            F.concat(a, b).rlike(r"[^\s]"), F.unhex(F.sha2(F.concat_ws("\n", a, b), 256))))

    return let(F.split(text, "\n"), digests)


def passage_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any others) without repeated runs of two or more lines, plus n_lines and n_removed.

    A run repeats if each of its pairs of neighbouring lines stands at an earlier place too, whatever
    surrounds it; a pair that overlaps its own first place does not repeat it.  Places are ordered, and
    rows, other columns, null and empty texts treated, as in ``line_dedup``.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    here = F.struct("doc_id", "text_hash", "place")
    places = rows.select("doc_id", "text_hash", F.posexplode(neighbours(F.col("row.text"))).alias("place", "digest")).where(
        F.col("digest").isNotNull())
    first = places.groupBy("digest").agg(F.min(here).alias("first"), F.max(here).alias("last")).where(
        ~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first")
    overlaps = F.struct("doc_id", "text_hash", (F.col("place") - 1).alias("place")).eqNullSafe(F.col("first"))
    gone = places.join(first, "digest").where(~here.eqNullSafe(F.col("first")) & ~overlaps).groupBy(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.collect_set("place").alias("pairs"))
    joined = rows.join(
        gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    out = F.array_union(F.col("pairs"), F.transform("pairs", lambda i: i + 1))
    return without_lines(docs, joined.withColumn("out", out))


def statement(divisor: int = DIVISOR) -> str:
    """The same rows from DuckDB: doc_id, n_lines, n_removed, text."""
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
        v AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS v FROM l),
        w AS (SELECT doc_id, i, v * {FACTOR} + lead(v) OVER (PARTITION BY doc_id ORDER BY i) AS rolled FROM v),
        b AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM w WHERE rolled % {divisor} <> 0),
        s AS (SELECT doc_id, i, 2 AS n FROM b UNION ALL SELECT doc_id, i, following - i + 2 FROM b WHERE following - i > 2),
        c AS (SELECT s.doc_id, s.i, s.n, string_agg(l.line, chr(10) ORDER BY l.i) AS body
            FROM s JOIN l ON l.doc_id = s.doc_id AND l.i BETWEEN s.i AND s.i + s.n - 1 GROUP BY s.doc_id, s.i, s.n),
        f AS (SELECT *, min(ROW(doc_id, i)) OVER (PARTITION BY body) AS first FROM c WHERE regexp_matches(body, '[^\\s]')),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM f
            WHERE NOT (first[1] = doc_id AND i < first[2] + n)),
        k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
            coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
            FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, k.text
        FROM documents d LEFT JOIN k USING (doc_id)"""


def passage_statement() -> str:
    """The rows of ``passage_dedup`` from DuckDB: doc_id, n_lines, n_removed, text."""
    return """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, i, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l),
        f AS (SELECT a, b, min(ROW(doc_id, i)) AS first FROM p
            WHERE b IS NOT NULL AND regexp_matches(concat(a, b), '[^\\s]') GROUP BY a, b HAVING count(*) > 1),
        g AS (SELECT doc_id, i FROM p JOIN f USING (a, b) WHERE first <> ROW(doc_id, i) AND first <> ROW(doc_id, i - 1)),
        x AS (SELECT doc_id, i FROM g UNION SELECT doc_id, i + 1 FROM g),
        k AS (SELECT l.doc_id, count(*) AS n_lines, count(x.i) AS n_removed,
            coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (x.i IS NULL), '') AS text
            FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, k.text
        FROM documents d LEFT JOIN k USING (doc_id)"""
