"""Shards of near equal bytes by sampled splitters.

Records are ordered by (digest of the text, doc_id, place).  Keys drawn in proportion to size give
quantile boundaries, the boundaries cut the order into ranges, and a range with too many bytes or rows
draws splitters of its own.  Within a range of bounded size the exact running size is known, hence a
record's byte position in the whole order and its shard.  Equal texts are neighbours, so a group of
copies lies in one shard unless it is too large for that.  Only keys and sizes move, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import let, settled

SHARDS = 16
RANGES = 256               # ranges asked for at first
DRAWN = 32                 # sampled keys per range
ROWS_LEAST = 64            # ranges asked for have this many rows or more
RANGE_ROWS = 4_000_000     # rows of a range at most, if its keys differ
OVERFULL = 2.0             # a range this many times the wanted size is cut again
TOGETHER = 0.02            # copies move to one side of a boundary if they hold at most this share of a shard
SEED = 11
DIGEST = 32                # characters of a key that name the text


def keyed(docs: DataFrame) -> DataFrame:
    """(k, doc_id, size, text_crc32) of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = settled(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest")), "shard-keys")
    # equal rows differ by their place in the written files; a null id comes before every other
    place = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    digits = lambda number: F.lpad(F.hex(number), 16, "0")
    number = F.coalesce(digits(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), F.lit("-"))
    return rows.select(F.concat("digest", number, digits(place)).alias("k"), "doc_id", "size", "text_crc32")


def _below(key: Column, splitters: list[str]) -> Column:
    """How many splitters lie at or below the key: every sixteenth first, then the sixteen after it."""
    if not splitters:
        return F.lit(0)
    # keys hold letters and digits only; a split literal is folded into one constant
    constant = lambda keys: F.split(F.lit(",".join(keys)), ",")
    groups = F.array(*[constant(splitters[n:n + 16]) for n in range(0, len(splitters), 16)])
    count = lambda keys, k: F.size(F.filter(keys, lambda s: s <= k))
    return let(key, lambda k: let(
        count(constant(splitters[::16]), k),
        lambda g: F.when(g == 0, 0).otherwise((g - 1) * 16 + count(F.get(groups, g - 1), k))))


def _drawn(rows: DataFrame, rate: float, seed: int) -> DataFrame:
    """(range, splitters): of the keys drawn by ``rate`` per byte in a range, every DRAWN-th in order.

    The sample is bounded by its parameters: rate times bytes keys are expected.
    """
    chance = F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.where(chance < F.col("size") * rate)
    return drawn.groupBy("range").agg(F.sort_array(F.collect_list("k")).alias("s")).select(
        "range", F.expr(f"filter(s, (x, n) -> n % {DRAWN} = {DRAWN - 1})").alias("splitters"))


def ranged(rows: DataFrame, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, list]:
    """``rows`` with ``range``, a number in key order, and (range, rows, bytes) of every range with rows.

    A range with more than OVERFULL times the wanted bytes (its largest record aside) or rows draws keys
    at four times the rate of the round before, and its new splitters join the others.
    """
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(min(ranges, n // ROWS_LEAST), -(-n // range_rows), 1)
    most, rate = OVERFULL * total / parts, parts * DRAWN / max(total, 1)
    first = _drawn(rows.withColumn("range", F.lit(0)), rate, SEED).first()
    splitters, depth = sorted(set(first["splitters"])) if first else [], 0
    while True:
        placed = rows.withColumn("range", _below(F.col("k"), splitters))
        sizes = placed.groupBy("range").agg(
            F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"),
            F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
        full = {r["range"]: r["hi"] for r in sizes
                if (r["bytes"] - r["largest"] > most or r["n"] > OVERFULL * range_rows) and r["lo"] != r["hi"]}
        if not full:
            return placed, sorted((r["range"], r["n"], r["bytes"]) for r in sizes)
        depth += 1
        # where the draw gives none, the largest key starts a range: every round makes progress
        found = {r: [hi] for r, hi in full.items()}
        found |= {r["range"]: r["splitters"] for r in _drawn(
            placed.where(F.col("range").isin(list(full))), rate * 4 ** depth, SEED + depth).collect() if r["splitters"]}
        splitters = sorted(set(splitters).union(*found.values()))


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs`` (doc_id, text).

    ``size`` is the text's UTF-8 bytes plus 1.  Law ``bytes``: shard sizes differ by the size of a
    document, or by the copies that stay together (TOGETHER of a shard).  ``slot`` counts from 0 within a
    shard in key order.  A null text counts as empty; a null id comes first; equal rows each have a slot;
    an empty table gives no row; other columns are ignored.  A document larger than a shard has it alone,
    and shards may then stay empty.
    """
    placed, sizes = ranged(keyed(docs), ranges, range_rows)
    total = max(sum(b for _, _, b in sizes), 1)
    starts, at, before = [], 0, 0
    for r, n, b in sizes:
        starts.append((r, at, before))
        at, before = at + n, before + b
    offsets = placed.sparkSession.createDataFrame(starts, "range int, first bigint, base bigint")
    within = Window.partitionBy("range").orderBy("k")
    # one row per range, and ranges are as many as were collected above
    order = settled(placed.join(F.broadcast(offsets), "range").select(
        "k", "doc_id", "size", "text_crc32", (F.col("first") + F.row_number().over(within) - 1).alias("g"),
        (F.col("base") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("pos"),
    ), "shard-order")

    middle = F.expr(f"least({shards - 1}, ({shards} * (2 * pos + size)) div {2 * total})")
    cuts = order.groupBy(middle.alias("shard")).agg(F.min("g").alias("g"), F.min_by("k", "g").alias("k")).collect()
    cuts = {r["shard"]: (r["g"], r["k"][:DIGEST]) for r in cuts}
    # groups of copies at a boundary, at most one per boundary
    groups = {r["d"]: r for r in order.where(F.substring("k", 1, DIGEST).isin([d for _, d in cuts.values()])).groupBy(F.substring("k", 1, DIGEST).alias("d")).agg(
        F.min("g").alias("g"), F.max("g").alias("last"), F.sum("size").alias("bytes")).collect()}
    bounds, least = [], 0
    for s in range(shards):
        g, d = cuts.get(s, (None, None))
        if g is None:   # empty: it begins where the next one does
            later = [cuts[x][0] for x in range(s + 1, shards) if x in cuts]
            g, d = (later[0] if later else at), None
        group = groups.get(d)
        if s and group and group["g"] < g and group["bytes"] <= TOGETHER * total / shards:
            g = group["g"] if g - group["g"] <= group["last"] + 1 - g else group["last"] + 1
        least = max(least, g)
        bounds.append(least)
    # an empty shard's boundary equals the next one's, so the last of equal boundaries has the rows
    which = sum((F.when(F.col("g") >= b, 1).otherwise(0) for b in bounds[1:]), F.lit(0))
    return order.withColumn("shard", which.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("g") - F.get(F.array(*[F.lit(b).cast("bigint") for b in bounds]), F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write ``docs`` below ``path`` as one folder per shard and return the placement.

    Rows join their shard by (doc_id, crc32 and size of the text); equal rows are written to one shard.
    """
    placement = shard(docs, shards)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("bigint"), F.crc32(text), F.octet_length(text) + 1).alias("name"))
    where = placement.groupBy(F.struct("doc_id", "text_crc32", F.col("size").cast("int")).alias("name")).agg(F.min("shard").alias("shard"))
    # a struct with a null field still equals its like
    rows.join(where, "name").select("shard", "row").write.partitionBy("shard").parquet(path)
    return placement


def statement() -> str:
    """The same placement in SQL: the order and the boundaries do not depend on the sampled ranges.

    CRC-32 is stated by its definition, bit by bit over the bytes of the text.
    """
    step = "xor(cr >> 1, CASE WHEN cr & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE bits(b, n, cr) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL SELECT b, n + 1, {step} FROM bits WHERE n < 8),
crc_table AS (SELECT list(cr ORDER BY b) AS t FROM bits WHERE n = 8),
keyed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) AS d,
    row_number() OVER () AS p, coalesce(text, '') AS text FROM documents),
crcs AS (
  SELECT d, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2),
      lambda i: (('0x' || substr(h, 2 * i + 1, 2))::BIGINT))),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT d, hex(encode(any_value(text))) AS h FROM keyed GROUP BY d), crc_table),
placed AS (
  SELECT *, row_number() OVER w - 1 AS g, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS pos, sum(size) OVER () AS total
  FROM keyed WINDOW w AS (ORDER BY d, doc_id NULLS FIRST, p)),
middled AS (SELECT *, least({SHARDS - 1}, ({SHARDS} * (2 * pos + size)) // (2 * total)) AS s FROM placed),
cuts AS (SELECT s, min(g) AS g, arg_min(d, g) AS d FROM middled GROUP BY s),
copies AS (SELECT d, min(g) AS lo, max(g) + 1 AS hi, sum(size) AS bytes, any_value(total) AS total FROM middled GROUP BY d),
moved AS (
  SELECT s, CASE WHEN s > 0 AND lo < g AND bytes <= {TOGETHER} * total / {SHARDS}
      THEN CASE WHEN g - lo <= hi - g THEN lo ELSE hi END ELSE g END AS g
  FROM cuts JOIN copies USING (d)),
bounds AS (SELECT s, max(g) OVER (ORDER BY s) AS g FROM moved),
final AS (
  SELECT m.doc_id, m.size, m.d, m.g, max(b.s) AS shard, max(b.g) AS first
  FROM middled m JOIN bounds b ON b.g <= m.g GROUP BY m.doc_id, m.size, m.d, m.g)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  (g - first)::BIGINT AS slot, NULL::INT AS grown_shard
FROM final JOIN crcs USING (d)
"""
