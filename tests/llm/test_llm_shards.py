"""Sampled splitters against a plain ordering of all rows."""

import hashlib
import zlib
from collections import defaultdict

from helpers_llm import texts

from pressmark.llm import sharding


def placed(docs, **parameters):
    return [tuple(r) for r in sharding.shard(docs, **parameters).collect()]


def brute(rows, shards):
    """(doc_id, size, crc, shard, slot) sorted, by sorting all rows at once."""
    rows = sorted(((hashlib.md5((t or "").encode()).hexdigest(), i is not None, i or 0, len((t or "").encode()) + 1,
                    zlib.crc32((t or "").encode()), i) for i, t in rows))
    total, at, middles = sum(r[3] for r in rows), 0, []
    for r in rows:
        middles.append(min(shards - 1, shards * (2 * at + r[3]) // (2 * total)))
        at += r[3]
    bounds, least = [0], 0
    for s in range(1, shards):
        g = next((n for n, m in enumerate(middles) if m >= s), len(rows))
        if s in middles:
            same = [n for n, r in enumerate(rows) if r[0] == rows[g][0]]
            if same[0] < g and sum(rows[n][3] for n in same) <= sharding.TOGETHER * total / shards:
                g = same[0] if g - same[0] <= same[-1] + 1 - g else same[-1] + 1
        least = max(least, g)
        bounds.append(least)
    found = []
    for n, r in enumerate(rows):
        s = max(x for x in range(shards) if bounds[x] <= n)
        found.append((r[5], r[3], r[4], s, n - bounds[s]))
    return sorted(found, key=str)


def plain(rows):
    return sorted(((i, size, crc, s, slot) for i, size, crc, _, s, slot, _ in rows), key=str)


def test_placement_equals_one_sort_of_all_rows(odd, small):
    for docs, shards in ((odd, 3), (small, 16), (small.union(small.limit(30)), 7)):
        got = placed(docs, shards=shards)
        assert plain(got) == brute(texts(docs), shards)
        assert {r[3] for r in got} == {"bytes"} and {r[6] for r in got} == {None}


def test_overfull_ranges_are_cut_again_and_hot_copies_split(spark):
    rows = [(n, "copy " * 20) for n in range(900)] + [(n, f"text {n} " * (n % 30)) for n in range(900, 2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ranges, sizes = sharding.ranged(sharding.keyed(docs), ranges=4, range_rows=50)
    assert sum(n for _, n, _ in sizes) == 2000 and max(n for _, n, _ in sizes) <= 2 * 50
    edges = sorted((r["range"], r["k"]) for r in ranges.select("range", "k").collect())
    assert [k for _, k in edges] == sorted(k for _, k in edges)
    got = placed(docs, ranges=4, range_rows=50)
    assert plain(got) == brute(rows, 16)
    total = defaultdict(int)
    for r in got:
        total[r[4]] += r[1]
    largest = max(r[1] for r in got)
    assert max(total.values()) - min(total.values()) <= 2 * largest + sharding.TOGETHER * sum(total.values()) / 16


def test_equal_rows_and_empty_tables(spark, empty):
    rows = [(None, "x" * 50)] * 300 + [(5, None)] * 200
    got = placed(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=4, range_rows=20)
    assert plain(got) == brute(rows, 4)
    assert placed(empty) == []


def test_written_shards_hold_every_row(small, tmp_path):
    sharding.write_shards(small, str(tmp_path / "out"), 4).count()
    back = small.sparkSession.read.parquet(str(tmp_path / "out"))
    assert sorted(back.select("row.*").collect()) == sorted(small.collect())
    assert back.select("shard").distinct().count() == 4
