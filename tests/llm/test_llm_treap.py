"""The treap search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers_llm import prose, texts

from pressmark.llm import lexical_treap as lt


def brute(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    found = Counter()
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(split(text)) if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            found[(item, rank, i, -score)] += 1
    return found


def asked(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("block,cells", [(lt.BLOCK_DOCS, lt.CELLS_AT_ONCE), (3, 1)])
def test_ranks_equal_scoring_all_documents(spark, odd, small, monkeypatch, block, cells):
    monkeypatch.setattr(lt, "BLOCK_DOCS", block)
    monkeypatch.setattr(lt, "CELLS_AT_ONCE", cells)
    queries = [(1, prose(30, 1)), (2, None), (3, ""), (4, "文字 ſ k x"), (None, "one"), (5, "nothing here 77777"), (6, prose(9, 5)), (6, "x")]
    got = Counter(tuple(r) for r in lt.search(odd, asked(spark, queries), 4).collect())
    assert got == brute(texts(odd), queries, 4)
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    want = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    docs = small.union(small.limit(20))
    assert Counter(tuple(r) for r in lt.search(docs, asked(spark, want)).collect()) == brute(texts(docs), want, lt.K)


def test_items_in_blocks_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(lt, "ITEMS_AT_ONCE", 2)
    monkeypatch.setattr(lt, "PART", 16)
    rows = [(n, "alpha beta gamma " * 9) for n in range(300)] + [(n, prose(30, n)) for n in range(300, 360)]
    queries = [(n, prose(12, n)) for n in range(7)] + [(9, "alpha beta")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter(tuple(r) for r in lt.search(docs, asked(spark, queries)).collect()) == brute(rows, queries, lt.K)


def test_the_tree_keeps_every_cell_and_prunes(monkeypatch):
    monkeypatch.setattr(lt, "CELLS_AT_ONCE", 64)
    rng = np.random.default_rng(1)
    cells = np.unique(rng.integers(0, 64 * 512, 4000))
    rows, cols, impacts = cells // 512, cells % 512, rng.integers(1, 1000, len(cells))
    impacts[cols == 77] += 100_000
    masks, values = lt.Treap.build(rows, cols, impacts, 9)
    tree = lt.Treap.unpacked(9, *lt.Treap.packed(masks, values))
    assert [v[:-1].tolist() for v in tree.values] == [v.tolist() for v in values] and len(values[9]) == len(cells)
    path, best = np.arange(0, 64, 2), lt.Best(1)
    seen = lt.descend(tree, path, np.arange(512), np.zeros(512, bool), best)
    total = np.bincount(cols[rows % 2 == 0], impacts[rows % 2 == 0], 512)
    assert (best.score[0], best.id[0]) == (total.max(), 77) and seen < 60


def test_empty_tables(spark, empty, small):
    assert lt.search(empty, asked(spark, [(1, "x")])).collect() == []
    assert lt.search(small, asked(spark, [(1, "x")]).where("false")).collect() == []
