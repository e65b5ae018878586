"""N-gram join, components, nearest neighbours, quality classifier and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from helpers_llm import prose, texts
from pyspark.sql import functions as F

from pressmark.llm import ann_tree, knn_quality, ngram_join, wordtable
from pressmark.llm.components import connected


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def joined(rows, percent=75):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            smallest[find(i)].append(d)
    return Counter((d, len(sets[i]), (min(smallest[find(i)], default=None) if sets[i] else d), links[i]) for i, (d, _) in enumerate(rows))


def found(docs, **options):
    none = lambda x: None if pd.isna(x) else int(x)
    return Counter((none(r.doc_id), r.n_shingles, none(r.component_id), r.n_links) for r in ngram_join.ngram_join(docs, **options).toPandas().itertuples())


def variants(base, n, changed, seed):
    rng = random.Random(seed)
    for _ in range(n):
        words = base.split()
        for _ in range(changed):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


def family():
    """Chains, groups near the threshold, one passage in many texts, copies of one text."""
    out, rng = [], random.Random(4)
    for g in range(6):
        base = prose(rng.choice([20, 60, 150, 400]), 500 + g)
        for k in range(8):
            out += variants(base, 2, k, g * 10 + k)
    passage = prose(50, 77)
    out += [prose(rng.randrange(5, 200), 600 + i) + " " + passage + " " + prose(5, 700 + i) for i in range(30)]
    out += [prose(30, 1)] * 25 + ["a b c d"] * 3 + ["a b c d e"] * 3 + ["a b c"] * 2
    words = [f"v{i}" for i in range(200)]
    for i in range(25):  # a chain: neighbours link, ends do not
        words[i * 5] = f"z{i}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("percent", [75, 50])
def test_links_equal_brute_force(spark, odd, small, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "RANGE_TOKENS", 5_000)
    docs = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(family())], "doc_id bigint, text string")
    docs = docs.unionByName(odd.select("doc_id", "text")).unionByName(small.select("doc_id", "text"))
    assert found(docs, percent=percent) == joined(texts(docs), percent)


def test_common_ngrams_and_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 5)
    monkeypatch.setattr(ngram_join, "PROBES", 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(family())], "doc_id bigint, text string").coalesce(1)
    rows = texts(docs)
    tokens = sum(int(min(ngram_join.looked_at(len(grams(t))), len(grams(t)))) for _, t in rows)
    assert len(ngram_join.common_tokens(docs, tokens, 5, 75)) > 10
    assert found(docs) == joined(rows)


def test_looked_at_parts_share_what_they_must():
    n = np.arange(1, 3000)
    k, need, look = ngram_join.shared(n), ngram_join.needed(n), ngram_join.looked_at(n)
    assert (np.diff(k) >= 0).all() and (k <= need).all() and (k >= 1).all() and (look >= k).all() and (look <= n).all()


def test_many_texts_under_one_id_or_none(spark):
    """No step pairs the rows of an id with all of its classes."""
    made = [(None, t) for t in family()[:60]] + [(3, t) for t in family()[20:80]] + [(None, "a b c")] * 4
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    assert found(docs) == joined(texts(docs))
    rows = ngram_join.ngram_join(docs).collect()
    want = Counter(grams(t) for _, t in made)
    assert len(rows) == len(made) and len({r["component"] for r in rows}) <= len(want)


def test_no_documents_have_no_links(empty):
    assert ngram_join.ngram_join(empty).count() == 0


def test_trees_find_all_pairs():
    rng = np.random.default_rng(0)
    for percent in (40, 75, 100):
        base = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(40)]
        base += [base[i][: max(1, len(base[i]) - 2)] for i in range(20)] + base[:3]
        got = {(i, int(j)) for i, linked in ngram_join.join_blocks(base, base, percent) for j in linked}
        want = {(i, j) for i in range(len(base)) for j in range(len(base))
                if 100 * len(np.intersect1d(base[i], base[j])) >= percent * len(np.union1d(base[i], base[j]))}
        assert got == want


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    made = [prose(50, i) for i in range(20)] + ["", "é ü", "a" * 5000, " x", "x "]
    words = wordtable.words_of(pa.array([*made, None]), wordtable.NOT_SPACE)
    got, want = defaultdict(set), []
    for text in made:
        want += text.split()
    hashes = words.hashes().tolist()
    assert len(hashes) == len(want) and words.counts().tolist() == [len(t.split()) for t in made] + [0]
    for h, w in zip(hashes, want):
        got[h].add(w)
    assert all(len(x) == 1 for x in got.values()) and len(got) == len(set(want))
    assert wordtable.hash_of("beta") == int(wordtable.words_of(pa.array(["alpha BETA"]), wordtable.NOT_SPACE).hashes()[1])


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(50)] + [(5, 5), (2000, 2001), (2001, 2000), (2000, 2001)]
    edges += [(3000 + rng.randrange(60), 3000 + rng.randrange(60)) for _ in range(50)]
    rows = connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    label = {r["node"]: r["component"] for r in rows}
    assert len(label) == len(rows)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups, mine = defaultdict(set), defaultdict(set)
    for x in root:
        groups[find(x)].add(x)
    for x, c in label.items():
        mine[c].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- nearest neighbours ---------------------------------------------------------------

VECTORS = "vec_id bigint, vector array<double>"


def nearest(rows, queries, k):
    out = {}
    for q, v in queries.items():
        if v is None:
            continue
        scores = sorted((-float((np.array(x) * np.array(v)).sum()), i) for i, x in rows.items() if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def answers(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(out)


def test_all_leaves_give_the_exact_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(ann_tree, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(2)
    base = rng.integers(-3, 4, (300, 6)).astype(float)
    base[:60] = base[0] + 0.0  # a third of the rows nearly alike, many ties
    rows = {i: v.tolist() for i, v in enumerate(base) if v.any()}
    bad = [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]),
           (905, [1.0, 2.0]), (None, [1.0] * 6), (906, [])]
    vectors = spark.createDataFrame([*rows.items(), *list(rows.items())[:5], *bad], VECTORS).withColumn("leaf", F.lit(1)).withColumn("query", F.lit("x"))
    got = answers(ann_tree.search(vectors, vectors.where("vec_id % 5 = 0 OR vec_id > 890"), recall=1.0, leaf=20))
    want = nearest(rows, {q: rows[q] for q in rows if q % 5 == 0}, 20)
    assert got.keys() == want.keys()
    assert all(g == pytest.approx(s, abs=1e-12) for q in want for (_, g), (_, s) in zip(got[q], want[q]))
    right = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want))
    assert right > 0.95
    exact = answers(ann_tree.search(vectors, vectors.where("vec_id % 5 = 0"), leaf=10**6))
    assert {q: [i for i, _ in a] for q, a in exact.items()} == {q: [i for i, _ in a] for q, a in want.items()}


def test_few_vectors_and_none(spark):
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], VECTORS)
    assert answers(ann_tree.search(two, two)) == {1: [(2, 0.5)], 2: [(1, 0.5)]}
    assert ann_tree.search(two.where("false"), two).count() == 0
    assert ann_tree.search(two, two.where("false")).count() == 0
    one = two.where("vec_id = 1")
    assert ann_tree.search(one, one).count() == 0


def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = {r["vec_id"]: np.array(r["vector"]) for r in vectors.collect()}
    got = answers(ann_tree.search(vectors, vectors.where("vec_id % 20 = 0"), leaf=64))
    want = nearest(rows, {q: rows[q] for q in rows if q % 20 == 0}, 20)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9


# --- quality classifier ---------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = knn_quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() >= 0.93
    good, poor = rows[rows["quality"] == 1], rows[rows["quality"] == 0]
    assert (good["predicted"] == 1).mean() >= 0.98 and (poor["predicted"] == 0).mean() >= 0.6


def test_labels_of_held_out_rows_change_nothing(spark, small):
    import zlib

    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id bigint, quality int")
    turned = spark.createDataFrame([(i, int(i % 3 > 0) if zlib.crc32(str(i).encode()) % 5 else 1 - int(i % 3 > 0)) for i in range(200)],
                                   "doc_id bigint, quality int")
    a, b = (knn_quality.quality_scores(small.select("doc_id", "text"), x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in a)


def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (8, 0), (8, 1), (None, 1), (4, None), (7, 1), (10, 0)], "doc_id bigint, quality int")
    rows = knn_quality.quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    none = knn_quality.quality_scores(odd, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert knn_quality.quality_scores(empty, labels).count() == 0


def test_cosines_vote_as_brute_force_does():
    rng = np.random.default_rng(0)
    vectors = knn_quality.unit(rng.standard_normal((50, 8))).astype(np.float32)
    labels = rng.integers(0, 2, 50).astype(float)
    counts = rng.random((9, knn_quality.SIZE))
    axes = rng.standard_normal((knn_quality.SIZE, 8))
    model = knn_quality.Model(np.ones(knn_quality.SIZE), axes, vectors, labels)
    x = knn_quality.unit(knn_quality.weighted(counts.copy(), model.idf) @ axes)
    for row, got in zip(x, model.score(counts.copy())):
        cosine = vectors @ row
        near = np.argsort(-cosine)[:knn_quality.NEIGHBOURS]
        vote = np.maximum(cosine[near], 1e-3) ** knn_quality.SHARPNESS
        assert got == pytest.approx((vote * labels[near]).sum() / vote.sum(), rel=1e-4)
