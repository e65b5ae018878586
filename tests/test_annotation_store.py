"""The annotation store: committed appends only, one entry per text, folders by hash prefix."""

import pandas as pd
from pyspark.sql import functions as F

from pressmark.operators import annotation
from pressmark.operators.annotation_store import AnnotationStore

TEXTS = [(1, "One cat."), (2, "Two dogs."), (3, "One cat."), (4, "Three birds."), (5, None)]


def tagger(mark):
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"sha": f["sha"], "tokens": [
                [{"sent_idx": 0, "tok_idx": i, "word": w, "lemma": w, "morph": "", "pos": "", "ner": mark} for i, w in enumerate(t.split())]
                for t in f["text"]]})
    return run


def words(store, docs):
    return {r["doc_id"]: ([t["word"] for t in r["tokens"]], r["tokens"][0]["ner"]) for r in store.hits(docs).collect()}


def test_misses_become_hits_and_the_first_commit_wins(spark, tmp_path):
    store = AnnotationStore(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    assert words(store, docs) == {} and store.misses(docs).count() == 3
    late = annotation.annotate(store.misses(docs), tagger("late")).persist()
    late.count()
    store.annotate(docs.where("doc_id < 3"), tagger("first"))
    store.append(late)
    store.append(late)
    want = {1: (["One", "cat."], "first"), 2: (["Two", "dogs."], "first"), 3: (["One", "cat."], "first"), 4: (["Three", "birds."], "late")}
    assert words(store, docs) == want and store.annotate(docs, tagger("none")) is None
    assert len(store.batches()) == 3
    store.compact()
    store.vacuum()
    assert words(store, docs) == want and len(store.batches()) == 1 and store.entries().count() == 3
    assert store.compact() is None


def test_an_append_without_commit_is_never_read(spark, tmp_path):
    store = AnnotationStore(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    store.annotate(docs.where("doc_id = 1"), tagger("a"))
    half = store._commit
    store._commit = lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost"))
    try:
        store.annotate(docs, tagger("b"))
    except RuntimeError:
        pass
    store._commit = half
    assert set(words(store, docs)) == {1, 3} and store.misses(docs).count() == 2


def test_only_the_needed_folders_are_read(spark, tmp_path):
    store = AnnotationStore(spark, str(tmp_path / "s"))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    store.annotate(docs, tagger("a"))
    few = docs.where("doc_id < 3")
    plan = store.hits(few)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "prefix" in plan.split("PartitionFilters")[1][:400]
    prefixes = [r["p"] for r in few.select(F.sha1("text").substr(1, 2).alias("p")).distinct().collect()]
    assert store.entries(prefixes).count() < 30 and len(words(store, few)) == 3
