"""The pipeline's stages one by one, and what every query of the package has in common."""

import ast
import glob
import os
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from helpers_llm import texts
from pyspark.sql import functions as F
from test_llm_models import joined
from test_llm_text import deduped, measured, scanned
from tokenizers import Tokenizer

import __spark_entry__
from pressmark.llm import queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_every_operator_is_registered_once():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.statements()) <= set(queries.registered())


def test_native_operators_hold_no_python_functions():
    for name in ("line_dedup", "quality_rules", "secret_scan"):
        source = open(f"{ROOT}/pressmark/llm/{name}.py").read()
        assert not re.search(r"InPandas|InArrow|pandas_udf|\budf\b|\.rdd\b", source)


def test_nothing_else_in_the_library_imports_the_package():
    for path in glob.glob(f"{ROOT}/pressmark/**/*.py", recursive=True):
        if "/llm/" not in path:
            for node in ast.walk(ast.parse(open(path).read())):
                named = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n or "corpus_pipeline" in n for n in named)


def kept(docs):
    return [r for r in docs if measured(r["text"])[0] >= 10 and measured(r["text"])[4] * 5 <= measured(r["text"])[0]]


def test_stages_equal_brute_force(spark):
    """With few labels no cutoff is guaranteed, so the quality stage is its base rules."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    quality = stage["quality"](spark, docs, SF)
    assert Counter(map(tuple, quality.collect())) == Counter(tuple(r) for r in kept(docs.collect()))
    lines = stage["lines"](spark, quality, SF)
    hashes = {r["text"]: r["h"] for r in quality.select("text", F.xxhash64("text").alias("h")).collect()}
    want = [(i, t) for i, t, _, _ in deduped(texts(quality), hashes) if t and re.search(r"\S", t, re.A)]
    assert Counter(texts(lines)) == Counter(want) and lines.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = stage["near_duplicates"](spark, lines, SF)
    groups = joined(texts(lines))
    assert Counter(i for i, _ in texts(near)) == Counter(i for i, _, c, _ in groups if i == c) and near.columns == docs.columns
    clean = stage["secrets"](spark, near, SF)
    assert clean.columns == docs.columns and not any(scanned(t)[0] for _, t in texts(clean))
    before = dict(texts(near))
    assert all(t == before[i] for i, t in texts(clean) if not scanned(before[i])[1])
    packed = stage["packing"](spark, clean, SF).toPandas()
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(full.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(clean)}
    assert packed.groupby("doc_id")["length"].sum().to_dict() == sizes


def test_the_whole_pipeline_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, docs.collect()))


@pytest.mark.parametrize("name", ["quality", "lines", "near_duplicates", "secrets", "packing"])
def test_stages_take_odd_and_no_documents(spark, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = stage(spark, odd, SF)
    assert stage(spark, empty, SF).count() == 0
    if name != "packing":
        assert rows.columns == odd.columns
    ids = Counter(r["doc_id"] for r in rows.collect())
    if name == "near_duplicates":
        # copies of 7 and its upper-case form 9 are one group; the other text under 7 stays
        assert ids[7] == 2 and ids[9] == 0 and ids[2] == 1 and ids[8] == 1 and ids[None] == 2
    if name in ("secrets", "packing"):
        assert set(ids) == {r["doc_id"] for r in odd.collect()}
