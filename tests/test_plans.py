import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmark.operators import folds
from pressmark.plans import lookup as lk, ranks
from pressmark.plans import quantiles
from pressmark.plans.quantiles import exact_quantiles


@pytest.mark.parametrize("small", [20_000, 5])
def test_cut_values(spark, monkeypatch, small):
    monkeypatch.setattr(ranks, "SMALL", small)
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(-(10**12), 10**12, 3000))
    df = spark.createDataFrame([(int(v), "a" if v % 3 else "b") for v in values], "v bigint, g string")
    n, cuts = ranks.cut_values(df, F.col("v"), ranks.even_starts(7))[""]
    assert n == len(values)
    assert cuts == {r: int(values[r]) for r in ranks.even_starts(7)(n)}
    by = ranks.cut_values(df, F.col("v"), ranks.proportional_starts(4), by=F.col("g"))
    for g, keep in (("a", values % 3 != 0), ("b", values % 3 == 0)):
        part = values[keep]
        assert by[g] == (len(part), {r: int(part[r]) for r in ranks.proportional_starts(4)(len(part))})


def test_folds_have_exact_sizes(spark):
    out = folds.shuffled_folds(spark.range(1003).withColumnRenamed("id", "doc_id"), 10)
    sizes = [r["count"] for r in out.groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [101] * 3 + [100] * 7


def test_holdout_size(spark):
    out = folds.holdout(spark.range(101).withColumnRenamed("id", "doc_id"), 0.2)
    assert out.where("is_test").count() == 21


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = {**{f"n{n}": rng.normal(size=n) for n in (2, 3, 7, 30, 101, 999)}, "x": rng.normal(size=50000), "same": np.full(777, 3.5), "ties": rng.integers(0, 4, 3001).astype(float), "one": np.array([2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "key string, value double")
    p = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r.key: list(r.q) for r in exact_quantiles(df, p).collect()}
    for k, vs in data.items():
        assert np.allclose(got[k], np.quantile(vs, p), atol=1e-12)


def test_a_missed_bracket_is_refined(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    rng = np.random.default_rng(8)
    values = {k: np.sort(rng.normal(size=n) ** 3) for k, n in (("a", 4000), ("b", 3), ("c", 1))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "key string, value double")
    p = [0.1, 0.5, 0.9]
    first = quantiles._bracketed(df, p, None, 5).where("missed")
    assert first.count() > 0, "a sketch this coarse must miss"
    got = {r.key: list(r.q) for r in exact_quantiles(df, p, accuracy=5).collect()}
    for k, vs in values.items():
        assert np.allclose(got[k], np.quantile(vs, p), atol=1e-12)


def test_quantiles_with_left_out_zeros(spark):
    rng = np.random.default_rng(3)
    given = rng.random(700)
    df = spark.createDataFrame([("t", float(v)) for v in given], "key string, value double")
    got = exact_quantiles(df, [0.25, 0.5, 0.75], total=F.lit(1000)).first().q
    assert np.allclose(got, np.quantile(np.concatenate([np.zeros(300), given]), [0.25, 0.5, 0.75]))


@pytest.mark.parametrize("with_frequency", [True, False])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_lookup_equals_plain_join(spark, monkeypatch, with_frequency, how):
    monkeypatch.setattr(lk, "HOT_KEYS", 2)
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(1000)], "id bigint, k string")
    table = spark.createDataFrame(
        [("hot", 1.5, 334)] + [(f"k{i}", float(i), 14) for i in range(40)], "k string, v double, df bigint")
    out = lk.lookup(rows, table, "k", 41, frequency=F.col("df") if with_frequency else None, how=how, limit_bytes=0)
    want = rows.join(table, "k", how)
    assert sorted(map(tuple, out.select("id", "k", "v", "df").collect())) == sorted(
        map(tuple, want.select("id", "k", "v", "df").collect()))
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
