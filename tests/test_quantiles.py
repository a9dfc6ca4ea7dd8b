"""Exact quantiles against numpy."""

import math

import numpy as np
import pytest

from facetflow.operators import stats
from facetflow.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def column(rng, n):
    x = np.concatenate([rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n), np.round(rng.normal(size=n), 1), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]])
    return rng.permutation(x)


def test_quantiles_are_numpys(spark):
    rng = np.random.default_rng(7)
    groups = {"a": column(rng, 400), "b": np.array([3.0]), None: np.array([1.0, 2.0]), "c": np.full(500, 2.5), "d": rng.integers(0, 1 << 40, 300) / 7}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, n double").repartition(6)
    got = {r["g"]: r for r in exact_quantiles(df, "n", SHARES, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g]["n"] == len(x)
        for i, p in enumerate(SHARES):
            s, at = np.sort(x), p * (len(x) - 1)
            low, high = s[math.floor(at)], s[math.ceil(at)]
            want = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
            assert got[g][f"q{i}"] == want or math.isclose(got[g][f"q{i}"], want, rel_tol=1e-12), (g, p)
    least = {r["g"]: r for r in exact_quantiles(df, "n", SHARES, ["g"], discrete=True).collect()}
    for g, x in groups.items():
        assert [least[g][f"q{i}"] for i in range(len(SHARES))] == [np.sort(x)[max(0, math.ceil(p * len(x)) - 1)] for p in SHARES]


def test_quantiles_of_all_rows(spark):
    df = spark.range(1001).selectExpr("cast(id as int) as v")
    assert exact_quantiles(df, "v", [0.5, 0.25]).collect() == [(1001, 500.0, 250.0)]
    assert exact_quantiles(df.filter("v < 0"), "v", [0.5]).collect() == []
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),), (float("nan"),)], "v double")
    row = exact_quantiles(ends, "v", [0.0, 1 / 3, 2 / 3, 1.0]).first()
    assert row[1:4] == (-math.inf, 1.0, math.inf) and math.isnan(row[4])
    with pytest.raises(ValueError):
        exact_quantiles(df, "v", [1.5])


def test_no_task_holds_all_values(spark):
    df = spark.range(100).selectExpr("cast(id as double) as v", "id % 3 as g")
    for made in (exact_quantiles(df, "v", [0.5], ["g"]), stats.box(df, "g", "v"), stats.error_stats(df, "v", "g"), stats.run_summary(df, "v")):
        assert "percentile" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_statistics_of_no_rows(spark):
    none = spark.createDataFrame([], "t double, g double")
    assert set(stats.error_stats(none, "t", "g").first()) == {None}
    assert set(stats.run_summary(none, "t").first()) == {None}
    some = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    assert sorted(map(tuple, stats.box(some, "k", "v").collect())) == [("a", None, None, None, None, None), ("b", 1.0, 1.0, 1.0, 1.0, 1.0)]
