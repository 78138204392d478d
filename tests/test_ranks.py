"""Tails against known values, rank tests and quantiles against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxstrata.functions import distributions as D
from voxstrata.operators import statistics as T


def test_tails():
    assert D.chi_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and D.chi_upper(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert D.chi_upper(9.487729, 4) == pytest.approx(0.05, abs=1e-6) and D.chi_upper(0, 3) == 1
    assert D.f_upper(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6) and D.f_upper(2.0**2, 1, 10) == pytest.approx(D.t_two_sided(2, 10))
    assert D.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5) and D.t_quantile(0.975, 0) == 1
    assert D.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_exact_rank_sum_counts_all_arrangements():
    us = [sum(x > y for x in part for y in set(range(9)) - set(part)) for part in itertools.combinations(range(9), 4)]
    for u in range(21):
        top = max(u, 20 - u)
        assert D.rank_sum_exact(u, 4, 5) == pytest.approx(min(1, 2 * np.mean([v >= top for v in us])))


def test_rank_sums_small_groups_exact_and_least(spark):
    rows = [("w", g, float(v)) for g, vs in {"a": [1, 3, 5], "b": [2, 4, 6, 8], "c": [9]}.items() for v in vs] + [("w", "a", None)]
    got = T.rank_sums(spark.createDataFrame(rows, "w string, g string, v double"), "v", "g", ["w"], least=2, exact=True).collect()
    assert [(r["a"], r["b"], r["u"], r["n_a"], r["n_b"]) for r in got] == [("a", "b", 3.0, 3, 4)]
    assert got[0]["p"] == pytest.approx(D.rank_sum_exact(3, 3, 4))


def test_all_equal_and_empty(spark):
    same = spark.createDataFrame([(0, g, 1.0) for g in "aabb"], "w int, g string, v double")
    r = T.kruskal(same, ["w"], "v", "g").first()
    assert r["h"] is None and r["p"] is None
    assert T.rank_sums(same, "v", "g").first()["p"] is None
    assert T.kruskal(same.limit(0), ["w"], "v", "g").count() == 0 and T.quantiles(same.limit(0), ["w"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("root", [2, 16])
def test_cumulated_counts(spark, root):
    v = np.random.default_rng(1).integers(0, 40, 500)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "w int, v double")
    for r in T.cumulated(df, ["w"], "v", root=root).collect():
        part = v[r["w"] :: 2]
        assert r["t"] == (part == r["v"]).sum() and r["below"] == (part < r["v"]).sum() and r["whole"] == 250


def test_quantiles_and_boxes(spark):
    v = [*np.random.default_rng(2).normal(size=201), 9.0, -9.0]
    df = spark.createDataFrame([(0, float(x)) for x in v] + [(0, None), (1, 5.0)], "w int, v double")
    got = {r["w"]: r for r in T.box_stats(df, ["w"], "v").collect()}
    assert [got[0][k] for k in ("q1", "median", "q3")] == pytest.approx(list(np.quantile(v, [0.25, 0.5, 0.75])))
    assert got[0]["n_outliers"] >= 2 and got[0]["whisker_high"] < 9 and got[1]["median"] == 5 and got[1]["n_outliers"] == 0
    panels = df.withColumn("panel", F.lit("p"))
    marks = spark.createDataFrame([(0, "p", 2)], "w int, panel string, n_marks int")
    r = T.axis_limits(panels, ["w"], "panel", "v", marks).where("w = 0").first()
    assert r["low"] == pytest.approx(-9.9) and r["high"] == pytest.approx(9 + 18 * 0.72) and math.isfinite(r["high"])
