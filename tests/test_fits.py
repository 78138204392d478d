"""Recurrences, polynomials, densities and simulated residuals against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxstrata.operators import fits, recurrence


@pytest.mark.parametrize("partitions", [1, 3, 11])
@pytest.mark.parametrize("own", [True, False])
def test_linear_scan_is_the_loop(spark, partitions, own):
    r = np.random.default_rng(partitions)
    rows, want = [], {}
    for g, n in ((None, 7), (1, 400), (2, 1), (3, 40), (4, 3)):  # one group over most partitions
        y = 2.0
        for t in range(n):
            a, b = float(r.uniform(-1.05, 1.05)), float(r.standard_normal())
            a, b = (None if r.random() < 0.05 else a), (None if r.random() < 0.05 else b)
            f = None if own and g == 3 else b
            if t == 0 and own:
                y = 2.0 if f is None else f
            elif a is not None and b is not None:
                y = a * y + b
            rows.append((g, t, a, b, "x"))
            want[g, t] = y
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, t long, a double, b double, y string").repartition(5)
    first = F.when(F.coalesce("g", F.lit(0)) != 3, F.col("b")) if own else None
    out = recurrence.linear_scan(df, ["g"], ["t"], F.col("a"), F.col("b"), 2.0, first, "out", partitions)
    got = {(x["g"], x["t"]): x["out"] for x in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)
    assert out.columns == ["g", "t", "a", "b", "y", "out"]


def test_linear_scan_without_groups_and_rows(spark):
    df = spark.range(100).withColumn("x", F.lit(1.0))
    got = [x["y"] for x in recurrence.linear_scan(df, [], ["id"], F.lit(1.0), F.col("x"), partitions=4).orderBy("id").collect()]
    assert got == [float(i + 1) for i in range(100)]
    assert recurrence.linear_scan(df.limit(0), [], ["id"], F.lit(1.0), F.col("x")).count() == 0


def test_polynomials(spark):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for g, n in (("a", 300), (None, 40), ("few", 3), ("flat", 20)):
        x = np.full(n, 5.0) if g == "flat" else 1e6 + r.uniform(0, 50, n)
        y = 3 + 0.5 * (x - 1e6) - 0.01 * (x - 1e6) ** 2 + r.standard_normal(n)
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
        want[g] = (x, y)
    rows += [("a", None, 1.0), ("a", 1.0, None), ("a", float("nan"), 1.0), ("gone", None, None)]
    got = {(x["g"], x["degree"]): x for x in fits.polynomials(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", [1, 2, 3, 5]).collect()}
    assert len(got) == 16 and ("gone", 1) not in got
    for (g, degree), f in got.items():
        x, y = want[g]
        if g == "flat" or (g == "few" and degree > 2):
            assert f["rmse"] is None and f["coefficients"] is None
            continue
        z = (x - f["middle"]) / f["spread"]
        theirs = np.polyfit(z, y, degree)
        assert f["n"] == len(x) and np.allclose(f["scaled"][::-1], theirs, atol=1e-6)
        assert abs(f["rmse"] - np.sqrt(np.mean((y - np.polyval(theirs, z)) ** 2))) < 1e-6 and len(f["coefficients"]) == degree + 1
    near = spark.createDataFrame([(0, float(x), 2.0 * x * x - 3 * x + 1) for x in range(-5, 6)], "g int, x double, y double")
    f = fits.polynomials(near, ["g"], "x", "y", [2]).first()
    assert np.allclose(f["coefficients"], [2, -3, 1]) and f["rmse"] < 1e-6


def direct(v, points):
    h = (0.75 * len(v)) ** -0.2 * v.std(ddof=1)
    at = np.linspace(v.min(), -v.max() if v.max() < 0 else v.max(), points)
    f = np.exp(-0.5 * ((at[:, None] - v) / h) ** 2).sum(1)
    return f / f.sum()


def test_density_is_near_direct_sums(spark):
    r = np.random.default_rng(2)
    groups = {"n": r.standard_normal(400), "two": np.concatenate([r.standard_normal(30), 8 + r.standard_normal(50)]), "neg": r.uniform(-5, -2, 60), "flat": np.full(9, 3.0), "one": np.array([1.0])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("n", None), ("n", float("inf"))], "g string, v double")
    for points in (None, 50):
        got = {}
        for x in fits.density(df, ["g"], "v", points).collect():
            got.setdefault(x["g"], {})[x["point"]] = x["p"]
        entropy = {x["g"]: x["entropy"] for x in fits.density_entropy(df, ["g"], "v", points).collect()}
        assert got.keys() == entropy.keys() == {"n", "two", "neg", "flat"} and got["flat"] == {0: 1.0} and entropy["flat"] == 0
        for g in ("n", "two", "neg"):
            want = direct(groups[g], points or len(groups[g]))
            have = np.array([got[g].get(i, 0.0) for i in range(len(want))])
            assert np.abs(have - want).max() < 2e-3 * want.max() and abs(have.sum() - 1) < 1e-9
            assert abs(entropy[g] + np.sum(want * np.log2(np.where(want > 0, want, 1))) / np.log2(len(want))) < 1e-3
    gauss = {x["g"]: x["entropy"] for x in fits.normal_entropy(df, ["g"], "v", 40).collect()}
    v = groups["n"]
    f = np.exp(-0.5 * ((np.linspace(v.min(), v.max(), 40) - v.mean()) / v.std()) ** 2)
    assert abs(gauss["n"] + np.sum(f / f.sum() * np.log2(f / f.sum())) / np.log2(40)) < 1e-9 and gauss["flat"] == gauss["one"] == 0


def test_simulated_residuals_tell_true_models_from_wrong_ones(spark):
    r = np.random.default_rng(3)
    n, subjects = 4000, 40
    intercept = 3 * r.standard_normal(subjects)
    rows = [(int(i * 10**10 + 5), int(i % subjects), 2.0, float(2 + intercept[i % subjects] + r.standard_normal())) for i in range(n)]
    df = spark.createDataFrame(rows + [(None, 1, 2.0, 2.0), (1, None, 2.0, 2.0), (2, 1, None, 2.0), (3, 1, 2.0, None)], "id long, subject long, fitted double, y double")

    def gap(x):
        x = np.sort(x)
        return np.abs(x - (np.arange(len(x)) + 0.5) / len(x)).max()

    whole = {x["id"]: x["residual"] for x in fits.simulated_residuals(df.where("id > 3"), "id", "y", "fitted", F.sqrt(F.lit(10.0))).collect()}
    own = spark.createDataFrame([(i, float(2 + 3 * r.standard_normal())) for i in range(n)], "id long, y double").withColumn("fitted", F.lit(2.0))
    true = [x["residual"] for x in fits.simulated_residuals(own, "id", "y", "fitted", F.lit(3.0)).collect()]
    wrong = [x["residual"] for x in fits.simulated_residuals(own, "id", "y", "fitted", F.lit(1.0)).collect()]
    shifted = [x["residual"] for x in fits.simulated_residuals(own, "id", "y", "fitted", F.lit(3.0), seed=9).collect()]
    assert gap(np.array(true)) < 0.03 < 0.15 < gap(np.array(wrong)) and gap(np.array(shifted)) < 0.03 and shifted != true
    # random intercepts: rows of a subject share theirs, so that residuals spread as wide as with the whole variance
    shared = fits.simulated_residuals(df, "id", "y", "fitted", F.lit(1.0), "subject", F.lit(3.0))
    got = {x["id"]: x["residual"] for x in shared.collect()}
    assert got[None] is None and got[2] is None and got[3] is None and 0 <= got[1] <= 1
    assert np.mean([abs(got[i] - whole[i]) for i in whole]) < 0.03
    again = {x["id"]: x["residual"] for x in fits.simulated_residuals(df.repartition(13), "id", "y", "fitted", F.lit(1.0), "subject", F.lit(3.0)).collect()}
    assert again == got
    assert fits.simulated_residuals(df.limit(0), "id", "y", "fitted", F.lit(1.0)).count() == 0


def test_counted_numbers_are_uniform_and_apart():
    u = fits.uniform(fits.keys_of(np.arange(2000)), 200, 0, 1)
    assert abs(u.mean() - 0.5) < 2e-3 and abs(u.var() - 1 / 12) < 1e-3
    v = fits.uniform(fits.keys_of(np.arange(2000)), 200, 1, 1)
    assert abs(np.corrcoef(u.ravel(), v.ravel())[0, 1]) < 0.01 and abs(np.corrcoef(u[:-1].ravel(), u[1:].ravel())[0, 1]) < 0.01
    z = fits.normal(fits.keys_of(np.arange(2000) + (1 << 40)), 200, 2, 7)
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs((z**4).mean() - 3) < 0.1
