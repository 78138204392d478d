"""Stability selection on planted features, and the fit against its optimality conditions."""

import numpy as np

from voxstrata.operators import relational as R
from voxstrata.operators import stability as V


def test_planted_features_are_kept(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    data = [(int(i), "abc"[k], float(k + 0.3 * rng.normal()), float(rng.normal()), 1.0) for i, k in enumerate(y)] + [(999, None, 0.0, 0.0, 0.0), (998, "a", None, 0.0, 0.0)]
    df = spark.createDataFrame(data, "id int, y string, good double, noise double, constant double")
    features = ["good", "noise", "constant"]
    sample = V.class_sample(df, "y", ["a", "b", "c"], features, ["id"], most=100)
    assert sample.groupBy("__class").count().where("count > 100").count() == 0 and sample.count() == 300
    got = {r["feature"]: r for r in V.scores(V.replicates(sample, features, 12, [0.8, 1.0], c=0.1), [0.8, 1.0]).collect()}
    assert got["good"]["mean_pi"] == 1.0 and got["good"]["label"] == "High"
    assert got["noise"]["mean_size"] < 0.2 * got["good"]["mean_size"] and got["constant"]["mean_pi"] == 0


def test_one_class_gives_nothing(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "id int, y string, x double")
    assert V.replicates(V.class_sample(df, "y", ["a", "b"], ["x"], ["id"]), ["x"], 3, [1.0], 0.1).count() == 0


def test_fit_is_optimal():
    rng = np.random.default_rng(1)
    x, y, c, ratio = rng.normal(size=(90, 4)), np.repeat([0, 1, 2], 30), 0.2, 0.7
    x[:, 0] += y

    def loss(b, shift):
        s = x @ b + shift
        p = s - np.log(np.exp(s).sum(1, keepdims=True))
        return -p[np.arange(90), y].mean() + (ratio * np.abs(b).sum() + (1 - ratio) / 2 * (b * b).sum()) / (c * 90)

    b = V.elastic_net(x, y, 3, c, ratio, 5000)

    def least(b):  # the best shift for these coefficients
        shift = np.zeros(3)
        for _ in range(2000):
            s = np.exp(x @ b + shift)
            shift -= (s / s.sum(1, keepdims=True)).mean(0) - 1 / 3
        return loss(b, shift)

    best = least(b)
    for _ in range(20):
        assert least(b + 0.02 * rng.normal(size=b.shape)) > best - 1e-9


def test_correlated_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7)) for i in range(20)], "a double, b double, c double")
    assert R.correlated(R.correlations(df, ["a", "b", "c"]), {"a": 1.0, "b": 4.0, "c": 2.0}, ["a", "b", "c"]) == ["a"]


def clustered(spark):
    """good tells classes apart everywhere, own only within one subject that has most rows."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(600):
        k, big = i % 3, i >= 150
        s = "big" if big else f"s{i % 10}"
        data.append((i, s, "abc"[k], float(0.8 * k + rng.normal()), float((0.9 * k if big else 0) + rng.normal()), float(rng.normal())))
    return spark.createDataFrame(data, "id int, s string, y string, good double, own double, noise double")


def test_strength_cap_and_decisions(spark):
    features = ["good", "own", "noise"]
    sample = V.class_sample(clustered(spark), "y", ["a", "b", "c"], features, ["id"], subject="s")
    strength = {r["ratio"]: r["c"] for r in V.chosen_strength(sample, features, [0.5, 1.0], (1e-3, 1e-2, 0.1, 1.0)).collect()}
    assert set(strength) == {0.5, 1.0} and all(1e-3 < c <= 1 for c in strength.values())
    y, s = np.array([0, 1] * 50), np.array(["x"] * 80 + [f"z{i}" for i in range(20)])
    rows = V.drawn(y, s, 2, 0.7, 15, np.random.default_rng(1))
    assert len(rows) == 50 and len(set(rows)) == 50
    pool = V.subject_sample(clustered(spark), "y", ["a", "b", "c"], features, ["id"], "s", 15)
    free, held = (V.scores(V.replicates(rows, features, 8, [0.5, 1.0], strength, cap=cap), [0.5, 1.0]) for rows, cap in ((sample, None), (pool, 15)))
    got = {r["feature"]: r for r in V.decisions(free, held).collect()}
    assert got["good"]["decision"] == "Strong" and got["good"]["capping"] == "Stable"
    assert got["own"]["held"] <= got["own"]["free"]


def test_cap_is_applied_before_the_bound(spark):
    """A subject with nine tenths of all rows has no more of them in the pool than any other, whatever the number of rows."""
    for n in (2_000, 40_000):
        df = spark.range(n).selectExpr("id", "if(id % 10 < 9, 'big', concat('s', id % 100)) AS s", "if(hash(id) % 2 = 0, 'a', 'b') AS y", "double(id % 7) AS x")
        df = df.unionAll(df.limit(5).selectExpr("id", "string(null)", "y", "x"))
        got = {(r["__class"], r["__subject"]): r["count"] for r in V.subject_sample(df, "y", ["a", "b"], ["x"], ["id"], "s", cap=2).groupBy("__class", "__subject").count().collect()}
        assert len(got) == 22 and max(got.values()) == V.POOL * 2 and got["a", "big"] == got["b", "big"] == V.POOL * 2
    few = V.subject_sample(df, "y", ["a", "b"], ["x"], ["id"], "s", cap=2, most=20).groupBy("__class").count().collect()
    assert {r["count"] for r in few} == {20}
    assert V.subject_sample(df.limit(0), "y", ["a", "b"], ["x"], ["id"], "s", cap=2).count() == 0


def test_decision_rules(spark):
    free = spark.createDataFrame([("a", 0.9, "High"), ("b", 0.6, "Moderate"), ("c", 0.9, "High"), ("d", 0.2, "Low")], "feature string, mean_pi double, label string")
    held = spark.createDataFrame([("a", 0.8), ("b", 0.45), ("c", 0.3), ("e", 0.9)], "feature string, mean_pi double")
    got = {r["feature"]: (r["capping"], r["decision"]) for r in V.decisions(free, held).collect()}
    assert got == {"a": ("Stable", "Strong"), "b": ("Stable", "Moderate"), "c": ("Subject-dominated", "Exploratory"), "d": ("Stable", "Exclude"), "e": ("Stable", "Exclude")}


def test_shadow_forest(spark):
    from voxstrata.operators import shadows as H

    features = ["good", "noise", "constant"]
    rng = np.random.default_rng(6)
    data = [(i, "ab"[i % 2], float(i % 2 + 0.5 * rng.normal()), float(rng.normal()), 1.0) for i in range(300)]
    df = spark.createDataFrame(data, "id int, y string, good double, noise double, constant double")
    got = {r["feature"]: r for r in H.shadow_forest(V.class_sample(df, "y", ["a", "b"], features, ["id"]), features, rounds=10, trees=15).collect()}
    assert got["good"]["decision"] == "Confirmed" and got["good"]["hits"] == 10
    assert got["constant"]["decision"] == "Rejected" and got["noise"]["decision"] != "Confirmed"
    assert H.shadow_forest(V.class_sample(df, "y", ["a"], features, ["id"]), features).count() == 0
    assert all(H.verdict(H.enough(k), H.enough(k), k) == "Confirmed" and H.verdict(H.enough(k) - 1, H.enough(k) - 1, k) == "Tentative" for k in (1, 4, 474))
    assert H.at_least(0, 5) == 1 and H.at_least(5, 5) == 1 / 32
