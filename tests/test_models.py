"""Random-intercept fits against a dense likelihood and a closed form."""

import numpy as np
import pytest

from voxstrata.functions import distributions as D
from voxstrata.operators import models as M

LEVELS = ["a", "b", "c"]


def rows(seed, subjects, per):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(subjects):
        u = rng.normal() * 0.8
        for i, level in enumerate(LEVELS):
            for _ in range(per if isinstance(per, int) else int(rng.integers(*per))):
                out.append((0, s, level, float(0.5 * i + u + rng.normal())))
    return out


def dense(data, theta):
    y = np.array([r[3] for r in data])
    x = np.array([[r[2] == level for level in LEVELS] for r in data], float)
    s = np.array([r[1] for r in data])
    v = np.eye(len(y)) + theta * (s[:, None] == s[None, :])
    w = np.linalg.inv(v)
    a = x.T @ w @ x
    beta = np.linalg.solve(a, x.T @ w @ y)
    e = y - x @ beta
    rest = len(y) - x.shape[1]
    sigma2 = e @ w @ e / rest
    return rest * np.log(sigma2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + rest, beta, sigma2, np.linalg.inv(a)


def fit(spark, data):
    df = spark.createDataFrame(data, "g int, s int, stage string, value double")
    return {(r["earlier"], r["later"]): r for r in M.random_intercept(df, ["g"], "s", "stage", LEVELS).collect()}


def test_unbalanced_against_dense_likelihood(spark):
    data = rows(3, 12, (1, 5))
    got = fit(spark, data)
    grid = np.exp(np.linspace(-6, 4, 2001))
    theta = min(grid, key=lambda t: dense(data, t)[0])
    _, beta, sigma2, inverse = dense(data, theta)
    r = got["a", "c"]
    assert r["estimate"] == pytest.approx(beta[2] - beta[0], rel=1e-3)
    assert r["residual_variance"] == pytest.approx(sigma2, rel=1e-2) and r["subject_variance"] == pytest.approx(theta * sigma2, rel=2e-2)
    assert r["se"] == pytest.approx(np.sqrt(sigma2 * (inverse[0, 0] + inverse[2, 2] - 2 * inverse[0, 2])), rel=1e-2)


def test_balanced_has_residual_degrees_of_freedom(spark):
    data = rows(5, 10, 4)
    r = fit(spark, data)["a", "b"]
    means = lambda k: np.mean([x[3] for x in data if x[2] == k])
    assert r["estimate"] == pytest.approx(means("b") - means("a"))
    assert not r["singular"] and r["df"] == pytest.approx(len(data) - 10 - 2, rel=1e-2)  # within-subject contrast


def test_student():
    assert D.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert D.t_two_sided(0.0, 3) == 1.0 and D.t_two_sided(12.706205, 1) == pytest.approx(0.05, abs=1e-6)


def test_guards(spark):
    df = spark.createDataFrame([(0, 1, "a", None), (0, 1, "a", 1.0)], "g int, s int, stage string, value double")
    assert M.random_intercept(df, ["g"], "s", "stage", LEVELS).count() == 0
    assert M.random_intercept(df.limit(0), ["g"], "s", "stage", LEVELS).count() == 0


def crossed(seed, drop=None):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(14):
        t, u = "xy"[s % 2], rng.normal() * 0.7
        for i, level in enumerate(LEVELS):
            for _ in range(int(rng.integers(1, 4))):
                if (level, t) != drop:
                    out.append((0, s, level, t, float(0.6 * i * (t == "y") + u + rng.normal() * 0.5)))
    return out


def by_design(data, columns):
    """The dense fit at the best ratio."""
    y, s = np.array([r[4] for r in data]), np.array([r[1] for r in data])
    x = np.array([columns(r[2], r[3]) for r in data], float)
    best = None
    for theta in np.exp(np.linspace(-4, 4, 801)):
        v = np.eye(len(y)) + theta * (s[:, None] == s[None, :])
        w = np.linalg.inv(v)
        a = x.T @ w @ x
        beta = np.linalg.solve(a, x.T @ w @ y)
        rest = len(y) - x.shape[1]
        sigma2 = (y - x @ beta) @ w @ (y - x @ beta) / rest
        deviance = rest * np.log(2 * np.pi * sigma2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + rest
        if best is None or deviance < best[0]:
            best = deviance, beta, sigma2 * np.linalg.inv(a), theta * sigma2
    return best


def model(spark, data):
    df = spark.createDataFrame(data, "g int, s int, at string, t string, value double")
    return {(r["part"], r["name"], r["stage"], r["treatment"]): r for r in M.interaction(df, ["g"], "s", "at", LEVELS, "t", ["x", "y"]).collect()}


def test_interaction_against_dense_fit(spark):
    data = crossed(2)
    got = model(spark, data)
    cells = [(a, t) for a in LEVELS for t in "xy"]
    deviance, beta, v, between = by_design(data, lambda a, t: [(a, t) == c for c in cells])
    for c, b, e in zip(cells, beta, np.sqrt(np.diag(v))):
        assert got["mean", "mean", *c]["estimate"] == pytest.approx(b, abs=2e-3) and got["mean", "mean", *c]["se"] == pytest.approx(e, rel=1e-2)
    l = np.array([[1, -1, -1, 1, 0, 0], [1, -1, 0, 0, -1, 1]], float)
    f = (l @ beta) @ np.linalg.solve(l @ v @ l.T, l @ beta) / 2
    term = got["term", "stage:treatment", None, None]
    assert term["statistic"] == pytest.approx(f, rel=1e-2) and term["df1"] == 2 and 10 < term["df"] < len(data) and term["p"] < 0.05
    assert got["treatment_contrast", "x - y", "c", None]["estimate"] == pytest.approx(beta[4] - beta[5], abs=2e-3)
    assert got["fit", "log_likelihood", None, None]["estimate"] == pytest.approx(-deviance / 2, abs=1e-2)
    assert got["fit", "subject_variance", None, None]["estimate"] == pytest.approx(between, rel=3e-2)


def test_missing_cell_falls_back_to_the_additive_model(spark):
    data = crossed(4, drop=("b", "y"))
    got = model(spark, data)
    assert ("term", "stage:treatment", None, None) not in got and got["fit", "interaction", None, None]["estimate"] == 0
    _, beta, v, _ = by_design(data, lambda a, t: [1, a == "b", a == "c", t == "y"])
    r = got["mean", "mean", "b", "y"]
    c = np.array([1, 1, 0, 1])
    assert r["estimate"] == pytest.approx(c @ beta, abs=3e-3) and r["se"] == pytest.approx(np.sqrt(c @ v @ c), rel=2e-2)


def test_subject_effects_are_shrunk_means(spark):
    df = spark.createDataFrame([(0, s, "a", float(s + k)) for s in range(3) for k in range(2)], "g int, s int, at string, value double")
    fits = spark.createDataFrame([(0, {"a": 1.5}, 1.0, 2.0)], "g int, means map<string,double>, residual_variance double, subject_variance double")
    got = {r["s"]: r["effect"] for r in M.subject_effects(df, ["g"], "s", "at", ["a"], fits).collect()}
    assert got == pytest.approx({s: 2 * 2 * (s + 0.5 - 1.5) / (1 + 2 * 2) for s in range(3)})
