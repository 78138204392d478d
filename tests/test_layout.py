"""Neighbours by brute force, and layouts that keep clusters apart."""

import numpy as np
import pytest

from voxstrata.operators import layout as L


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + list(extra), "id long, e array<double>")


def test_neighbours_with_ties_copies_and_faults(spark):
    x = np.random.default_rng(1).integers(0, 3, (60, 3)).astype(float)
    df = frame(spark, x, [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, []), (104, [1.0])])
    got = {}
    for r in L.neighbours(df, "id", "e", 5).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((round(r["distance"], 9), r["neighbour"]))
    assert set(got) == set(range(60))
    for i in got:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert got[i] == sorted((round(float(d[j]), 9), j) for j in range(60) if j != i)[:5]


def test_few_and_no_rows(spark):
    assert L.neighbours(frame(spark, np.zeros((2, 2))), "id", "e", 5).count() == 2
    assert L.neighbours(frame(spark, np.zeros((0, 2))), "id", "e", 5).count() == 0
    assert L.layouts(frame(spark, np.zeros((0, 2))), "id", "e", [(5, 0.1)]).count() == 0
    assert L.layouts(frame(spark, np.zeros((2, 2))), "id", "e", [(5, 0.1)]).count() == 2


def test_curve():
    assert L.curve(0.1) == pytest.approx((1.577, 0.895), abs=0.01)


def test_memberships_add_up():
    d = np.sort(np.random.default_rng(2).random((20, 15)), axis=1) + 1
    assert L.memberships(d).sum(1) == pytest.approx(np.log2(15), rel=1e-3)


@pytest.mark.parametrize("most", [4096, 120])
def test_clusters_stay_apart(spark, most):
    rng = np.random.default_rng(3)
    label = np.arange(240) % 3
    x = rng.normal(size=(240, 8)) + 12 * np.eye(3, 8)[label]
    rows = L.layouts(frame(spark, x), "id", "e", [(10, 0.1), (15, 0.3)], most=most).collect()
    assert len(rows) == 480 and len({(r["id"], r["n_neighbours"]) for r in rows}) == 480
    z = np.array([[r["x"], r["y"]] for r in sorted(rows, key=lambda r: r["id"]) if r["n_neighbours"] == 10])
    d = ((z[:, None] - z[None]) ** 2).sum(2) + np.diag(np.full(240, np.inf))
    near = np.argsort(d, axis=1)[:, :5]
    assert (label[near] == label[:, None]).mean() > 0.97


def test_neighbours_beyond_the_landmarks(spark):
    """All rows are looked at: more rows than landmarks, in clusters, with copies, a repeated key and blocks of every size."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(5000, 6)) + 8 * rng.integers(0, 3, (5000, 1)), 1)
    x[:300] = x[0]
    got = {}
    for r in L.neighbours(frame(spark, x), "id", "e", 7, block=400).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    assert len(got) == 5000
    for i in range(0, 5000, 7):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = [j for j in np.lexsort((np.arange(5000), d)) if j != i][:7]
        mine = sorted(got[i])
        assert [m[2] for m in mine] == pytest.approx(d[want]) and [m[1] for m in mine] == want


def test_a_row_goes_to_few_tiles(spark, monkeypatch):
    """However many blocks are open, a row is sent to no more tiles than there are, and what it finds is exact."""
    x = np.random.default_rng(6).normal(size=(2000, 16))
    sent, kept = [], L.checkpointed

    def watched(df):
        out = kept(df)
        sent.extend(out.selectExpr(f"max(size({c}))").first()[0] for c, t in out.dtypes if t in ("array<int>", "array<bigint>"))
        return out

    monkeypatch.setattr(L, "checkpointed", watched)
    got = {}
    for r in L.neighbours(frame(spark, x), "id", "e", 5, block=40).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert len(sent) == 1 and sent[0] <= 16
    for i in range(0, 2000, 9):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [j for _, j in sorted(got[i])] == np.argsort(d)[:5].tolist()
