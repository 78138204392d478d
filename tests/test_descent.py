"""Neighbour graphs by descent against exact neighbours; layouts with planted clusters."""

import numpy as np
from pyspark.sql import functions as F

from voxstrata.operators import descent


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def exact(x, k):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def test_descent_finds_nearly_all_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((20, 12))[r.integers(0, 20, 1500)] * 2 + r.standard_normal((1500, 12))
    got = descent.graph(table(spark, x), "vec_id", "embedding", 10, more=0, cell=48, starts=2).toPandas()
    want, d = exact(x, 10)
    lists = got.sort_values(["vec_id", "rank"]).groupby("vec_id")["neighbour"].apply(list)
    recall = np.mean([len(set(lists[i]) & set(want[i])) / 10 for i in range(len(x))])
    started = descent.graph(table(spark, x), "vec_id", "embedding", 10, more=0, cell=48, starts=2, rounds=0).toPandas()
    before = started.groupby("vec_id")["neighbour"].apply(set)
    assert recall >= 0.95 > 0.7 > np.mean([len(before[i] & set(want[i])) / 10 for i in range(len(x))])
    assert len(got) == 15000 and np.allclose(got["distance"], d[got["vec_id"], got["neighbour"]]) and (got["vec_id"] != got["neighbour"]).all()


def test_descent_on_vectors_without_structure(spark):
    """The given vectors: 64 components and hardly any structure, the hard case."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id < 1200")
    got = descent.graph(df, "vec_id", "embedding", 15, cell=128).toPandas()
    rows = df.orderBy("vec_id").toPandas()
    want, _ = exact(np.vstack(rows["embedding"]).astype(float), 15)
    found = got.groupby("vec_id")["neighbour"].apply(set)
    assert np.mean([len(found[i] & set(rows["vec_id"].to_numpy()[want[n]])) / 15 for n, i in enumerate(rows["vec_id"])]) >= 0.9


def test_copies_keys_nulls_and_small_tables(spark):
    r = np.random.default_rng(2)
    x = np.vstack([np.tile(r.standard_normal(5), (300, 1)), r.standard_normal((200, 5)) * 3])  # one vector many times
    df = table(spark, x).unionByName(spark.createDataFrame([(3, [9.0] * 5), (3, [9.0] * 5), (None, [1.0] * 5), (900, None), (901, [1.0]), (902, [float("nan")] * 5)], "vec_id long, embedding array<double>"))
    got = descent.graph(df, "vec_id", "embedding", 4, cell=40).toPandas()
    assert set(got["vec_id"]) == set(range(500)) and (got["vec_id"] != got["neighbour"]).all()
    assert (got[(got["vec_id"] < 300) & (got["vec_id"] != 3)]["distance"] == 0).all()
    few = descent.graph(table(spark, x[300:303]), "vec_id", "embedding", 10).toPandas()
    assert len(few) == 6 and descent.graph(df.limit(0), "vec_id", "embedding", 3).count() == 0


def test_vectors_meet_only_where_one_is_new(spark):
    state = spark.createDataFrame([(1, [2, 3], [False, False]), (2, [1, 3], [False, False]), (3, [1, 2], [False, False]), (4, [5, 1], [True, False]), (5, [4], [False])], "row long, others array<long>, fresh array<boolean>")
    got = {}
    for r in descent._meeting(state, 0, 10).collect():
        got.setdefault(r["row"], set()).add((r["w"], r["fresh"]))
    assert got == {4: {(5, True), (5, False), (1, False)}, 5: {(4, True), (4, False)}}  # 1 to 3 have met
    assert all(r["fresh"] for r in descent._meeting(state, 0, 1).collect())


def test_weights_are_symmetric(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((60, 4))
    w = descent.weights(descent.lists(descent.numbered(table(spark, x), "vec_id", "embedding"), 5)).toPandas()
    m = w.set_index(["row", "other"])["w"]
    assert all(abs(m[i, j] - m[j, i]) < 1e-12 for i, j in m.index) and m.between(0, 1 + 1e-12).all() and (w.groupby("row")["w"].max() > 0.99).all()


def test_curve():
    a, b = descent.curve(0.1)
    assert abs(a - 1.577) < 0.05 and abs(b - 0.895) < 0.03


def test_layout_separates_planted_clusters(spark):
    r = np.random.default_rng(4)
    group = np.arange(240) % 4
    x = 6 * r.standard_normal((4, 10))[group] + r.standard_normal((240, 10))
    out = descent.graph_layout(table(spark, x), "vec_id", "embedding", 8, epochs=12).toPandas().sort_values("vec_id")
    p = out[["x", "y"]].to_numpy()
    assert out["vec_id"].tolist() == list(range(240)) and np.isfinite(p).all()
    near, _ = exact(p, 10)
    assert (group[near] == group[:, None]).mean() > 0.97
    # places follow from the graph: neighbours stay near, by far nearer than any two rows
    gap = np.sqrt(((p[:, None] - p) ** 2).sum(2))
    own, _ = exact(x, 8)
    assert np.median(gap[np.arange(240)[:, None], own]) < 0.4 * np.median(gap)


def test_layout_of_few_rows(spark):
    one = table(spark, np.ones((3, 2)))
    assert descent.graph_layout(one, "vec_id", "embedding", 2, epochs=2).where(F.isnan("x") | F.isnan("y")).count() == 0
    assert descent.graph_layout(one.limit(0), "vec_id", "embedding").count() == 0
