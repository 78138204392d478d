"""Nearest neighbours and two-dimensional layouts of vectors by uniform manifold approximation (McInnes, Healy, Melville).

Neighbours are exact over all rows. Rows are dealt to the cells of pivots, cells to blocks of about ``block`` rows; each
block is searched by itself first, which bounds a row's k-th distance, and the row then visits the tiles (runs of blocks) of
which the triangle inequality leaves a block open. Pivots only route: they change what is looked at, never what is found.
Tiles meet in pairs, so a task holds two of them. A row is sent to each tile at most once and there are ``TILES`` of them, as
long as these have no more than ``TILE`` rows: what is shuffled grows as the rows do, the distances as their square.

A layout, by contrast, is still a fit of at most ``most`` landmarks, taken by the order of a hash over all rows; every other
row is placed among its nearest landmarks, so beyond ``most`` rows the graph behind a layout is not that of all rows.

Defined cases: vectors that are null, of another length than most rows have, or hold null or non-finite components take
no part; repeated rows are neighbours at distance 0, but never those of one key; fewer rows than asked for give as many
neighbours as there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

MOST = 4096
#: Rows whose distances to a block are held at a time, rows of a block, and pivots at most (they go to all tasks).
BLOCK, SIDE, PIVOTS = 512, 2048, 1024
#: Tiles while they are small enough, rows of a tile, columns of a tile at a time, pairs whose differences are held at a time.
TILES, TILE, CHUNK, PAIRS = 16, 65536, 4096, 65536


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.select(F.col(key).cast("long").alias("key"), v.alias("v")).where(F.col("key").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))


def landmarks(df: DataFrame, key: str, vector: str, most: int = MOST, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of at most ``most`` rows, by key."""
    x = usable(df, key, vector)
    held = x.orderBy(F.xxhash64(F.lit(seed), "key"), "key", "v").limit(most).toPandas()
    if not len(held):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    lengths = held["v"].map(len)
    held = held[lengths == lengths.mode()[0]].sort_values("key", kind="stable")
    return held["key"].to_numpy(np.int64), np.vstack(held["v"].to_numpy())


def numbered(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, key, v) of the rows that take part, each with a number of its own."""
    x = usable(df, key, vector)
    usual = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return checkpointed(x.where(F.size("v") == (usual["n"] if usual else 0)).withColumn("row", F.monotonically_increasing_id()))


def some_rows(rows: DataFrame, most: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, keys and vectors of at most ``most`` rows, by key."""
    held = rows.orderBy(F.xxhash64(F.lit(seed), "key"), "key", "v").limit(most).toPandas().sort_values("key", kind="stable")
    v = np.vstack(held["v"].to_numpy()) if len(held) else np.zeros((0, 0))
    return held["row"].to_numpy(np.int64), held["key"].to_numpy(np.int64), v


def nearest_of(keys: np.ndarray, x: np.ndarray, at: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest rows of y to each row of x, its own key left out; ties go to the smaller key.

    The product form picks candidates, with all that lie within its error of the k-th; differences give the distances.
    Where there are fewer, distances are not numbers.
    """
    k = min(k, len(at))
    places, distances = np.zeros((len(x), k), int), np.full((len(x), k), np.nan)
    if not k:
        return places, distances
    yy = (y * y).sum(1)
    for first in range(0, len(x), BLOCK):
        part = x[first : first + BLOCK]
        xx = (part * part).sum(1)[:, None]
        rough = xx + yy - 2 * part @ y.T
        rough[keys[first : first + BLOCK, None] == at] = np.inf
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-9 * (xx[:, 0] + yy.max())
        for i, row in enumerate(rough):
            some = np.flatnonzero((row <= limit[i]) & (row < np.inf))
            d = np.sqrt(((y[some] - part[i]) ** 2).sum(1))
            order = np.lexsort((at[some], d))[:k]
            places[first + i, : len(order)], distances[first + i, : len(order)] = some[order], d[order]
    return places, distances


FOUND = "row long, key long, other long, neighbour long, distance double"


def _found(q: pd.DataFrame, other: np.ndarray, at: np.ndarray, y: np.ndarray, k: int) -> pd.DataFrame:
    keys = q["key"].to_numpy(np.int64)
    places, d = nearest_of(keys, np.vstack(q["v"].to_numpy()), at, y, k)
    flat, wide = places.ravel(), places.shape[1]
    made = pd.DataFrame({"row": np.repeat(q["row"].to_numpy(), wide), "key": np.repeat(keys, wide), "other": other[flat], "neighbour": at[flat], "distance": d.ravel()})
    return made[made["distance"].notna()]


def _searched(k: int):
    def work(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({n: [] for n in ("row", "key", "other", "neighbour", "distance")})
        return _found(q, c["row"].to_numpy(np.int64), c["key"].to_numpy(np.int64), np.vstack(c["v"].to_numpy()), k)

    return work


def within(x: np.ndarray, y: np.ndarray, limit: np.ndarray, barred, order: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in x, places in y and distances of the k nearest rows of y to each row of x, none farther than its limit.

    Limits close in from chunk to chunk. barred(i, j) tells pairs that don't count; ties go by ``order``, columns of y.
    """
    yy = (y * y).sum(1)
    out = []
    for first in range(0, len(x), BLOCK):
        part, reach = x[first : first + BLOCK], limit[first : first + BLOCK].copy()
        xx = (part * part).sum(1)
        i, j, d = np.empty(0, int), np.empty(0, int), np.empty(0)
        for begin in range(0, len(y), CHUNK):
            own = yy[begin : begin + CHUNK]
            rough = part @ y[begin : begin + CHUNK].T
            rough *= -2
            rough += own
            error = 1e-9 * (xx + own.max())
            bad_i, bad_j = barred(slice(first, first + BLOCK), slice(begin, begin + CHUNK))
            rough[bad_i, bad_j] = np.inf
            top = reach * reach * (1 + 1e-9) + error - xx
            loose = np.flatnonzero(np.isinf(reach))
            if len(loose) and rough.shape[1] > k:
                top[loose] = np.partition(rough[loose], k - 1, axis=1)[:, k - 1] + 2 * error[loose]
            near_i, near_j = np.nonzero((rough <= top[:, None]) & (rough < np.inf))
            if not len(near_i):
                continue
            gaps = [np.sqrt(((y[begin + near_j[s : s + PAIRS]] - part[near_i[s : s + PAIRS]]) ** 2).sum(1)) for s in range(0, len(near_i), PAIRS)]
            i, j, d = np.concatenate([i, near_i]), np.concatenate([j, begin + near_j]), np.concatenate([d, *gaps])
            by = np.lexsort((*(c[j] for c in reversed(order)), d, i))
            i, j, d = i[by], j[by], d[by]
            starts = np.searchsorted(i, np.arange(len(part)))
            kept = np.arange(len(i)) - starts[i] < k
            full = np.flatnonzero(np.diff(np.append(starts, len(i))) >= k)
            reach[full] = np.minimum(reach[full], d[starts[full] + k - 1])
            i, j, d = i[kept], j[kept], d[kept]
        fine = d <= reach[i]
        out.append((first + i[fine], j[fine], d[fine]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _visited(k: int):
    def work(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({n: [] for n in ("row", "key", "other", "neighbour", "distance")})
        keys, home, row = (q[n].to_numpy(np.int64) for n in ("key", "home", "row"))
        at, block, other = (c[n].to_numpy(np.int64) for n in ("key", "block", "row"))
        # its own block has been searched, and rows of its own key don't count
        barred = lambda i, j: np.nonzero((keys[i, None] == at[j]) | (home[i, None] == block[j]))
        i, j, d = within(np.vstack(q["v"].to_numpy()), np.vstack(c["v"].to_numpy()), q["bound"].to_numpy(), barred, (at, other), k)
        return pd.DataFrame({"row": row[i], "key": keys[i], "other": other[j], "neighbour": at[j], "distance": d})

    return work


def nearest(rows: DataFrame, k: int, block: int = SIDE) -> DataFrame:
    """(row, key, rank, other, neighbour, distance): the nearest of all rows to every row. rows: as ``numbered`` makes them."""
    spark = rows.sparkSession
    n = rows.count()
    _, _, pivots = some_rows(rows, max(1, min(PIVOTS, -(-n // block))), 1)
    pivots = np.unique(pivots, axis=0) if len(pivots) else pivots
    sent = spark.sparkContext.broadcast(pivots)

    def away(frame: pd.DataFrame) -> np.ndarray:
        v = np.vstack(frame["v"].to_numpy())
        return np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in sent.value], 1)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                d = away(f)
                cell = d.argmin(1)
                yield f[["row", "key", "v"]].assign(cell=cell.astype(np.int32), radius=d[np.arange(len(f)), cell])

    dealt = checkpointed(rows.select("row", "key", "v").mapInPandas(deal, "row long, key long, v array<double>, cell int, radius double"))
    # a row for each cell; cells beyond a block are cut by a hash
    cells = [(r["cell"], r["low"], r["high"], max(1, -(-r["n"] // block))) for r in dealt.groupBy("cell").agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.count("*").alias("n")).orderBy("cell").collect()]
    first, total = [], 0
    for _, _, _, parts in cells:
        first.append(total)
        total += parts
    begin = spark.createDataFrame([(c[0], b, c[3]) for c, b in zip(cells, first)], "cell int, begin long, parts long")
    dealt = checkpointed(dealt.join(F.broadcast(begin), "cell").select("row", "key", "v", (F.col("begin") + F.pmod(F.xxhash64("row"), "parts")).alias("block")))

    own = checkpointed(dealt.groupBy("block").applyInPandas(lambda f: _searched(k)(f, f), FOUND))
    bounds = own.groupBy("row").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))
    asked = dealt.join(bounds, "row", "left").select("row", "key", "v", F.col("block").alias("home"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    # runs of blocks, about as many rows in each
    tiles = max(1, min(TILES, total), -(-n // TILE))
    table = spark.sparkContext.broadcast(([c[0] for c in cells], np.array([c[1] for c in cells]), np.array([c[2] for c in cells]), np.array(first), np.array([c[3] for c in cells])))
    tile_of = lambda c: F.floor(F.col(c) * tiles / max(total, 1)).cast("int")

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, low, high, begin, parts = table.value
        owner = np.repeat(np.arange(len(parts)), parts)  # the cell of each block
        tile = np.arange(len(owner)) * tiles // max(total, 1)
        for f in frames:
            if len(f):
                d = away(f)[:, cell]
                # no row of the cell is nearer than this
                least = np.maximum(d - high, low - d) - 1e-9 * (1 + d + high)
                open_ = (least <= f["bound"].to_numpy()[:, None])[:, owner]
                open_[np.arange(len(f)), f["home"].to_numpy()] = False
                yield f.assign(tiles=[np.unique(tile[o]) for o in open_])

    asked = asked.mapInPandas(visit, "row long, key long, v array<double>, home long, bound double, tiles array<int>")
    left = checkpointed(asked.select("row", "key", "v", "home", "bound", tile_of("home").alias("mine"), "tiles"))
    pairs = F.broadcast(left.select(F.col("mine").alias("asker"), F.explode("tiles").alias("target")).distinct())  # tiles times tiles
    left = left.select("row", "key", "v", "home", "bound", "mine", F.explode("tiles").alias("tile"))
    held = dealt.withColumn("target", tile_of("block")).join(pairs, "target")
    rest = left.groupBy("mine", "tile").cogroup(held.select("row", "key", "v", "block", "asker", "target").groupBy("asker", "target")).applyInPandas(_visited(k), FOUND)
    best = Window.partitionBy("row").orderBy("distance", "neighbour", "other")
    return own.unionAll(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("row", "key", "rank", "other", "neighbour", "distance")


def neighbours(df: DataFrame, key: str, vector: str, k: int, block: int = SIDE) -> DataFrame:
    """(key, rank, neighbour, distance): the nearest of all rows to every row, by Euclidean distance."""
    return nearest(numbered(df, key, vector), k, block).select(F.col("key").alias(key), "rank", "neighbour", "distance")


def memberships(d: np.ndarray) -> np.ndarray:
    """exp(-(d - nearest) / scale), the scale such that each row's memberships add up to log2 of their number."""
    beyond = np.maximum(d - d[:, :1], 0)
    low, high = np.full(len(d), 1e-12), np.full(len(d), max(float(d.max(initial=1.0)), 1e-6) * 1e3)
    for _ in range(64):
        mid = np.sqrt(low * high)
        much = np.exp(-beyond / mid[:, None]).sum(1) > max(np.log2(d.shape[1]), 1.0)
        low, high = np.where(much, low, mid), np.where(much, mid, high)
    scale = np.maximum(high, 1e-3 * d.mean(1) + 1e-12)
    return np.exp(-beyond / scale[:, None])


def curve(least: float, reach: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b) closest to 1 up to ``least`` and exponential decay beyond, by damped least squares."""
    d = np.linspace(0, 3 * reach, 300)[1:]
    target = np.where(d <= least, 1.0, np.exp(-(d - least) / reach))
    p, damp = np.zeros(2), 1e-2  # logarithms of a and b
    fit = lambda p: 1 / (1 + np.exp(p[0]) * d ** (2 * np.exp(p[1])))
    for _ in range(200):
        f = fit(p)
        j = np.column_stack([-f * (1 - f), -f * (1 - f) * 2 * np.exp(p[1]) * np.log(d)])
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), j.T @ (target - f))
        better = ((target - fit(p + step)) ** 2).sum() < ((target - f) ** 2).sum()
        p, damp = (p + step, damp / 3) if better else (p, damp * 3)
    return float(np.exp(p[0])), float(np.exp(p[1]))


def fitted(at: np.ndarray, y: np.ndarray, k: int, least: float, epochs: int, seed: int, negatives: int = 5) -> np.ndarray:
    """Positions of the landmarks: principal axes, then attraction along edges by weight and repulsion from random rows."""
    n = len(at)
    if n < 3:
        return np.zeros((n, 2))
    places, d = nearest_of(at, y, at, y, min(k, n - 1))
    fine = ~np.isnan(d)
    w = np.zeros((n, n), np.float32)  # bounded by the number of landmarks
    np.put_along_axis(w, np.where(fine, places, np.arange(n)[:, None]), np.where(fine, memberships(np.nan_to_num(d)), 0), 1)
    np.fill_diagonal(w, 0)
    w = w + w.T - w * w.T
    head, tail = np.nonzero(w)
    share = w[head, tail] / max(float(w.max()), 1e-12)
    centred = y - y.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    z = np.zeros((n, 2))
    z[:, : min(2, u.shape[1])] = (u * s)[:, :2]
    rng = np.random.default_rng(seed)
    z = 10 * z / max(float(np.abs(z).max()), 1e-12) + rng.normal(scale=1e-4, size=z.shape)
    a, b = curve(least)
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        on = np.flatnonzero(rng.random(len(head)) < share)
        i, j = head[on], tail[on]
        gap = z[i] - z[j]
        d2 = np.maximum((gap * gap).sum(1), 1e-12)
        pull = np.clip((-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None] * gap, -4, 4)
        i2 = np.repeat(i, negatives)
        j2 = rng.integers(0, n, len(i2))
        away = z[i2] - z[j2]
        e2 = (away * away).sum(1)
        push = np.clip((2 * b / ((0.001 + e2) * (1 + a * e2**b)))[:, None] * away, -4, 4) * (i2 != j2)[:, None]
        move = np.column_stack([np.bincount(np.concatenate([i, j, i2]), np.concatenate([pull[:, c], -pull[:, c], push[:, c]]), n) for c in (0, 1)])
        z = z + rate * np.clip(move, -4, 4)
    return z


def near_landmarks(df: DataFrame, key: str, vector: str, k: int, most: int = MOST, seed: int = 0) -> DataFrame:
    """(key, rank, neighbour, distance): the nearest landmarks of every row, by Euclidean distance."""
    at, y = landmarks(df, key, vector, most, seed)
    sent = df.sparkSession.sparkContext.broadcast((at, y))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, y = sent.value
        for f in frames:
            f = f[f["v"].map(len) == y.shape[1]]
            if len(f):
                places, d = nearest_of(f["key"].to_numpy(np.int64), np.vstack(f["v"].to_numpy()), at, y, k)
                rank = np.tile(np.arange(1, places.shape[1] + 1), len(f))
                made = pd.DataFrame({"key": np.repeat(f["key"].to_numpy(), places.shape[1]), "rank": rank, "neighbour": at[places.ravel()], "distance": d.ravel()})
                yield made[made["distance"].notna()]

    return usable(df, key, vector).mapInPandas(run, "key long, rank int, neighbour long, distance double").withColumnRenamed("key", key)


def layouts(df: DataFrame, key: str, vector: str, settings: list[tuple[int, float]], epochs: int = 200, most: int = MOST, seed: int = 42) -> DataFrame:
    """(key, n_neighbours, min_dist, x, y) of every row under each setting; the settings are fitted in tasks of their own."""
    spark = df.sparkSession
    at, y = landmarks(df, key, vector, most, seed)
    sent = spark.sparkContext.broadcast((at, y))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, y = sent.value
        for f in frames:
            for k, least in zip(f["k"], f["least"]):
                z = fitted(at, y, int(k), float(least), epochs, seed)
                yield pd.DataFrame({"n_neighbours": int(k), "min_dist": float(least), "neighbour": at, "x": z[:, 0], "y": z[:, 1]})

    jobs = spark.createDataFrame(settings, "k int, least double").repartition(len(settings), "k", "least")
    placed = jobs.mapInPandas(fit, "n_neighbours int, min_dist double, neighbour long, x double, y double")
    own = placed.withColumnRenamed("neighbour", key)
    # rows that are no landmarks: the mean place of their nearest landmarks, by membership
    near = near_landmarks(df, key, vector, max(k for k, _ in settings), most, seed).join(F.broadcast(spark.createDataFrame(pd.DataFrame({key: at}), f"{key} long")), key, "left_anti")
    near = near.withColumn("__least", F.min("distance").over(Window.partitionBy(key))).withColumn("__mean", F.avg("distance").over(Window.partitionBy(key)))
    pulled = near.join(F.broadcast(placed), "neighbour").where(F.col("rank") <= F.col("n_neighbours"))  # landmarks times settings
    weight = F.exp(-(F.col("distance") - F.col("__least")) / F.greatest(F.col("__mean") - F.col("__least"), F.lit(1e-12)))
    total = lambda c: (F.sum(weight * F.col(c)) / F.sum(weight)).alias(c)
    others = pulled.groupBy(key, "n_neighbours", "min_dist").agg(total("x"), total("y"))
    return own.select(*others.columns).unionByName(others)
