"""Approximate nearest-neighbour graphs by descent, and layouts over such a graph, as joins and aggregates over all rows.

A neighbour of a neighbour is likely a neighbour. Lists begin with exact neighbours inside small cells: one dealing by a hash,
the others by random hyperplanes. In each round every row meets the vectors of its neighbours and of the rows it is a neighbour of (a sample of them,
bounded, the new ones first), and tells each of these which of the others come closer than its list's last. That takes a few
shuffles of a bounded number of vectors a row and round, so work grows with rows times rounds; rounds end when few lists change.
Cells that hold more rows than they should (copies, say) are split by a hash. ``layout.neighbours`` is the exact search.

``graph_layout`` places rows in the plane by that graph: edges meet the positions of their ends, attraction is summed by row,
and each row is pushed away from a few others that counters choose. An epoch is written once; how many there are is given.

Defined cases: as in ``layout``: rows of unusable vectors or null keys take no part; equal vectors are neighbours at distance 0;
rows of one key are never each other's neighbours; fewer rows than asked for give shorter lists; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .layout import nearest_of, numbered

#: Rows of a cell, dealings into cells at first, neighbours and reverse neighbours that meet, rounds at most.
CELL, STARTS, MEET, ROUNDS = 256, 3, 2, 12
#: Entries that lists are longer by than is asked for.
MORE = 10
#: Rounds end when no more than this share of all list entries is new.
SETTLED = 0.002
EDGE = "row long, other long, d double"


def _packed(rows: DataFrame) -> DataFrame:
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"row": f["row"], "key": f["key"], "v": [np.asarray(v, float).tobytes() for v in f["v"]]})

    return written(rows.select("row", "key", "v").mapInPandas(pack, "row long, key long, v binary"))


def _matrix(vs) -> np.ndarray:
    return np.frombuffer(b"".join(vs)).reshape(len(vs), -1)


def _moments(points: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance: sums by task, added by Spark, a row for each component on the driver."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 1))
        for f in frames:
            x = np.hstack([np.ones((len(f), 1)), _matrix(f["v"].tolist())])
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(width + 1), "s": list(total)})

    rows = points.mapInPandas(sums, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    m = np.zeros((width + 1, width + 1))
    for r in rows.collect():
        m[r["i"], r["j"]] = r["s"]
    n = m[0, 0]
    mean = m[0, 1:] / n
    return int(n), mean, m[1:, 1:] / n - np.outer(mean, mean)


def _kept(edges: DataFrame, k: int) -> DataFrame:
    """(row, others, ds, fresh, r): the k nearest of each row's edges (row, other, d, fresh), ties to the smaller number."""
    one = edges.groupBy("row", "other").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))  # known ones are not fresh
    best = one.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy("d", "other"))).where(F.col("k") <= k)
    lists = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("d", "other", "fresh"))).alias("l"))  # k entries at most
    full = F.when(F.size("l") == k, F.element_at("l", -1)["d"]).otherwise(F.lit(float("inf")))
    return lists.select("row", F.transform("l", lambda x: x["other"]).alias("others"), F.transform("l", lambda x: x["d"]).alias("ds"), F.transform("l", lambda x: x["fresh"]).alias("fresh"), full.alias("r"))


def _started(points: DataFrame, n: int, mean: np.ndarray, k: int, cell: int, start: int) -> DataFrame:
    """Edges between rows of one cell of random hyperplanes through the mean; at start 0 between rows that a hash throws together, which ties the cells to each other."""
    bits = max(0, int(np.ceil(np.log2(max(n / cell, 1))))) if start else 0
    planes = np.random.default_rng(start).standard_normal((len(mean), bits))

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for f in frames:
            yield f.assign(cell=((_matrix(f["v"].tolist()) - mean) @ planes > 0) @ weights if bits else np.zeros(len(f), np.int64))

    coded = points.mapInPandas(code, "row long, key long, v binary, cell long")
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(2.0 * cell)).cast("long").alias("parts"))
    dealt = coded.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(start), "row"), F.col("parts")))

    def search(f: pd.DataFrame) -> pd.DataFrame:
        x, keys, rows = _matrix(f["v"].tolist()), f["key"].to_numpy(np.int64), f["row"].to_numpy(np.int64)
        places, d = nearest_of(keys, x, keys, x, k)
        out = pd.DataFrame({"row": np.repeat(rows, places.shape[1]), "other": rows[places.ravel()], "d": d.ravel()})
        return out[out["d"].notna()]

    return dealt.groupBy("cell", "part").applyInPandas(search, EDGE)


def _told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which of the rows that meet come closer to each other than their lists' last."""
    for f in frames:
        out = []
        for others, keys, fresh, r, vs in zip(f["others"], f["keys"], f["fresh"], f["rs"], f["vs"]):
            others, first = np.unique(np.asarray(others, np.int64), return_index=True)
            x, new, reach, key = _matrix([vs[i] for i in first]), np.asarray(fresh, bool)[first], np.asarray(r, float)[first], np.asarray(keys, np.int64)[first]
            d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
            i, j = np.nonzero((new[:, None] | new) & (key[:, None] != key) & (d < reach[:, None]))
            out.append(np.column_stack([others[i], others[j]]).astype(np.int64))
            out.append(d[i, j])
        pairs = np.vstack([*out[::2], np.empty((0, 2), np.int64)])
        yield pd.DataFrame({"row": pairs[:, 0], "other": pairs[:, 1], "d": np.concatenate([*out[1::2], np.empty(0)])})


def _meeting(state: DataFrame, turn: int, most: int) -> DataFrame:
    """(row, w, fresh): which neighbours and reverse neighbours meet at a row, the new ones first; none where none is new.

    Pairs of known ones have met before, so where nothing is new nothing would be told, and no vectors are sent.
    """
    flat = state.select("row", F.inline(F.arrays_zip("others", "fresh")))
    both = flat.select("row", F.col("others").alias("w"), "fresh").unionByName(flat.select(F.col("others").alias("row"), F.col("row").alias("w"), "fresh"))
    order = Window.partitionBy("row").orderBy(F.col("fresh").desc(), F.xxhash64(F.lit(turn), "row", "w"), "w")
    ranked = both.withColumns({"k": F.row_number().over(order), "live": F.first("fresh").over(order)})
    return ranked.where((F.col("k") <= most) & F.col("live")).select("row", "w", "fresh")


def lists(rows: DataFrame, k: int, cell: int = CELL, starts: int = STARTS, rounds: int = ROUNDS, meet: int = MEET) -> DataFrame:
    """(row, others, ds, fresh, r) for rows as ``layout.numbered`` makes them: others and distances, nearest first."""
    points = _packed(rows)
    first = points.first()
    if first is None:
        return rows.select("row", F.array().cast("array<long>").alias("others"), F.array().cast("array<double>").alias("ds"), F.array().cast("array<boolean>").alias("fresh"), F.lit(0.0).alias("r"))
    n, mean, _ = _moments(points, len(first["v"]) // 8)
    edges = None
    for s in range(starts if n > cell else 1):
        e = _started(points, n, mean, k, cell, s)
        edges = e if edges is None else edges.unionByName(e)
    state = written(_kept(edges.withColumn("fresh", F.lit(True)), k))
    for turn in range(rounds):
        if state.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] <= (SETTLED * n * k if turn else 0) or n <= cell:
            break
        sampled = _meeting(state, turn, meet * k)
        known = points.join(state.select("row", "r"), "row", "left").select(F.col("row").alias("w"), "key", "v", F.coalesce("r", F.lit(float("inf"))).alias("r"))
        met = sampled.join(known, "w").groupBy("row").agg(F.collect_list(F.struct("w", "key", "fresh", "r", "v")).alias("l"))  # meet * k entries at most
        part = lambda c: F.transform("l", lambda x: x[c])
        told = met.select(part("w").alias("others"), part("key").alias("keys"), part("fresh").alias("fresh"), part("r").alias("rs"), part("v").alias("vs")).mapInPandas(_told, EDGE)
        old = state.select("row", F.inline(F.arrays_zip("others", "ds"))).select("row", F.col("others").alias("other"), F.col("ds").alias("d"), F.lit(False).alias("fresh"))
        state = written(_kept(old.unionByName(told.withColumn("fresh", F.lit(True))), k))
    return state


def graph(df: DataFrame, key: str, vector: str, k: int = 15, more: int = MORE, **options) -> DataFrame:
    """(key, rank, neighbour, distance): about the k nearest of all rows to every row. Lists are longer by ``more`` on the way, which finds more."""
    rows = numbered(df, key, vector)
    found = lists(rows, k + more, **options).select("row", F.posexplode(F.arrays_zip("others", "ds")).alias("rank", "x")).select("row", (F.col("rank") + 1).alias("rank"), "x.others", "x.ds").where(F.col("rank") <= k)
    names = rows.select("row", F.col("key").alias("k"))
    out = found.join(names, "row").withColumnRenamed("k", key).drop("row").join(names.withColumnsRenamed({"row": "others", "k": "neighbour"}), "others")
    return out.select(key, "rank", "neighbour", F.col("ds").alias("distance"))


# ---------------------------------------------------------------- layouts

#: Others that push a row away in an epoch, how much they count, and what positions move by at most.
PUSHES, PUSH, STEP = 6, 1.0, 4.0


def curve(near: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a * d ** (2 * b)), fitted to exp(-(d - near) / spread) beyond ``near`` and 1 before it."""
    d = np.linspace(1e-3, 3 * spread, 300)
    want = np.where(d < near, 1.0, np.exp(-(d - near) / spread))
    best = (np.inf, 1.0, 1.0)
    centre, width = np.array([0.0, 0.0]), 3.0  # logarithms of a and b, by grids that close in
    for _ in range(12):
        for u in np.linspace(-width, width, 9) + centre[0]:
            for v in np.linspace(-width / 2, width / 2, 9) + centre[1]:
                error = ((1 / (1 + np.exp(u) * d ** (2 * np.exp(v))) - want) ** 2).sum()
                best = min(best, (float(error), float(u), float(v)))
        centre, width = np.array(best[1:]), width / 2
    return float(np.exp(centre[0])), float(np.exp(centre[1]))


def weights(state: DataFrame) -> DataFrame:
    """(row, other, w), both ways: how surely two rows are connected, by distances beyond the nearest in units of the row's own scale."""

    def scaled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, others, ws = [], [], []
            for row, o, d in zip(f["row"], f["others"], f["ds"]):
                d = np.asarray(d, float)
                far = np.maximum(d - (d[d > 0].min() if (d > 0).any() else 0.0), 0)
                low, high, target = 0.0, np.inf, np.log2(max(len(d), 2))
                scale = 1.0
                for _ in range(64):
                    if np.exp(-far / scale).sum() > target:
                        high = scale
                        scale = (low + high) / 2
                    else:
                        low = scale
                        scale = scale * 2 if high == np.inf else (low + high) / 2
                scale = max(scale, 1e-3 * d.mean(), 1e-12)
                rows.append(np.full(len(d), row)), others.append(np.asarray(o, np.int64)), ws.append(np.exp(-far / scale))
            yield pd.DataFrame({"row": np.concatenate([*rows, np.empty(0, np.int64)]), "other": np.concatenate([*others, np.empty(0, np.int64)]), "w": np.concatenate([*ws, np.empty(0)])})

    one = state.select("row", "others", "ds").mapInPandas(scaled, "row long, other long, w double")
    both = one.groupBy(F.least("row", "other").alias("row"), F.greatest("row", "other").alias("other")).agg(F.sum("w").alias("s"), F.max("w").alias("a"), F.count("*").alias("n"))
    w = both.select("row", "other", F.when(F.col("n") > 1, F.col("s") - F.col("a") * (F.col("s") - F.col("a"))).otherwise(F.col("s")).alias("w"))
    return w.unionByName(w.select(F.col("other").alias("row"), F.col("row").alias("other"), "w"))


def graph_layout(df: DataFrame, key: str, vector: str, k: int = 15, near: float = 0.1, epochs: int = 20, seed: int = 1, **options) -> DataFrame:
    """(key, x, y) of every row: a layout in the plane over the graph of all rows.

    Rows start on their two leading principal axes. An epoch moves each row by the mean of its edges' attraction, by weight, and of
    the push of ``PUSHES`` rows that a hash of row, epoch and seed chooses; steps shrink to 0 over the epochs.
    """
    rows = numbered(df, key, vector)
    points = _packed(rows)
    first = points.first()
    if first is None:
        return rows.select(F.col("key").alias(key), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    n, mean, spread = _moments(points, len(first["v"]) // 8)
    axes = np.linalg.eigh(spread)[1][:, ::-1][:, :2]
    scale = 10 / max(3 * np.sqrt(max(float(np.linalg.eigvalsh(spread)[-1]), 0.0)), 1e-12)

    # numbers from 0 on without gaps, so that counters can choose among them: the sizes of partitions, one row each, shift them
    sizes = sorted((r["p"], r["n"]) for r in points.groupBy(F.shiftright("row", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    before = dict(zip((p for p, _ in sizes), np.cumsum([0, *(s for _, s in sizes)]).tolist()))
    shift = df.sparkSession.createDataFrame(list(before.items()), "p long, before long")

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = (_matrix(f["v"].tolist()) - mean) @ axes * scale
            x = x if x.shape[1] == 2 else np.hstack([x, np.zeros((len(x), 2 - x.shape[1]))])
            jitter = np.array([np.random.default_rng([seed, int(r)]).standard_normal(2) for r in f["row"]]).reshape(-1, 2)  # equal rows start apart
            yield pd.DataFrame({"row": f["row"], "x": x[:, 0] + 1e-3 * jitter[:, 0], "y": x[:, 1] + 1e-3 * jitter[:, 1]})

    dense = points.select("row", F.shiftright("row", 33).alias("p")).join(F.broadcast(shift), "p").select("row", (F.col("row") - F.shiftleft("p", 33) + F.col("before")).alias("i"))
    dense = written(dense)
    start = points.mapInPandas(begin, "row long, x double, y double")
    spots = written(start.join(dense, "row").select("i", "x", "y"))
    edges = weights(lists(rows, k, **options))
    number = lambda c: dense.withColumnsRenamed({"row": c, "i": f"{c}_i"})
    edges = written(edges.join(number("row"), "row").join(number("other"), "other").select(F.col("row_i").alias("i"), F.col("other_i").alias("j"), "w"))
    a, b = curve(near)
    clip = lambda g: F.greatest(F.lit(-STEP), F.least(F.lit(STEP), g))
    dx, dy = F.col("x") - F.col("xj"), F.col("y") - F.col("yj")
    d2 = F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    pull = -2 * a * b * F.pow(d2, F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b)))
    push = 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, F.lit(b))))
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        others = F.transform(F.sequence(F.lit(0), F.lit(PUSHES - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "i", t), F.lit(n)))
        pushed = dense.select("i", F.explode(others).alias("j"), F.lit(0.0).alias("w"))  # edges have a weight, pushes none
        met = edges.unionByName(pushed).join(spots, "i").join(spots.withColumnsRenamed({"i": "j", "x": "xj", "y": "yj"}), "j")
        force = lambda d: F.when(F.col("w") > 0, clip(pull * d) * F.col("w")).otherwise(0.0)
        away = lambda d: F.when(F.col("w") > 0, 0.0).otherwise(clip(push * d))
        sums = met.select("i", "x", "y", "w", force(dx).alias("ax"), force(dy).alias("ay"), away(dx).alias("rx"), away(dy).alias("ry")).groupBy("i").agg(*(F.max(c).alias(c) for c in "xy"), *(F.sum(c).alias(c) for c in ("w", "ax", "ay", "rx", "ry")))
        step = lambda c: rate * clip(F.coalesce(F.try_divide(F.col("a" + c), F.col("w")), F.lit(0.0)) + F.col("r" + c) * (PUSH / PUSHES))
        spots = written(sums.select("i", (F.col("x") + step("x")).alias("x"), (F.col("y") + step("y")).alias("y")))
    return spots.join(dense, "i").join(rows.select("row", F.col("key").alias(key)), "row").select(key, "x", "y")
