"""Centroid clustering in whole numbers, with Ptolemaic lower bounds from cached pivot distances.

Every vector is kept once with its exact squared distances to a few fixed pivots. For a pair of pivots p, q Ptolemy's
inequality gives d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q). In each round a vector's bounds to all centroids
come from its cached distances and the few distances between centroids and pivots; the centroid with the least bound is
measured first, which gives an upper bound, and only centroids whose lower bound does not exceed it are measured at all.
Bounds are rounded down by more than the errors of double precision, survivors are compared as exact integers, so the
result is that of all distances. Pivots are starting centroids, the first and then always the one farthest from those taken.

Vectors stay in their tasks: a round reads the kept table, broadcasts the k centroids and returns sums of at most k rows a
task, which Spark adds up; the driver gets k rows. A lost task is read again.

Defined cases: vectors that are null, have another width, or hold null or non-finite components take no part; components
beyond a long are those of the largest long; squared distances beyond a long are given as the largest long, and compared
exactly; a null vec_id takes part, and starts a centroid only after all others; equal hashes (repeated vec_ids) start in the
order of their components; fewer vectors than k are fewer centroids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

K, ROUNDS, WIDTH, SCALE, SALT = 40, 5, 64, 256, "2"
#: Pivots, all pairs of which give bounds; vectors looked at together.
PIVOTS, BLOCK = 6, 2048
#: What bounds are lowered by, relative to the numbers they come from: far beyond the rounding of double precision.
SLACK = 1e-9
MOST = (1 << 63) - 1


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as longs, or null where one is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(wide, lambda x: F.floor(x * scale)))


def _exact(reach: int, width: int) -> type:
    """The kind of number in which squared distances of components up to ``reach`` in size are exact."""
    return np.float64 if 4 * width * reach * reach < 1 << 53 else np.int64 if 4 * width * reach * reach < 1 << 63 else object


def _reach(*arrays: np.ndarray) -> int:
    return max((max(-int(a.min()), int(a.max())) for a in arrays if a.size), default=0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to one vector, or to rows alongside: whole numbers in float64, int64 or Python's."""
    kind = _exact(_reach(x, c), x.shape[1])
    gap = x.astype(kind) - c.astype(kind)
    return (gap * gap).sum(1)


def _roots(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


@dataclass
class Bounds:
    """Pivots, and the pairs of them that are apart."""

    pivots: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.pivots)
        apart = np.array([_roots(squared(self.pivots, p)) for p in self.pivots]).reshape(n, n)
        self.pairs = [(i, j, apart[i, j]) for i in range(n) for j in range(i) if apart[i, j] > 0]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.array([_roots(squared(x, p)) for p in self.pivots]).reshape(len(self.pivots), len(x)).T

    def lower(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Lower bounds of distances between rows whose distances to the pivots are near and far."""
        out = np.zeros((len(near), len(far)))
        for i, j, between in self.pairs:
            one, two = np.outer(near[:, i], far[:, j]), np.outer(near[:, j], far[:, i])
            np.maximum(out, (np.abs(one - two) - SLACK * (one + two)) / between, out=out)
        return out


def assign(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its exact squared distance, and how many distances were taken."""
    lower = bounds.lower(near, bounds.distances(centroids))
    at = lower.argmin(1)
    best = squared(x, centroids[at])
    upper = _roots(best) * (1 + SLACK)
    open_ = lower <= upper[:, None]
    open_[np.arange(len(x)), at] = False
    taken = len(x) + int(open_.sum())
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c])
        if len(rows):
            d = squared(x[rows], centroids[c])
            if d.dtype != best.dtype:
                d, best = d.astype(object), best.astype(object)
            better = (d < best[rows]) | ((d == best[rows]) & (c < at[rows]))
            at[rows[better]], best[rows[better]] = c, d[better]
    return at, best, taken


def _pack(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest whole numbers that hold it."""
    size = np.maximum(np.abs(x.max(1, initial=0).astype(np.float64)), np.abs(x.min(1, initial=0).astype(np.float64)))
    return [x[i].astype(np.int16 if s < 30000 else np.int32 if s < 2e9 else np.int64).tobytes() for i, s in enumerate(size)]


def _unpack(rows: pd.Series, width: int) -> np.ndarray:
    kinds = {2 * width: np.int16, 4 * width: np.int32, 8 * width: np.int64}
    return np.array([np.frombuffer(r, kinds[len(r)]) for r in rows], np.int64).reshape(len(rows), width)


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), BLOCK):
            yield frame.iloc[at : at + BLOCK]


def started(vectors: DataFrame, k: int, width: int, salt: str) -> np.ndarray:
    """The vectors that the centroids start as: k rows on the driver. vectors: (vec_id, v)."""
    h = F.sha2(F.concat(F.lit(salt + ":"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), width)


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of x: the first, then always the one farthest from those taken, as long as one is apart."""
    taken, least = [0], squared(x, x[0])
    while len(taken) < min(n, len(x)) and least.max() > 0:
        taken.append(int(least.argmax()))
        least = np.minimum(least, squared(x, x[taken[-1]]))
    return x[taken]


def _moved(kept: DataFrame, centroids: np.ndarray, bounds: Bounds) -> np.ndarray:
    """The centroids after one round."""
    width, sent = centroids.shape[1], kept.sparkSession.sparkContext.broadcast((centroids, bounds))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, limits = sent.value
        total, count = np.zeros(own.shape, object), np.zeros(len(own), np.int64)
        for frame in _blocks(frames):
            x = _unpack(frame["v"], width)
            at, _, _ = assign(x, np.vstack(frame["near"].map(np.frombuffer)), own, limits)
            part = np.zeros(own.shape, np.int64 if _reach(x) < 1 << 50 else object)
            np.add.at(part, at, x.astype(part.dtype))
            total, count = total + part, count + np.bincount(at, minlength=len(own))
        some = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": count[some], "sums": [[str(s) for s in total[c]] for c in some]})

    parts = kept.mapInPandas(sums, "cluster int, n long, sums array<string>")
    parts = parts.select("cluster", "n", F.transform("sums", lambda s: s.cast("decimal(38,0)")).alias("sums"))
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect()  # at most k rows
    out = centroids.copy()
    for r in added:
        out[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    return out


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, salt: str = SALT, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and n_measured of every vector of (vec_id, embedding) that takes part."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    base = vectors.where(F.size("embedding") == width).select(F.col("vec_id").cast("long"), whole(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    centroids = started(base, k, width, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_measured int")
    bounds = Bounds(spread(centroids, pivots))
    fixed = spark.sparkContext.broadcast(bounds)

    def cached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _blocks(frames):
            x = np.vstack(frame["v"])
            yield pd.DataFrame({"vec_id": frame["vec_id"], "v": _pack(x), "near": [r.tobytes() for r in fixed.value.distances(x)]})

    kept = scratch.write(base.mapInPandas(cached, "vec_id long, v binary, near binary"))
    for _ in range(rounds):
        centroids = _moved(kept, centroids, bounds)
    sent = spark.sparkContext.broadcast(centroids)

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _blocks(frames):
            at, d, taken = assign(_unpack(frame["v"], width), np.vstack(frame["near"].map(np.frombuffer)), sent.value, fixed.value)
            measured = np.full(len(frame), taken // len(frame), np.int32)
            measured[: taken % len(frame)] += 1
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": at.astype(np.int32), "exact": [str(int(s)) for s in d], "n_measured": measured})

    found = scratch.write(kept.mapInPandas(last, "vec_id long, cluster int, exact string, n_measured int").withColumn("exact", F.col("exact").cast("decimal(38,0)")))
    fits = lambda x: F.least(x, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum("exact").alias("s")).collect()}  # at most k rows
    rows = [(c, min(s, MOST), min(sum(sums.values()), MOST), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", fits(F.col("exact")).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256", "n_measured")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("n_measured")


def _sql(k: int = K, rounds: int = ROUNDS, width: int = WIDTH, salt: str = SALT) -> str:
    """The same by all distances, a round after the other."""
    at = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS j, v AS c FROM kept
  QUALIFY j < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, arg_min(j, d * {k} + j) AS j, min(d) AS d FROM (SELECT r, j, {at}::HUGEINT AS d FROM kept, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""s{i} AS MATERIALIZED (
  SELECT j, p, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT j, unnest(v) AS x, unnest(range({width})) AS p FROM kept JOIN a{i} USING (r)) GROUP BY j, p),
m{i} AS MATERIALIZED (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM s{i} GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (j))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, j::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda x: x::VARCHAR), ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} USING (j)"""


OP12_SQL = _sql()
