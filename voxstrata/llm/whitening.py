"""Whitening of embeddings by incremental eigendecomposition.

Components become whole numbers; each distinct vector counts once. Every task keeps the number, mean and scatter of its rows
as a ``Spectrum``, brought up to date by centred rank-one updates that solve a secular equation with deflation (``secular``).
An update costs about a millisecond at 64 components, so a task's rows come in chunks: a chunk of more rows than components
goes in as its mean and the rows of its centred triangular factor, which have the same scatter. Spectra are combined in tasks,
``FAN`` at a time, by successive rank-one updates (the gap of the means, then each scaled eigenvector), until one is left.
A last pass over the distinct vectors refines it by Rayleigh and Ritz: tasks project their centred rows on the basis and
add up the small matrix of their products, whose eigenvectors turn the basis. What reaches the driver are a vector of sums
and matrices of width x width.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter ones count as filled up
with zeros; components beyond a long are those of the largest long; a null vec_id takes part, repeated rows are repeated in
the result but fitted once; directions without variance have no component (so equal vectors alone, or an empty table, give
no rows); a deviation beyond a long is null. Vectors may have up to ``WIDEST`` components: a task holds a few square matrices of
that width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import _pack, _reach, _unpack, whole
from .common import Scratch, table
from .secular import Spectrum

COMPONENTS, WIDEST = 4, 4096
#: Rows in a chunk, and spectra that a task combines.
CHUNK, FAN = 4096, 16
#: Variance, as a share of the largest, from which a direction is a component.
FLAT = 1e-12
_STATE = "n long, mean binary, q binary, d binary"


@dataclass
class Fit:
    """What rows are whitened by: number and sums (whole numbers) of the distinct vectors, eigenvectors (columns) and eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S over n, with as few roundings as may be."""
        kind = np.int64 if self.n * _reach(x) + max(map(abs, self.sums), default=0) < 1 << 53 else object
        return (self.n * x.astype(kind) - np.array(self.sums, kind)).astype(np.float64) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)**2; None beyond a long."""
        most = self.n * _reach(x) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * len(self.sums) < 1 << 63 else object
        gap = self.n * x.astype(kind) - np.array(self.sums, kind)
        return [int(v) if v < 1 << 63 else None for v in (gap * gap).sum(1)]


def _chunks(frames: Iterator[pd.DataFrame], width: int) -> Iterator[np.ndarray]:
    rows = max(64, CHUNK * 64 // max(width, 64))
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield _unpack(frame["v"].iloc[at : at + rows], width)


def _state(s: Spectrum) -> dict:
    return {"n": s.n, "mean": s.mean.tobytes(), "q": s.q.tobytes(), "d": s.d.tobytes()}


def _spectrum(row) -> Spectrum:
    d = np.frombuffer(row["d"])
    return Spectrum(int(row["n"]), np.frombuffer(row["mean"]), np.frombuffer(row["q"]).reshape(len(d), len(d)), d)


def spectrum(fit: DataFrame, width: int, fan: int = FAN) -> Spectrum:
    """Of the rows of fit (v): one for each task, combined in tasks of at most ``fan`` until one is left."""
    scratch = Scratch(fit.sparkSession, "spectra")

    def of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Spectrum.empty(width)
        for x in _chunks(frames, width):
            own.add(x.astype(np.float64))
        if own.n:
            yield pd.DataFrame([_state(own)])

    def combined(frame: pd.DataFrame) -> pd.DataFrame:
        first, *others = [_spectrum(r) for _, r in frame.sort_values("place").iterrows()]
        for s in others:
            first.combine(s)
        return pd.DataFrame([_state(first)])

    states = scratch.write(fit.mapInPandas(of_task, _STATE))
    while (left := states.count()) > 1:
        # places in the order of the means' bytes, so that groups are full: one row a task of the level before
        placed = states.withColumn("place", F.monotonically_increasing_id())
        groups = placed.withColumn("g", F.pmod(F.xxhash64("place"), F.lit(-(-left // fan)))) if left > fan else placed.withColumn("g", F.lit(0))
        states = scratch.write(groups.groupBy("g").applyInPandas(lambda f: combined(f), _STATE))
    return _spectrum(states.first())


def _added(fit: DataFrame, work, size: int) -> np.ndarray:
    """Sums over all rows of a square matrix of that size that ``work`` makes of each chunk: a row of it at a time."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum(work(frames), np.zeros((size, size)))
        yield pd.DataFrame({"i": np.arange(size, dtype=np.int32), "row": list(total)})

    rows = fit.mapInPandas(parts, "i int, row array<double>").groupBy("i").agg(F.array(*(F.sum(F.col("row")[j]) for j in range(size))).alias("row")) if size <= 128 else None
    if rows is None:  # wide matrices as places and values
        rows = fit.mapInPandas(parts, "i int, row array<double>").select("i", F.posexplode("row")).groupBy("i", "pos").agg(F.sum("col").alias("col")).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "col"))), lambda x: x["col"]).alias("row"))
    out = np.zeros((size, size))
    for r in rows.collect():  # size rows
        out[r["i"]] = r["row"]
    return out


def fitted(fit: DataFrame, width: int, components: int = COMPONENTS) -> Fit | None:
    """The fit over the rows of fit (v), each of which counts once."""
    spark = fit.sparkSession

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(width, object)
        for x in _chunks(frames, width):
            n, total = n + len(x), total + (x.sum(0) if _reach(x) < 1 << 45 else x.astype(object).sum(0))
        yield pd.DataFrame({"i": np.arange(width, dtype=np.int32), "n": n, "s": [str(int(v)) for v in total]})

    added = fit.mapInPandas(sums, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # a row a component
    if not added or not added[0]["n"]:
        return None
    whole_sums = [int(r["s"]) for r in added]
    first = spectrum(fit, width)
    basis, _ = np.linalg.qr(first.q)
    sent = spark.sparkContext.broadcast(Fit(added[0]["n"], whole_sums, basis, np.ones(width), 1.0))

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for x in _chunks(frames, width):
            y = sent.value.project(x)
            yield y.T @ y

    ritz = _added(fit, products, width) / added[0]["n"]
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    some = [i for i in range(width - 1, max(width - 1 - components, -1), -1) if values[i] > FLAT * values[-1] and values[i] > 0]
    axes = basis @ turn[:, some]
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(len(some))] < 0, -1.0, 1.0)
    return Fit(added[0]["n"], whole_sums, axes, values[some], float(values.sum()))


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whitened(vectors: DataFrame, components: int = COMPONENTS, fan: int = FAN) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector of (vec_id, embedding) and component."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    base = vectors.select(F.col("vec_id").cast("long"), whole(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    width = base.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    if width > WIDEST:
        raise ValueError(f"vectors of {width} components: at most {WIDEST}")
    empty = spark.createDataFrame([], _RESULT + ", identity_error double")
    if not width:
        return empty

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.zeros((len(frame), width), np.int64)
            for i, v in enumerate(frame["v"]):
                x[i, : len(v)] = v
            yield pd.DataFrame({"vec_id": frame["vec_id"], "v": _pack(x)})

    kept = scratch.write(base.mapInPandas(packed, "vec_id long, v binary"))
    fit = scratch.write(kept.select("v").distinct())  # equal vectors have equal bytes
    found = fitted(fit, width, components)
    if found is None or not len(found.values):
        return empty
    sent, k = spark.sparkContext.broadcast(found), len(found.values)

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for x in _chunks(frames, width):
            y = np.hstack([sent.value.project(x), np.ones((len(x), 1))])
            yield y.T @ y

    m = _added(fit, moments, k + 1) / found.n
    error = float(np.abs(m[:k, :k] - np.outer(m[k, :k], m[k, :k]) - np.eye(k)).max())

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = sent.value
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK]
                x = _unpack(part["v"], width)
                each = lambda v: np.repeat(np.asarray(v, object), k)
                yield pd.DataFrame({
                    "vec_id": each(part["vec_id"].astype("Int64")), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": f.n,
                    "deviation": pd.array(each(f.deviation(x)), "Int64"), "whitened": f.project(x).ravel(), "explained": np.tile(f.values / f.trace, len(x)),
                })

    return kept.mapInPandas(rows, _RESULT).withColumn("identity_error", F.lit(error))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector that takes part."""
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
