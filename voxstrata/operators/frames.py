"""Frame tables: a recording as rows (clip, frame, samples), and feature families as joins and aggregates on them.

A recording comes as blocks (clip, at, samples): ``at`` is the place of a block's first sample. ``frame_table`` cuts blocks
into the pieces that frames need and puts the pieces of a frame together, so that no task ever holds a recording, however
long. Windows are formulas, banks and transforms constant tables that spectra are joined to, deltas and statistics
aggregates; only the Fourier transform itself is numpy, a batch of frames at a time. Samples are shuffled once (not at all
where a clip is one block); after that only sums move, a number for each frame and band or coefficient.

Defined cases: blocks that are null or empty hold nothing; null samples make what is computed from them null; a frame over a
gap between blocks, or over blocks that overlap or repeat, doesn't exist; the tail that fills no frame is dropped, or, with
``pad="end"``, filled up with zeros as long as it holds samples that no frame before it does (a recording shorter than a
frame then has one frame); a null clip is a clip like others; clips without frames have no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

WINDOWS = {
    "hann": (0.5, -0.5, 0.0),
    "hamming": (0.54, -0.46, 0.0),
    "blackman": (0.42, -0.5, 0.08),
}
SPECTRUM = "re array<double>, im array<double>"
#: Frames that are transformed at once.
TOGETHER = 256


def window(samples: Column, size: Column, kind: str) -> Column:
    """Samples times a cosine window over ``size`` places."""
    a, b, c = WINDOWS[kind]
    turn = 2 * math.pi / F.greatest(size - 1, F.lit(1))
    return F.transform(samples, lambda v, i: v * (a + b * F.cos(turn * i) + c * F.cos(2 * turn * i)))


def frame_table(blocks: DataFrame, size: float, stride: float, rate: float | str = 1.0, unit: str = "samples", pad: str | None = None, wfunc: str | None = None, whole: bool = False, key: str = "clip") -> DataFrame:
    """(clip, frame, centre, rate, samples): overlapping frames of blocks (clip, at, samples). ``centre`` is in seconds.

    size and stride are in samples, or in seconds at ``rate`` (a number, or a column of blocks that is one for a clip), cut to
    whole samples. ``whole`` says that each clip is one block, which spares the shuffle.
    """
    if unit not in ("samples", "seconds") or pad not in (None, "end"):
        raise ValueError(f"unit {unit!r}, pad {pad!r}")
    per = F.col(rate) if isinstance(rate, str) else F.lit(float(rate))
    n, step = (F.lit(v).cast("long") if unit == "samples" else (F.lit(float(v)) * per).cast("long") for v in (size, stride))
    x = blocks.where(F.size("samples") > 0).select(F.col(key).alias("clip"), F.col("at").cast("long").alias("at"), F.col("samples").cast("array<double>").alias("samples"), per.alias("rate"), n.alias("n"), step.alias("step"))
    x = x.where("n > 0 AND step > 0").withColumn("end", F.col("at") + F.size("samples"))
    first, last = F.expr("CASE WHEN at < n THEN 0L ELSE (at - n + step) div step END"), F.expr("(end - 1) div step")
    parts = x.where(last >= first).withColumn("frame", F.explode(F.sequence(first, last)))
    parts = parts.withColumn("from", F.greatest("at", F.col("frame") * F.col("step"))).withColumn("to", F.least("end", F.col("frame") * F.col("step") + F.col("n"))).where("to > from")
    piece = F.struct("from", F.expr("slice(samples, int(from - at + 1), int(to - from))").alias("x"))
    if whole:
        made = parts.select("clip", "frame", "rate", "n", "step", F.array(piece).alias("p"))
    else:
        made = parts.select("clip", "frame", "rate", "n", "step", piece.alias("p")).groupBy("clip", "frame").agg(F.max("rate").alias("rate"), F.max("n").alias("n"), F.max("step").alias("step"), F.array_sort(F.collect_list("p")).alias("p"))
    made = made.withColumn("got", F.aggregate("p", F.lit(0), lambda a, p: a + F.size(p["x"])))
    start, stop = F.col("p")[0]["from"], F.element_at("p", -1)["from"] + F.size(F.element_at("p", -1)["x"])
    unbroken = (start == F.col("frame") * F.col("step")) & (stop - start == F.col("got")) & F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == 1) | (F.get("p", i - 1)["from"] == F.get("p", i - 2)["from"] + F.size(F.get("p", i - 2)["x"])))
    kept = F.col("got") == F.col("n") if pad is None else (F.col("got") > F.col("n") - F.col("step")) | (F.col("frame") == 0)
    samples = F.concat(F.flatten(F.transform("p", lambda p: p["x"])), F.array_repeat(F.lit(0.0), (F.col("n") - F.col("got")).cast("int")))
    samples = samples if wfunc is None else window(samples, F.col("n"), wfunc)
    return made.where(unbroken & kept).select("clip", "frame", ((F.col("n") / 2 + F.col("step") * F.col("frame")) / F.col("rate")).alias("centre"), "rate", samples.alias("samples"))


def spectra(frames: DataFrame, nfft: int | None = None) -> DataFrame:
    """frames with re and im in place of samples: the real Fourier transform, filled up with zeros or cut to ``nfft`` samples."""
    keep = [c for c in frames.columns if c != "samples"]

    @F.pandas_udf(f"struct<{SPECTRUM.replace(' array', ':array')}>")
    def transform(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list = [(None, None)] * len(part)
            lengths = part.map(lambda v: -1 if v is None else len(v)).to_numpy()
            for length in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == length)
                for i in range(0, len(at), TOGETHER):
                    some = at[i : i + TOGETHER]
                    x = np.fft.rfft(np.array([part.iloc[j] for j in some], float), nfft, axis=1)
                    for j, row in zip(some, x):
                        rows[j] = (row.real, row.imag)
            yield pd.DataFrame(rows, columns=["re", "im"])

    # not deterministic, as Spark sees it: else filters that the optimizer adds behind it would compute it again
    return frames.withColumn("s", transform.asNondeterministic()("samples")).select(*keep, "s.re", "s.im")


def magnitudes(spectrum: DataFrame, norm: bool = False, power: float = 1.0) -> DataFrame:
    """spectrum with ``magnitude`` in place of re and im; with ``norm`` a frame's sum is 1 (null for silence)."""
    m = F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b))
    out = spectrum.withColumn("magnitude", m).drop("re", "im")
    if norm:
        whole = F.array(S.total(F.col("magnitude")))  # summed once a frame, not once a bin
        out = out.withColumn("magnitude", F.transform(whole, lambda t: F.transform("magnitude", lambda v: F.try_divide(v, t)))[0])
    return out if power == 1.0 else out.withColumn("magnitude", F.transform("magnitude", lambda v: F.pow(v, F.lit(power))))


def _constant(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # a constant of the plan's parameters: bins times bands at most


def decibels(x: Column, least: float = 1e-12) -> Column:
    """Of an amplitude."""
    return 10 * F.log10(F.greatest(x * x, F.lit(least)))


def band_levels(spectrum: DataFrame, bank: list[tuple[int, int, float]]) -> DataFrame:
    """(clip, frame, band, value): weighted sums of a spectrum's bins (``magnitude``), by a join with the bank."""
    bins = spectrum.select("clip", "frame", F.posexplode("magnitude").alias("bin", "m"))
    return bins.join(_constant(bins, bank, "band int, bin int, w double"), "bin").groupBy("clip", "frame", "band").agg(F.sum(F.col("m") * F.col("w")).alias("value"))


def coefficients(levels: DataFrame, rows: list[tuple[int, int, float]]) -> DataFrame:
    """(clip, frame, k, value): a linear transform of each frame's levels (clip, frame, band, value), by a join with its rows."""
    return levels.join(_constant(levels, rows, "k int, band int, w double"), "band").groupBy("clip", "frame", "k").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def deltas(values: DataFrame, orders: list[int]) -> DataFrame:
    """(clip, frame, k, order, value): differences over successive frames, each order's in one aggregate for all.

    A value goes with its binomial weight to each frame whose difference it is part of; incomplete ones are dropped.
    """
    parts = F.array(*(F.struct(F.lit(n).alias("order"), F.lit(j).alias("j"), F.lit(float((-1) ** (n - j) * math.comb(n, j))).alias("w")) for n in orders for j in range(n + 1)))
    spread = values.select("clip", "frame", "k", "value", F.inline(parts))
    out = spread.groupBy("clip", (F.col("frame") - F.col("j")).alias("frame"), "k", "order").agg(F.sum(F.col("value") * F.col("w")).alias("value"), F.count("*").alias("n"))
    return out.where(F.col("n") == F.col("order") + 1).drop("n")


def moments(values: DataFrame, name: str) -> DataFrame:
    """(clip, feature, mean, sd, n): over frames, of (clip, frame, k, order, value); ``name_k`` with a ``d`` for each order."""
    feature = F.concat(F.repeat(F.lit("d"), F.col("order")), F.lit(name + "_"), F.col("k").cast("string"))
    return values.groupBy("clip", feature.alias("feature")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n"))


def wide(family: DataFrame, name: str, count: int, orders: list[int]) -> DataFrame:
    """A row a clip, in the family's order: all means and then all deviations of each order."""
    names = [["d" * n + f"{name}_{k}" for k in range(count)] for n in orders]
    out = family.groupBy("clip").pivot("feature", [x for group in names for x in group]).agg(F.first("mean").alias("mean"), F.first("sd").alias("std"))
    return out.select("clip", *(f"{x}_{s}" for group in names for s in ("mean", "std") for x in group))


def cepstral_family(frames: DataFrame, bank: list[tuple[int, int, float]], bands: int, first: int, last: int, nfft: int, name: str, lifter: float = 23, orders: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(clip, feature, mean, sd, n): cepstral coefficients first..last of bank levels in decibels, with differences."""
    from ..functions.banks import cosine_rows

    levels = band_levels(magnitudes(spectra(frames, nfft), norm=True), bank).withColumn("value", decibels(F.col("value")))
    return moments(deltas(coefficients(levels, cosine_rows(bands, first, last, lifter)), list(orders)), name)


def constant_q(spectrum: DataFrame, kernel: list[tuple]) -> DataFrame:
    """(clip, frame, pitch, frequency, re, im): the constant-Q transform, by a join of spectra with a sparse kernel of ``banks.constant_q``."""
    bins = spectrum.select("clip", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "v")).select("clip", "frame", "bin", "v.re", "v.im")
    met = bins.join(_constant(bins, kernel, "pitch int, frequency double, bin int, a double, b double, c double, d double"), "bin")
    total = lambda x, y: F.sum(F.col(x) * F.col("re") + F.col(y) * F.col("im"))
    return met.groupBy("clip", "frame", "pitch").agg(F.max("frequency").alias("frequency"), total("a", "b").alias("re"), total("c", "d").alias("im"))


def constant_q_family(frames: DataFrame, kernel: list[tuple], nfft: int, count: int = 12, lifter: float = 0, name: str = "cqcc", orders: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(clip, feature, mean, sd, n): cepstra of the constant-Q transform's amplitudes in decibels."""
    from ..functions.banks import cosine_rows

    pitches = max(row[0] for row in kernel) + 1
    levels = constant_q(spectra(frames, nfft), kernel).select("clip", "frame", F.col("pitch").alias("band"), decibels(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)).alias("value"))
    return moments(deltas(coefficients(levels, cosine_rows(pitches, 0, count - 1, lifter)), list(orders)), name)
