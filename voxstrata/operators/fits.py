"""Fits and densities by group from sums: polynomials of any degree, binned kernel densities, simulated residuals.

All groups (of one key column or more) are reduced to a few numbers (moments, or counts of bins) before anything is shuffled, so a group may be of any
size. Defined cases: rows whose values are null or not finite take no part; null groups are groups of their own; what a group is
too small or too flat for is null, as said below; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import meet


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


# ---------------------------------------------------------------- polynomials


def polynomials(df: DataFrame, within: list[str], x: str, y: str, degrees: list[int]) -> DataFrame:
    """A row for each group and degree: n, middle and spread of x, coefficients of z = (x - middle) / spread (constant first), those of
    x (highest first), and rmse.

    Two passes: means and spreads, then sums of powers of z and of their products with y, both centred, so that powers stay
    near 1; then one small system a group and degree. A group with no more distinct x than the degree, or without spread, has
    null coefficients there.
    """
    most = max(degrees)
    base = df.where(_finite(x) & _finite(y)).select(*within, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    facts = base.groupBy(*within).agg(F.count("*").alias("n"), F.avg("__x").alias("middle"), F.stddev_pop("__x").alias("spread"), F.avg("__y").alias("level"))
    z = meet(base, facts, within).withColumn("__z", F.coalesce(F.try_divide(F.col("__x") - F.col("middle"), F.col("spread")), F.lit(0.0))).withColumn("__y", F.col("__y") - F.col("level"))
    power = lambda k: F.pow("__z", F.lit(float(k)))
    sums = z.groupBy(*within).agg(F.array(*(F.avg(power(k)) for k in range(2 * most + 1))).alias("zz"), F.array(*(F.avg(power(k) * F.col("__y")) for k in range(most + 1))).alias("zy"), F.avg(F.col("__y") ** 2).alias("yy"))
    rows = meet(facts, sums, within).withColumn("degree", F.explode(F.array(*map(F.lit, sorted(set(degrees))))))

    @F.pandas_udf("struct<scaled:array<double>,coefficients:array<double>,rmse:double>")
    def solved(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            yield pd.DataFrame([_solve(*row) for row in zip(*frame)], columns=["scaled", "coefficients", "rmse"])

    out = rows.withColumn("__s", solved("degree", "zz", "zy", "yy", "middle", "spread", "level"))
    return out.select(*within, "degree", "n", "middle", "spread", "__s.*")


def _solve(degree: int, zz, zy, yy: float, middle: float, spread: float, level: float) -> tuple:
    k = degree + 1
    g = np.array([[zz[i + j] for j in range(k)] for i in range(k)])
    if not spread > 0 or np.linalg.cond(g) > 1e13:
        return None, None, None
    c = np.linalg.solve(g, np.asarray(zy[:k], float))
    rmse = math.sqrt(max(yy - float(c @ np.asarray(zy[:k], float)), 0.0))
    scaled = c.copy()
    scaled[0] += level
    raw = np.zeros(k)
    for i, v in enumerate(scaled):  # v * ((x - middle) / spread) ** i
        for j in range(i + 1):
            raw[j] += v * math.comb(i, j) * (-middle) ** (i - j) / spread**i
    return scaled.tolist(), raw[::-1].tolist(), rmse


# ---------------------------------------------------------------- densities


def density(df: DataFrame, within: list[str], value: str, points: int | None = None, finer: int = 8, reach: float = 8.0) -> DataFrame:
    """(within, point, at, p): a Gaussian kernel density at equally spaced points from the least to the largest value, with sum 1.

    The bandwidth is Silverman's, (3 n / 4) ** (-1 / 5) sample deviations; ``points`` are as many as values where no number is given.
    Values become weights of ``finer`` bins a point, each shared between the two bins about it in proportion to nearness; bins
    meet the points within ``reach`` bandwidths. Against direct sums that is wrong by at most (bin / bandwidth) ** 2 / 8 of the
    density's largest value. If all values are negative the points go up to minus the largest. A group of equal values has
    all its weight on its first point; one of a single value has no points.
    """
    base = df.where(_finite(value)).select(*within, F.col(value).cast("double").alias("__v"))
    facts = base.groupBy(*within).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"), F.stddev_samp("__v").alias("sd")).where("n > 1")
    facts = facts.withColumn("top", F.when(F.col("high") < 0, -F.col("high")).otherwise(F.col("high"))).withColumn("m", (F.col("n") if points is None else F.lit(points)).cast("int"))
    facts = facts.withColumn("bin", (F.col("top") - F.col("low")) / ((F.col("m") - 1) * finer)).withColumn("h", F.col("sd") * F.pow(F.col("n") * 0.75, F.lit(-0.2)))
    apart = facts.where("high > low AND bin > 0")
    place = (F.col("__v") - F.col("low")) / F.col("bin")
    two = F.array(F.struct(F.floor(place).alias("b"), (1 - (place - F.floor(place))).alias("w")), F.struct((F.floor(place) + 1).alias("b"), (place - F.floor(place)).alias("w")))
    weights = meet(base, apart, within).select(*within, F.inline(two)).where("w > 0").groupBy(*within, "b").agg(F.sum("w").alias("w"))
    met = meet(weights, apart, within)
    first = F.greatest(F.lit(0), F.ceil((F.col("b") - reach * F.col("h") / F.col("bin")) / finer)).cast("int")
    last = F.least(F.col("m") - 1, F.floor((F.col("b") + reach * F.col("h") / F.col("bin")) / finer)).cast("int")
    spread = met.where(last >= first).withColumn("point", F.explode(F.sequence(first, last)))
    off = (F.col("point") * finer - F.col("b")) * F.col("bin") / F.col("h")
    sums = spread.groupBy(*within, "point").agg(F.sum(F.col("w") * F.exp(-0.5 * off * off)).alias("f"))
    total = sums.groupBy(*within).agg(F.sum("f").alias("whole"))
    out = meet(meet(sums, total, within), apart, within).select(*within, "point", (F.col("low") + F.col("point") * finer * F.col("bin")).alias("at"), (F.col("f") / F.col("whole")).alias("p"))
    flat = facts.where("high = low").select(*within, F.lit(0).alias("point"), F.col("low").alias("at"), F.lit(1.0).alias("p"))
    return out.unionByName(flat)


def density_entropy(df: DataFrame, within: list[str], value: str, points: int | None = None, finer: int = 8) -> DataFrame:
    """(within, n, entropy): Shannon entropy of the kernel density, over that of equal shares."""
    p = density(df, within, value, points, finer).groupBy(*within).agg(F.sum(-F.col("p") * F.log2("p")).alias("s"))
    n = df.where(_finite(value)).groupBy(*within).agg(F.count("*").alias("n")).where("n > 1")
    return meet(n, p, within).select(*within, "n", (F.col("s") / F.log2(F.col("n") if points is None else F.lit(float(points)))).alias("entropy"))


def normal_entropy(df: DataFrame, within: list[str], value: str, points: int = 64) -> DataFrame:
    """(within, n, entropy): the same of a normal density with the group's mean and deviation at ``points`` points; 0 for equal values."""
    facts = df.where(_finite(value)).groupBy(*within).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))
    facts = facts.withColumn("top", F.when(F.col("high") < 0, -F.col("high")).otherwise(F.col("high")))
    z = lambda i: F.try_divide(F.col("low") + (F.col("top") - F.col("low")) * i / (points - 1) - F.col("mean"), F.col("sd"))  # noqa: E731  null without spread
    facts = facts.withColumn("f", F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.exp(-0.5 * z(i) * z(i))))
    facts = facts.withColumn("whole", F.aggregate("f", F.lit(0.0), lambda a, v: a + v))
    entropy = F.aggregate("f", F.lit(0.0), lambda a, v: a - F.when(v > 0, v / F.col("whole") * F.log2(v / F.col("whole"))).otherwise(0.0)) / math.log2(points)
    return facts.select(*within, "n", F.when(F.col("sd") > 0, entropy).otherwise(0.0).alias("entropy"))


# ---------------------------------------------------------------- simulated residuals

#: Fixed values of a public 32-bit mixing function, and odd multipliers that keep counters apart.
MIX, ROW, TURN = 0x45D9F3B, 2654435761, 0x9E3779B9
WORD = 1 << 32
#: Rows that are simulated at once.
ROWS = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit hashes of 32-bit numbers, both held in 64 bits."""
    for _ in range(2):
        x = ((x >> 16) ^ x) * MIX % WORD
    return (x >> 16) ^ x


def keys_of(numbers: np.ndarray) -> np.ndarray:
    """A 32-bit key from both halves of each number."""
    n = numbers.astype(np.int64) % (1 << 62)
    return mixed((mixed(n % WORD) + mixed(n // WORD + 1) * 3) % WORD)


def uniform(keys: np.ndarray, n: int, draw: int, seed: int) -> np.ndarray:
    """For each key n numbers between 0 and 1, which key, replicate, draw and seed determine, wherever they are computed."""
    turns = mixed((np.arange(n, dtype=np.int64) * 8 + draw) * TURN % WORD)
    return (mixed((keys[:, None] + turns + seed * ROW % WORD) % WORD) + 0.5) / WORD


def normal(keys: np.ndarray, n: int, draw: int, seed: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniform(keys, n, draw, seed))) * np.cos(2 * np.pi * uniform(keys, n, draw + 1, seed))


def simulated_residuals(df: DataFrame, row: str, observed: str, fitted: str, sd: Column, subject: str | None = None, subject_sd: Column | None = None, n: int = 500, seed: int = 1, to: str = "residual") -> DataFrame:
    """df with ``to``: the share of n values simulated at a row that are below the observed one; under a true model it is uniform.

    A simulated value is the fitted one plus normal noise of deviation ``sd``, plus, for models with a random intercept, noise of
    ``subject_sd`` that all rows of a subject share in a replicate. Random numbers are counted, not drawn: they follow from
    (row, replicate) and (subject, replicate). So nothing is stored, sent or shuffled, the result does not depend on
    partitions, and a replicate's intercepts agree wherever they are needed. row and subject are whole numbers. Where row,
    observed, fitted or a deviation is null there is no residual; a null subject has no intercept.
    """

    @F.pandas_udf("double")
    def shares(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for gap, rows, own, subjects, shared in parts:
            out = np.full(len(gap), np.nan)
            some = np.flatnonzero(gap.notna() & rows.notna() & own.notna())
            for at in range(0, len(some), ROWS):
                i = some[at : at + ROWS]
                noise = own.to_numpy(float)[i, None] * normal(keys_of(rows.iloc[i].to_numpy()), n, 0, seed)
                has = subjects.iloc[i].notna().to_numpy() & shared.iloc[i].notna().to_numpy()
                if has.any():
                    which, back = np.unique(subjects.iloc[i[has]].to_numpy(), return_inverse=True)
                    noise[has] += shared.to_numpy(float)[i[has], None] * normal(keys_of(which), n, 2, seed)[back]
                out[i] = (noise < gap.to_numpy(float)[i, None]).mean(1)
            yield pd.Series(out).where(np.isfinite(out), None)

    none = F.lit(None)
    gap = F.col(observed).cast("double") - F.col(fitted).cast("double")
    return df.withColumn(to, shares(gap, F.col(row).cast("long"), sd.cast("double"), (none if subject is None else F.col(subject)).cast("long"), (none if subject_sd is None else subject_sd).cast("double")))
