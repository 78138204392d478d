"""Perturbation measures of numbered cycles, without putting a recording's cycles in one task.

A cycle's value goes to the cycles whose centred sums or difference it is part of (five places either way), so that neighbours meet
in one aggregate by (keys, place); the measures are a second aggregate. Both are combined before they are shuffled, so a
recording may have any number of cycles.

Defined cases: rows whose value is null or not finite don't exist, and what needs them as a neighbour is left out; a place given
more than once counts with the mean of its values; measures that would divide by 0, or need more cycles than there are, are
null; null keys are keys of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of cycles that quotients are taken over.
QUOTIENTS = (3, 5, 11)


def measures(df: DataFrame, keys: list[str], place: str, x: str, quotients: tuple[int, ...] = QUOTIENTS) -> DataFrame:
    """A row for each keys: n, mean, sd, least, most; mean absolute step and that in percent and per mille of the mean size; the percentage for 1 / x;
    mean level step in dB; perturbation factor; quotients; relative average perturbation and its second version, scaled by
    n / (n - 2); variability index and its logarithm."""
    v = F.col(x).cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).groupBy(*keys, F.col(place).cast("long").alias("__p")).agg(F.avg(v).alias("__v"))
    reach = max(1, *(k // 2 for k in quotients))
    offsets = F.array(*(F.lit(o).cast("long") for o in range(-reach, reach + 1)))
    moved = base.select(*keys, "__v", F.col("__p"), F.explode(offsets).alias("__o")).withColumn("__p", F.col("__p") + F.col("__o"))
    near = lambda k: F.abs("__o") <= k // 2
    windows = [c for k in sorted({3, *quotients}) for c in (F.sum(F.when(near(k), F.col("__v"))).alias(f"__s{k}"), F.count_if(near(k)).alias(f"__n{k}"))]
    met = moved.groupBy(*keys, "__p").agg(F.max(F.when(F.col("__o") == 0, F.col("__v"))).alias("v"), F.max(F.when(F.col("__o") == 1, F.col("__v"))).alias("b"), *windows).where("v IS NOT NULL")
    v, before = F.col("v"), F.col("b")
    over = lambda k: F.when(F.col(f"__n{k}") == k, F.col(f"__s{k}") / k)
    size, step = F.avg(F.abs(v)), F.avg(F.abs(v - before))
    inverse = F.try_divide(F.lit(1.0), v)
    relative = F.try_divide(step, size)
    level = F.when(F.try_divide(before, v) > 0, F.log10(F.try_divide(before, v)))
    rap = F.try_divide(F.sum(F.abs(over(3) - v)), F.sum(v))
    index = 1000 * F.try_divide(F.var_pop(v), F.pow(F.avg(v), F.lit(2.0)))
    return met.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("sd"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
        step.alias("mean_step"),
        (100 * relative).alias("step_percent"),
        (1000 * relative).alias("step_ratio"),
        (100 * F.try_divide(F.avg(F.abs(inverse - F.try_divide(F.lit(1.0), before))), F.avg(F.abs(inverse)))).alias("inverse_percent"),
        (20 * F.avg(F.abs(level))).alias("level_step"),
        (100 * F.avg(F.abs(F.try_divide(v - before, v)))).alias("factor"),
        *((100 * F.avg(F.abs(1 - F.try_divide(v, over(k))))).alias(f"quotient_{k}") for k in quotients),
        rap.alias("rap"),
        (rap * F.try_divide(F.count("*").cast("double"), F.count("*") - 2)).alias("rap_scaled"),
        index.alias("variability"),
        F.when(index > 0, F.log10(index)).alias("variability_log"),
    )


# The columns of the cycle family that cycles' values give, by series and measure, in the family's order.
FAMILY = {
    "pitch": {"f0_mean": "mean", "f0_std": "sd", "f0_max": "most", "f0_min": "least"},
    "period": {"mean_jit": "mean_step", "jit_p": "step_percent", "jit_factor": "inverse_percent", "jit_ratio": "step_ratio", "ppf": "factor", "pvi": "variability", "ppq3": "quotient_3", "ppq5": "quotient_5", "ppq11": "quotient_11", "rap_v1": "rap", "rap_v2": "rap_scaled"},
    "amplitude": {"mean_shim": "level_step", "shim_p": "step_percent", "apf": "factor", "avi": "variability_log", "apq3": "quotient_3", "apq5": "quotient_5", "apq11": "quotient_11"},
    "energy": {"epf": "factor", "epq3": "quotient_3", "epq5": "quotient_5", "epq11": "quotient_11"},
}


def family(cycles: DataFrame, key: str = "clip", place: str = "cycle") -> DataFrame:
    """A row a recording with the family's columns, from cycles (key, place, period, amplitude, energy); pitch is 1 / period."""
    kinds = {"pitch": F.try_divide(F.lit(1.0), F.col("period")), "period": F.col("period"), "amplitude": F.col("amplitude"), "energy": F.col("energy")}
    long = cycles.select(key, place, F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("double").alias("x")) for k, c in kinds.items()))))
    found = measures(long, [key, "kind"], place, "x")
    cell = lambda kind, m: F.max(F.when(F.col("kind") == kind, F.col(m)))
    return found.groupBy(key).agg(*(cell(kind, m).alias(name) for kind, names in FAMILY.items() for name, m in names.items()))


def flatness_db(s: Column) -> Column:
    """Spectral flatness in dB of an array of magnitudes, its first bin left out: mean level less the level of the mean power."""
    power = F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda v: v * v)
    n = F.size(s) - 1
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    return F.try_divide(total(F.transform(power, lambda p: 10 * F.log10(F.nullif(p, F.lit(0.0))))), n) - 10 * F.log10(F.nullif(F.try_divide(total(power), n), F.lit(0.0)))
