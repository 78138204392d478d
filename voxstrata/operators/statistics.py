"""Window statistics: multiple testing, ranks, rank tests, order-dependent measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import applied, chi_upper, rank_sum_normal, rank_sum_two_sided
from ..sources.shared import checkpointed


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: added up to 64 terms, beyond that by its expansion, whose error is below 1e-13."""
    few = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(64)).cast("int")), F.lit(0.0), lambda a, k: a + 1 / k)
    x = m.cast("double")
    many = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(m <= 64, few).otherwise(many)


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on keys of which any may be null: null meets null."""
    there = right.select(*(F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in right.columns))
    on = reduce(Column.__and__, [left[k].eqNullSafe(there[f"__k_{k}"]) for k in keys])
    return left.join(there, on, how).drop(*(f"__k_{k}" for k in keys))


def adjusted(df: DataFrame, p: str, family: list[str], method: str = "bh") -> DataFrame:
    """Adds ``adjusted``: Benjamini-Hochberg or -Yekutieli values within each family; null p take no part.

    A family is cut into spans of its p values: the least raw value from a span's end on comes from the later spans'
    least values, so that no task sorts a whole family.
    """
    x = cumulated(df, family, p, spans=True)
    raw = F.col(p) * F.col("whole") / (F.col("below") + F.col("t"))
    x = x.select(*family, p, "__span", (raw * harmonic(F.col("whole")) if method == "by" else raw).alias("__raw"))
    later = Window.partitionBy(*family).orderBy(F.col("__span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy(*family, "__span").agg(F.min("__raw").alias("__least")).select(*family, "__span", F.min("__least").over(later).alias("__later"))
    inside = Window.partitionBy(*family, "__span").orderBy(F.col(p).desc())
    least = F.least(F.min("__raw").over(inside), F.col("__later"), F.lit(1.0))
    values = meet(x, ends, [*family, "__span"]).select(*family, p, least.alias("adjusted"))
    return meet(df, values, [*family, p], "left")


def cumulated(df: DataFrame, within: list[str], value: str, weight: Column | None = None, root: int = 16, spans: bool = False) -> DataFrame:
    """Each distinct value with its count ``t``, the count ``below`` it and that of its whole group.

    Prefix sums in two levels, cut at root * root approximate quantiles of the distinct values: a task holds one span of
    one group. Null values take no part; null keys are keys of their own. With ``spans``, the span of each value too.
    The counts are written once: cuts and places are two passes over them.
    """
    counts = checkpointed(df.where(F.col(value).isNotNull()).groupBy(*within, value).agg(F.sum(F.lit(1) if weight is None else weight).alias("t")))
    splits = counts.groupBy(*within).agg(F.percentile_approx(value, [k / root**2 for k in range(1, root**2)], 10_000).alias("__fine"))
    splits = splits.withColumn("__coarse", F.filter("__fine", lambda _, i: i % root == root - 1))
    under = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(value)))
    placed = meet(counts, splits, within).withColumn("__c", root * under("__coarse"))
    placed = placed.withColumn("__span", F.col("__c") + under(F.slice("__fine", F.col("__c") + 1, F.lit(root - 1)))).drop("__c", "__fine", "__coarse")
    totals = placed.groupBy(*within, "__span").agg(F.sum("t").alias("__t"))
    group = Window.partitionBy(*within)
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(*within, "__span", before(group.orderBy("__span"), "__t").alias("__start"), F.sum("__t").over(group).alias("whole"))
    inside = Window.partitionBy(*within, "__span").orderBy(value)
    out = meet(placed, starts, [*within, "__span"])
    return out.select(*within, value, "t", (F.col("__start") + before(inside, "t")).alias("below"), "whole", *(["__span"] if spans else []))


def previous(df: DataFrame, within: list[str], order: str) -> DataFrame:
    """Each row joined to the one before it in its group, whose columns end in ``_before``; ``order`` has no repeats.

    Rows are numbered by their keys alone, so that only neighbours carry their other columns to each other.
    """
    at = cumulated(df.select(*within, order), within, order).select(*within, order, F.col("below").alias("__at"))
    x = meet(df, at, [*within, order])
    one = x.select(*within, (F.col("__at") + 1).alias("__at"), *(F.col(c).alias(f"{c}_before") for c in df.columns if c not in within))
    return meet(x, one, [*within, "__at"]).drop("__at")


def value_ranks(df: DataFrame, within: list[str], value: str, group: str, weight: Column | None = None) -> DataFrame:
    """Mid-ranks from counts: one row for each distinct value and group, so that ties cost nothing."""
    counts = df.groupBy(*within, value, group).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    ranks = cumulated(counts, within, value, F.col("n")).withColumn("mid", F.col("below") + (F.col("t") + 1) / 2).drop("below", "whole")
    return counts.join(ranks, [*within, value])


def cubes(ranks: DataFrame, within: list[str], value: str) -> DataFrame:
    """The sum of t^3 - t over tied values."""
    return ranks.dropDuplicates([*within, value]).groupBy(*within).agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("ties"))


def kruskal(df: DataFrame, within: list[str], value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H with the tie correction, its degrees of freedom and p; null H where all values are equal."""
    ranks = value_ranks(df, within, value, group)
    by_group = ranks.groupBy(*within, group).agg(F.sum(F.col("n") * F.col("mid")).alias("__r"), F.sum("n").alias("__g"))
    total = by_group.groupBy(*within).agg(F.sum(F.col("__r") * F.col("__r") / F.col("__g")).alias("s"), F.sum("__g").cast("double").alias("n"), F.count("*").alias("k"))
    n = F.col("n")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.try_divide(F.col("ties"), n * n * n - n))
    out = total.join(cubes(ranks, within, value), within).select(*within, h.alias("h"), (F.col("k") - 1).alias("df"), n.cast("long").alias("n"))
    return out.withColumn("p", applied(chi_upper, F.col("h"), F.col("df").cast("double")))


def rank_sums(df: DataFrame, value: str, group: str, within: list[str] | None = None, least: int = 1, exact: bool = False) -> DataFrame:
    """U of the first group and its two-sided p for all pairs of groups a < b of at least ``least`` values.

    Values are counted before the pairs are formed. With ``exact``, small groups without ties get their exact tail.
    """
    within = within or []
    x = df.where(F.col(value).isNotNull())
    counts = x.groupBy(*within, group, value).agg(F.count("*").alias("__n"))
    sizes = counts.groupBy(*within, group).agg(F.sum("__n").alias("n")).where(F.col("n") >= least)
    a, b = sizes.select(*within, F.col(group).alias("a"), F.col("n").alias("n_a")), sizes.select(*within, F.col(group).alias("b"), F.col("n").alias("n_b"))
    pairs = (a.join(b, within) if within else a.crossJoin(b)).where("a < b")  # names of groups
    sides = pairs.select(*within, "a", "b", F.explode(F.array("a", "b")).alias(group))
    keys = [*within, "a", "b"]
    ranks = value_ranks(counts.join(sides, [*within, group]), keys, value, group, F.col("__n"))
    r = ranks.where(F.col(group) == F.col("a")).groupBy(*keys).agg(F.sum(F.col("n") * F.col("mid")).alias("r"))
    out = pairs.join(r, keys).join(cubes(ranks, keys, value), keys)
    out = out.select(*keys, (F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2).alias("u"), "n_a", "n_b", "ties")
    return out.withColumn("p", applied(rank_sum_two_sided if exact else rank_sum_normal, "u", "n_a", "n_b", "ties")).drop("ties")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, from cumulated counts: no group is gathered."""
    x = cumulated(df, keys, value)
    holds = lambda at: F.max(F.when((F.col("below") <= at) & (at < F.col("below") + F.col("t")), F.col(value)))
    made = []
    for name, q in shares.items():
        h = (F.col("whole") - 1) * q
        made += [holds(F.floor(h)).alias(f"__{name}_low"), holds(F.ceil(h)).alias(f"__{name}_high"), F.max(h - F.floor(h)).alias(f"__{name}_part")]
    out = x.groupBy(*keys).agg(F.sum("t").alias("n"), *made)
    low, high, part = ((lambda name, k=k: F.col(f"__{name}_{k}")) for k in ("low", "high", "part"))
    return out.select(*keys, "n", *((low(k) + part(k) * (high(k) - low(k))).alias(k) for k in shares))


def box_stats(df: DataFrame, keys: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """What a box plot shows: quartiles, the last values within ``reach`` times their distance, and how many lie beyond."""
    q = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    low, high, v = F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1")), F.col(value)
    x = df.where(v.isNotNull()).join(q, keys)
    ends = x.groupBy(*keys).agg(F.min(F.when(v >= low, v)).alias("whisker_low"), F.max(F.when(v <= high, v)).alias("whisker_high"), F.count_if((v < low) | (v > high)).alias("n_outliers"))
    return q.join(ends, keys)


def axis_limits(df: DataFrame, outer: list[str], panel: str, value: str, marks: DataFrame) -> DataFrame:
    """Shared limits of the panels of each outer group, with room for the brackets counted in marks (outer, panel, n_marks)."""
    whole = df.where(F.col(value).isNotNull()).groupBy(*outer).agg(F.min(value).alias("least"), F.greatest(F.max(value) - F.min(value), F.lit(1e-9)).alias("range"))
    tops = df.groupBy(*outer, panel).agg(F.max(value).alias("top")).join(marks, [*outer, panel], "left").join(whole, outer)
    need = F.col("top") + F.col("range") * (0.22 + 0.25 * F.coalesce("n_marks", F.lit(0)))
    return tops.groupBy(*outer).agg((F.min("least") - 0.05 * F.max("range")).alias("low"), F.max(need).alias("high"))


def in_order(key: str, *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def perturbation(df: DataFrame, key: str, order: list[str], x: str, k: int = 5) -> DataFrame:
    """Cycle-to-cycle measures of each key: mean and relative jitter, shimmer, perturbation factor and quotient, RAP, VI."""
    w = in_order(key, *order)
    centred = w.rowsBetween(-(k // 2), k // 2)
    three = w.rowsBetween(-1, 1)
    v = F.col(x)
    step = df.withColumn("d", v - F.lag(x).over(w)).withColumn("ratio", F.try_divide(F.lag(x).over(w), v)).withColumn("ma", F.when(F.count(x).over(centred) == k, F.avg(x).over(centred))).withColumn("m3", F.when(F.count(x).over(three) == 3, F.avg(x).over(three)))
    return step.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg(F.abs("d")).alias("mean_jitter"),
        (100 * F.try_divide(F.avg(F.abs("d")), F.avg(F.abs(v)))).alias("jitter_percent"),
        (20 * F.avg(F.abs(F.when(F.col("ratio") > 0, F.log10("ratio"))))).alias("shimmer_db"),
        (100 * F.avg(F.abs(F.try_divide(F.col("d"), v)))).alias("perturbation_factor"),
        (100 * F.avg(F.abs(1 - F.try_divide(v, F.col("ma"))))).alias("perturbation_quotient"),
        F.try_divide(F.sum(F.abs(F.col("m3") - v)), F.sum(v)).alias("rap"),
        (1000 * F.try_divide(F.var_pop(x), F.pow(F.avg(x), F.lit(2)))).alias("variability_index"),
    )


def moving(df: DataFrame, key: str, order: list[str], x: str, reach: int = 2) -> DataFrame:
    """Edge-truncated and zero-padded centred means."""
    w = in_order(key, *order).rowsBetween(-reach, reach)
    return df.withColumn("truncated", F.avg(x).over(w)).withColumn("padded", F.sum(x).over(w) / (2 * reach + 1))


def line_fit(df: DataFrame, key: str, x: Column, y: Column) -> DataFrame:
    """Least-squares line of each key with the root mean square of its residuals."""
    return df.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.sqrt(F.greatest(F.var_pop(y) - F.try_divide(F.pow(F.covar_pop(x, y), F.lit(2)), F.var_pop(x)), F.lit(0.0))).alias("rmse"))


def time_aggregate(df: DataFrame, keys: list[str], x: str, t: str) -> DataFrame:
    """Fifteen statistics of each key's values; the deviations about mean and median need a second pass.

    Quantiles come from cumulated counts, so a key may hold any number of values.
    """
    v = F.col(x)
    fit = F.sqrt(F.greatest(F.var_pop(x) - F.try_divide(F.pow(F.covar_pop(t, x), F.lit(2)), F.var_pop(t)), F.lit(0.0)))
    first = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"), F.max(x).alias("most"), F.min(x).alias("least"), F.regr_slope(v, F.col(t)).alias("slope"), fit.alias("rmse"))
    first = meet(first, quantiles(df, keys, x, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n"), keys, "left")
    about = meet(df, first.select(*keys, F.col("mean").alias("__mean"), F.col("median").alias("__median")), keys)
    away = about.select(*keys, F.abs(v - F.col("__mean")).alias("__a"), F.abs(v - F.col("__median")).alias("__d"))
    first = meet(first, away.groupBy(*keys).agg(F.avg("__a").alias("mean_abs_dev")), keys)
    first = meet(first, quantiles(away, keys, "__d", {"median_abs_dev": 0.5}).drop("n"), keys, "left")
    return first.select(*keys, "mean", "sd", "skew", "kurt", "mean_abs_dev", "median_abs_dev", "median", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "most", "least", (F.col("most") - F.col("least")).alias("span"), "slope", "rmse")
