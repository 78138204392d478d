"""Relational operators: reshaping, summaries, joins, sets and rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import applied, t_quantile
from .statistics import cumulated, meet, quantiles


def unpivot_long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    return df.unpivot(ids, features, "feature", "value")


def descriptives(long: DataFrame, keys: list[str], subject: str) -> DataFrame:
    """Count, subjects, mean, sample sd, median, interquartile range, least and largest value of each cell.

    Quantiles come from cumulated counts; a cell without values has a count of 0 and nulls.
    """
    out = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))
    subjects = long.select(*keys, subject).distinct().groupBy(*keys).agg(F.count(subject).alias("n_subjects"))
    q = quantiles(long, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    out = meet(meet(out, subjects, keys), q, keys, "left")
    return out.select(*keys, "n", "n_subjects", "mean", "sd", "median", (F.col("q3") - F.col("q1")).alias("iqr"), "least", "most")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass: for each column its nulls, zeros and population variance, as rows."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.count(F.col(c)).alias("n_present"), F.coalesce(F.avg((F.col(c) == 0).cast("double")), F.lit(0.0)).alias("zero_fraction"), F.var_pop(F.col(c).cast("double")).alias("variance")).alias(c) for c in columns]
    return df.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows that have both; null where one is constant.

    Numpy sums centred products of all pairs within a batch, Spark adds the sums: any number of columns compiles.
    """
    means = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"__{c}") for c in columns))  # one row
    centred = df.join(F.broadcast(means)).select(*(F.coalesce(F.col(c).cast("double") - F.col(f"__{c}"), F.lit(float("nan"))).alias(c) for c in columns))
    out = _pairs(centred, len(columns), lambda frame: frame.to_numpy(float))
    label = F.array(*map(F.lit, columns))
    return out.select(label[F.col("i")].alias("a"), label[F.col("j")].alias("b"), "r")


def vector_correlations(df: DataFrame, vector: str, width: int) -> DataFrame:
    """(i, j, r) with i < j: the same for the places of a vector column; null and non-finite entries are missing, shorter vectors lack their ends.

    Columns by the thousand are better held as one vector: a plan with an expression for each takes longer than the sums.
    """

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        out = np.full((len(frame), width), np.nan)
        for row, v in zip(out, frame.iloc[:, 0]):
            if v is not None:
                row[: len(v)] = np.asarray(v, float)[:width]
        return np.where(np.isfinite(out), out, np.nan)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(width, np.int64), np.zeros(width)
        for frame in frames:
            x = matrix(frame)
            n, total = n + (~np.isnan(x)).sum(0), total + np.nansum(x, 0)
        yield pd.DataFrame({"i": np.arange(width), "n": n, "s": total})

    x = df.select(F.col(vector).cast("array<double>").alias("v"))
    added = x.mapInPandas(sums, "i int, n long, s double").groupBy("i").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m")).collect()  # a row a place
    means = np.zeros(width)
    for r in added:
        means[r["i"]] = r["m"] or 0.0
    return _pairs(x, width, lambda frame: matrix(frame) - means)


def _pairs(df: DataFrame, width: int, matrix) -> DataFrame:
    """(i, j, r) of centred columns, from the sums of products that ``matrix`` makes of a batch; missing ones are nan."""
    i, j = np.triu_indices(width, 1)
    names = ["n", "sa", "sb", "saa", "sbb", "sab"]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), len(i)))
        for frame in frames:
            x = matrix(frame)
            has = ~np.isnan(x)
            x, m = np.where(has, x, 0.0), has.astype(float)
            one, two = x.T @ m, (x * x).T @ m
            total += np.stack([(m.T @ m)[i, j], one[i, j], one[j, i], two[i, j], two[j, i], (x.T @ x)[i, j]])
        yield pd.DataFrame({"i": i, "j": j} | dict(zip(names, total)))

    parts = df.mapInPandas(sums, "i int, j int, " + ", ".join(f"{n} double" for n in names))
    s = parts.groupBy("i", "j").agg(*(F.sum(n).alias(n) for n in names))
    n = F.col("n")

    def spread(c: str) -> Column:
        whole = n * F.col(f"s{c}{c}")
        left = whole - F.col(f"s{c}") * F.col(f"s{c}")
        return F.when(left > 1e-12 * whole, left)  # else rounding of a constant column

    r = F.try_divide(n * F.col("sab") - F.col("sa") * F.col("sb"), F.sqrt(spread("a") * spread("b")))
    return s.select("i", "j", r.alias("r"))


def cap_per_cell(df: DataFrame, cell: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each cell: a resampling step that the analysis asks for."""
    return df.withColumn("pick", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where(F.col("pick") <= cap)


def stratified(df: DataFrame, stratum: str, order: str, ties: list[str], share: float) -> DataFrame:
    """The first ``share`` of each stratum by a numeric ``order``, then ``ties``: places are prefix sums, no task holds a stratum.

    Rows without an order take no part.
    """
    at = cumulated(df, [stratum], order)
    x = meet(df, at, [stratum, order]).withColumn("pick", F.col("below") + F.row_number().over(Window.partitionBy(stratum, order).orderBy(*ties)))
    return x.where(F.col("pick") <= F.round(F.lit(share) * F.col("whole"))).drop("t", "below", "whole")


def compare_outer(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Full outer comparison of two summaries; what is missing counts as 0."""
    return left.join(right, key, "full").select(key, F.coalesce(a, F.lit(0.0)).alias(a), F.coalesce(b, F.lit(0.0)).alias(b)).withColumn("delta", F.col(a) - F.col(b))


def first_of(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    head, *rest = rules
    return reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rest, F.when(head[0], F.lit(head[1]))).otherwise(F.lit(default))


def effect_size(d: Column) -> Column:
    size = F.abs(d)
    return first_of([(size < 0.2, "Negligible"), (size < 0.5, "Small"), (size < 0.8, "Medium")], "Large")


def stars(p: Column) -> Column:
    return first_of([(p < 0.001, "***"), (p < 0.01, "**"), (p < 0.05, "*")], "")


def permanence(early: Column, late: Column) -> Column:
    return first_of([((early == "Large") & late.isin("Negligible", "Small"), "Temporary"), ((early == "Large") & (late == "Large"), "Permanent")], "Other")


def membership(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of key sets with a flag for each set that a key is in."""
    marked = reduce(DataFrame.unionByName, [df.select(key, F.lit(name).alias("origin")) for name, df in sets.items()])
    return marked.groupBy(key).agg(*(F.max((F.col("origin") == name).cast("int")).alias(f"in_{name}") for name in sets))


def grid(rows: DataFrame, subjects: DataFrame, subject: str, week: str, weeks: int) -> DataFrame:
    """A row for each subject and week number with the count of its rows, 0 where it has none."""
    full = subjects.select(subject).distinct().select(subject, F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias(week))
    return full.join(rows.groupBy(subject, week).agg(F.count("*").alias("n")), [subject, week], "left").select(subject, week, F.coalesce("n", F.lit(0)).alias("n"))


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], at: Column, begin: str, end: str, width: float) -> DataFrame:
    """points in spans, both ends closed, as an equi-join on buckets of ``width`` and the exact condition."""
    p = points.withColumn("__at", at).withColumn("__bucket", F.floor(F.col("__at") / width))
    s = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))))
    return p.join(s, [*keys, "__bucket"]).where(F.col("__at").between(F.col(begin), F.col(end))).drop("__bucket", "__at")


def latest(df: DataFrame, keys: list[str], version: Column, value: str) -> DataFrame:
    """The value of the newest version under each key; unparsable versions come last."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(F.coalesce(version, F.to_timestamp(F.lit("1900-01-01"))), F.col(value))).alias(value))


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls take their column's mean; the one row of means is broadcast."""
    means = df.agg(*(F.avg(c).alias(f"__{c}") for c in columns))
    return df.join(F.broadcast(means)).select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else c for c in df.columns))


def consistency(scores: list[Column], high: float, some: float) -> Column:
    """High where at least two scores reach ``high``, Moderate where two reach ``some``, else Low."""
    reached = lambda t: reduce(Column.__add__, [(s >= t).cast("int") for s in scores])
    return first_of([(reached(high) >= 2, "High"), (reached(some) >= 2, "Moderate")], "Low")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted rows whose keys are not yet written."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def walk(tree: DataFrame, root: Column, depth: int) -> DataFrame:
    """Nodes (key, name, parent) below the roots with their least depth; children have larger keys than their parents."""
    level = tree.where(root).select("key", "name", F.lit(0).alias("depth"))
    out = level
    for k in range(1, depth + 1):
        above = level.select(F.col("key").alias("__above")).distinct()
        level = tree.join(above, (F.col("parent") == F.col("__above")) & (F.col("key") > F.col("__above"))).select("key", "name", F.lit(k).alias("depth"))
        out = out.unionByName(level)
    return out.groupBy("key", "name").agg(F.min("depth").alias("depth"))


def correlated(pairs: DataFrame, variances: dict[str, float], order: list[str], limit: float = 0.95) -> list[str]:
    """Columns to drop among pairs over the limit: of two, the one of less variance; pairs are as many as columns allow."""
    over = {(r["a"], r["b"]) for r in pairs.where(F.abs("r") > limit).collect()}
    dropped: set[str] = set()
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if a in dropped:
                break
            if b not in dropped and ((a, b) in over or (b, a) in over):
                dropped.add(b if variances[a] >= variances[b] else a)
    return [c for c in order if c in dropped]


def relabelled(df: DataFrame, column: str, labels: dict[str, str | None], to: str) -> DataFrame:
    """Adds the label of each value; rows whose value has none, or a null one, are dropped."""
    known = F.create_map(*(x for k, v in labels.items() if v is not None for x in (F.lit(k), F.lit(v))))
    return df.withColumn(to, known[F.col(column)]).where(F.col(to).isNotNull())


def coded(column: str, codes: dict[str, str], default: str = "?") -> Column:
    return F.coalesce(F.create_map(*(x for k, v in codes.items() for x in (F.lit(k), F.lit(v))))[F.col(column)], F.lit(default))


def with_dimension(df: DataFrame, dimension: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """A dimension's value for each row, the default where its key is unknown; keys of the dimension are distinct."""
    return df.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns, or an error that shows the first ten that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{len(missing)} columns are missing: {missing[:10]}")
    return df.select(*columns)


def features_after(columns: list[str], last: str) -> list[str]:
    """Feature columns by place: those after the last column of metadata."""
    return columns[columns.index(last) + 1 :]


def features_besides(columns: list[str], metadata: list[str]) -> list[str]:
    """Feature columns by name: those that are not metadata."""
    return [c for c in columns if c not in set(metadata)]


def schema_faults(df: DataFrame, columns: list[str], numeric: list[str]) -> list[str]:
    """What is wrong with a table's columns, in words; empty where nothing is."""
    kinds = dict(df.dtypes)
    faults = [] if df.columns == columns else [f"columns are {df.columns}, not {columns}"]
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return faults + [f"{c} is {kinds.get(c, 'missing')}, not a number" for c in numeric if kinds.get(c) not in plain and not kinds.get(c, "").startswith("decimal")]


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_broken): rows for which each rule is false or null, all in one pass."""
    counts = [F.struct(F.lit(k).alias("rule"), F.count_if(~F.coalesce(c, F.lit(False))).alias("n_broken")) for k, c in rules.items()]
    return df.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))


def drop_reasons(profiled: DataFrame, fixed: list[str], most_missing: float = 0.5, most_zero: float = 0.5, least_variance: float = 1e-8) -> DataFrame:
    """Why a column of ``profile`` is dropped: named, mostly missing, mostly zero, nearly constant; or kept."""
    share = F.try_divide(F.col("n_missing"), F.col("n_missing") + F.col("n_present"))
    rules = [(F.col("feature").isin(fixed), "named"), (share > most_missing, "missing"), (F.col("zero_fraction") > most_zero, "zero"), (F.coalesce("variance", F.lit(0.0)) <= least_variance, "constant")]
    return profiled.select("feature", first_of(rules, "kept").alias("reason"))


def consensus(df: DataFrame, feature: str, group: str, category: str, wanted: list[str], groups: list[str], least: int = 2) -> DataFrame:
    """Features that at least ``least`` groups put in the same wanted category, with every group's category."""
    wide = df.groupBy(feature).pivot(group, groups).agg(F.first(category))
    agree = df.where(F.col(category).isin(wanted)).groupBy(feature, category).agg(F.array_join(F.array_sort(F.collect_set(group)), ", ").alias("groups"), F.countDistinct(group).alias("n_groups"))
    return agree.where(F.col("n_groups") >= least).join(wide, feature).select(feature, category, "groups", "n_groups", *(F.coalesce(g, F.lit("-")).alias(f"{category}_{g}") for g in groups))


def counted(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """How many rows of each group have each value, 0 included, and all of them."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == v).alias(f"n_{v.lower()}") for v in values))


def selection_shares(df: DataFrame, feature: str, replicate: str, label: str, coefficient: str, labels: list[str]) -> DataFrame:
    """Shares of replicates that select a feature, in any class and in each, and its mean absolute coefficient.

    ``when_selected`` is over the replicates that select it in any class, 0 where none does.
    """
    size = F.abs(F.col(coefficient))
    one = df.groupBy(feature, replicate).agg(F.max((size > 0).cast("int")).alias("__any"), F.sum(size).alias("__sum"), F.count(size).alias("__size"), *(F.max(F.when(F.col(label) == v, (size > 0).cast("int"))).alias(f"__in_{v}") for v in labels))
    taken = F.col("__any") == 1
    when = F.try_divide(F.sum(F.when(taken, F.col("__sum"))), F.sum(F.when(taken, F.col("__size"))))
    return one.groupBy(feature).agg(F.avg("__any").alias("share_any"), *(F.avg(f"__in_{v}").alias(f"share_{v}") for v in labels), F.coalesce(when, F.lit(0.0)).alias("when_selected"), F.try_divide(F.sum("__sum"), F.sum("__size")).alias("mean_all"))


def marked_grid(cells: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """A grid's counts as marks: X where nothing was recorded, else the count."""
    known = recorded.select(*keys).distinct().withColumn("__known", F.lit(True))
    return cells.join(known, keys, "left").select(*keys, F.when(F.col("__known"), F.col("n").cast("string")).otherwise("X").alias("mark"))


def unbalanced(df: DataFrame, stage: str, subject: str) -> DataFrame:
    """Subjects of each stage against all subjects, and whether some are missing."""
    pairs = df.select(stage, subject).distinct()
    total = pairs.select(subject).distinct().agg(F.count(subject).alias("n_all"))  # one row
    return pairs.groupBy(stage).agg(F.count(subject).alias("n_subjects")).join(F.broadcast(total)).select(stage, "n_subjects", "n_all", (F.col("n_subjects") < F.col("n_all")).alias("incomplete"))


def intervals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard error and 95 % interval by Student's t of each cell; a single value has neither."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    out = out.withColumn("se", F.try_divide("sd", F.sqrt("n"))).withColumn("__t", applied(partial(t_quantile, 0.975), F.greatest(F.col("n") - 1, F.lit(1)).cast("double")))
    return out.select(*keys, "n", "mean", "se", (F.col("mean") - F.col("__t") * F.col("se")).alias("low"), (F.col("mean") + F.col("__t") * F.col("se")).alias("high"))


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows: Spark takes k of each partition and merges them, it doesn't sort the table."""
    return df.orderBy(*order).limit(k)
