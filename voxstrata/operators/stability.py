"""Stability selection: how often an elastic-net classifier keeps a feature over many part samples.

The fits work on a sample of at most ``most`` rows a class, taken by the order of a hash over all rows; the sample is what
is broadcast, and bounded by most * classes * features. Where rows are capped by subject, the cap is applied to all rows
before that bound (``subject_sample``): what a capped replicate sees doesn't depend on how many rows a subject has.
Replicates and mixing ratios are rows that Spark spreads over tasks; frequencies and labels are aggregates over their
results.

Defined cases: rows with a null label, feature or key take no part; constant features are never kept; fewer than two classes
or five rows of each give no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from . import relational as R

#: Rows of each class that the fits see.
MOST = 2000
#: Rows of a subject and class in the pool of capped replicates, as a multiple of the cap.
POOL = 4
#: A coefficient beyond this counts as kept.
KEPT = 1e-8


def class_sample(df: DataFrame, label: str, classes: list[str], features: list[str], key: list[str], most: int = MOST, seed: int = 0, subject: str | None = None) -> DataFrame:
    """The first rows of each class by a hash of the key: a partial top-k in each task, no sort of a whole class."""
    who = [F.col(subject).cast("string").alias("__subject")] if subject else []
    x = _fit_rows(df, label, features, key, seed, who)
    parts = [x.where(F.col("__class") == c).orderBy("__order", *features).limit(most) for c in classes]
    return reduce(DataFrame.unionByName, parts).drop("__order")


def _fit_rows(df: DataFrame, label: str, features: list[str], key: list[str], seed: int, who: list[Column]) -> DataFrame:
    return df.select(F.col(label).cast("string").alias("__class"), *who, *(F.col(f).cast("double").alias(f) for f in features), F.xxhash64(F.lit(seed), *key).alias("__order")).dropna()


def subject_sample(df: DataFrame, label: str, classes: list[str], features: list[str], key: list[str], subject: str, cap: int, most: int = MOST, seed: int = 0) -> DataFrame:
    """The pool of capped replicates: ``POOL * cap`` rows of each subject and class among all rows, whole subjects up to ``most`` rows a class.

    The rank within a subject is bounded, so Spark cuts each task's rows before the shuffle and a subject with most of the
    rows sends no more than that from each task. Subjects are taken in the order of a hash.
    """
    x = _fit_rows(df, label, features, key, seed, [F.col(subject).cast("string").alias("__subject")]).where(F.col("__class").isin(classes))
    place = Window.partitionBy("__class", "__subject").orderBy("__order", *features)
    x = x.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= POOL * cap)
    x = x.withColumn("__whose", F.xxhash64(F.lit(seed), "__subject"))
    parts = [x.where(F.col("__class") == c).orderBy("__whose", "__subject", "__order", *features).limit(most) for c in classes]
    return reduce(DataFrame.unionByName, parts).drop("__order", "__place", "__whose")


def elastic_net(x: np.ndarray, y: np.ndarray, classes: int, c: float, ratio: float, steps: int = 300) -> np.ndarray:
    """Coefficients (features, classes) of a class-balanced multinomial model."""
    return with_shift(x, y, classes, c, ratio, steps)[:-1]


def with_shift(x: np.ndarray, y: np.ndarray, classes: int, c: float, ratio: float, steps: int = 300) -> np.ndarray:
    """The same with the classes' shifts as last row, by accelerated proximal gradient steps."""
    n, k = x.shape
    counts = np.bincount(y, minlength=classes)
    w = (n / (np.maximum(counts, 1) * (counts > 0).sum()))[y] / n
    penalty = 1 / (c * n)
    target = np.eye(classes)[:, y]  # classes as rows, so that sums over them run along the rows of the data
    z = np.vstack([x.T, np.ones(n)])
    rate = 1 / (0.5 * np.linalg.norm((z * w) @ z.T, 2) + penalty)
    b = np.zeros((k + 1, classes))
    ahead, t = b, 1.0
    for _ in range(steps):
        score = ahead.T @ z
        p = np.exp(score - score.max(0))
        p /= p.sum(0)
        slope = z @ ((p - target) * w).T
        slope[:k] += penalty * (1 - ratio) * ahead[:k]
        new = ahead - rate * slope
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * penalty * ratio, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (old - 1) / t * (new - b)
        if np.abs(new - b).max() < 1e-7:
            b = new
            break
        b = new
    return b


def scaled(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of columns; constant ones have deviation 1."""
    spread = part.std(0)
    return part.mean(0), np.where(spread > 0, spread, 1)


def drawn(y: np.ndarray, subjects: np.ndarray | None, classes: int, share: float, cap: int | None, rng: np.random.Generator) -> np.ndarray:
    """A share of each class; with ``cap``, at most so many rows of each subject and class instead."""
    order = rng.permutation(len(y))
    if cap is None:
        return np.concatenate([order[y[order] == k][: max(1, round(share * (y == k).sum()))] for k in range(classes)])
    pick = pd.DataFrame({"y": y[order], "s": subjects[order]}).groupby(["y", "s"]).cumcount().to_numpy()
    return order[pick < cap]


def _jobs(sample: DataFrame, features: list[str], rows: DataFrame, on: list[str], schema: str, fit) -> DataFrame:
    """``fit`` of each row of ``rows`` and the sample, which goes to all tasks; nothing where classes or rows are too few."""
    spark = sample.sparkSession
    held = sample.toPandas()  # bounded by class_sample
    names, y = np.unique(held["__class"].to_numpy(str), return_inverse=True)
    if len(names) < 2 or np.bincount(y).min() < 5:
        return spark.createDataFrame([], schema)
    subjects = held["__subject"].to_numpy(str) if "__subject" in held else None
    sent = spark.sparkContext.broadcast((held[features].to_numpy(float), y, subjects, len(names)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                yield fit(*sent.value, row)

    return rows.repartition(4 * spark.sparkContext.defaultParallelism, *on).mapInPandas(run, schema)


def replicates(sample: DataFrame, features: list[str], count: int, ratios: list[float], c: float | dict[float, float], share: float = 0.7, seed: int = 0, cap: int | None = None) -> DataFrame:
    """(replicate, ratio, feature, kept, size) of every fit; ``c`` may differ by ratio. ``cap`` needs a ``subject_sample``.

    A capped replicate is skipped where a class is down to fewer than two rows.
    """
    schema = "replicate long, ratio double, feature string, kept boolean, size double"
    strength = c if isinstance(c, dict) else dict.fromkeys(map(float, ratios), c)

    def fit(x: np.ndarray, y: np.ndarray, subjects: np.ndarray | None, classes: int, row: dict) -> pd.DataFrame:
        rows = drawn(y, subjects, classes, share, cap, np.random.default_rng([seed, int(row["id"])]))
        if cap is not None and np.bincount(y[rows], minlength=classes).min() < 2:
            return pd.DataFrame({"replicate": [], "ratio": [], "feature": [], "kept": [], "size": []})
        mean, spread = scaled(x[rows])
        b = elastic_net((x[rows] - mean) / spread, y[rows], classes, strength[row["ratio"]], row["ratio"])
        return pd.DataFrame({"replicate": row["id"], "ratio": row["ratio"], "feature": features, "kept": (np.abs(b) > KEPT).any(1), "size": np.abs(b).mean(1)})

    jobs = sample.sparkSession.range(count).select("id", F.explode(F.array(*map(F.lit, map(float, ratios)))).alias("ratio"))
    return _jobs(sample, features, jobs, ["id", "ratio"], schema, fit)


#: Trial strengths: thirty from 1e-3 to 1e2 in even steps of the logarithm.
STRENGTHS = tuple(float(c) for c in np.logspace(-3, 2, 30))


def chosen_strength(sample: DataFrame, features: list[str], ratios: list[float], strengths: tuple[float, ...] = STRENGTHS, folds: int = 5, seed: int = 0) -> DataFrame:
    """(ratio, c): the smallest strength whose balanced accuracy, over stratified folds, is within one error of the best."""

    def fit(x: np.ndarray, y: np.ndarray, subjects: np.ndarray | None, classes: int, row: dict) -> pd.DataFrame:
        order = np.random.default_rng(seed).permutation(len(y))
        fold = np.empty(len(y), int)
        fold[order] = pd.Series(y[order]).groupby(y[order]).cumcount().to_numpy() % folds
        fitted, held = fold != row["fold"], fold == row["fold"]
        mean, spread = scaled(x[fitted])
        b = with_shift((x[fitted] - mean) / spread, y[fitted], classes, row["c"], row["ratio"])
        guess = ((x[held] - mean) / spread @ b[:-1] + b[-1]).argmax(1)
        right = [(guess[y[held] == k] == k).mean() for k in range(classes) if (y[held] == k).any()]
        return pd.DataFrame({"ratio": [row["ratio"]], "c": [row["c"]], "accuracy": [float(np.mean(right))]})

    one = lambda values: F.explode(F.array(*map(F.lit, map(float, values))))
    jobs = sample.sparkSession.range(folds).toDF("fold").withColumn("ratio", one(ratios)).withColumn("c", one(strengths))
    by = _jobs(sample, features, jobs, ["fold", "ratio", "c"], "ratio double, c double, accuracy double", fit)
    by = by.groupBy("ratio", "c").agg(F.avg("accuracy").alias("mean"), (F.stddev_pop("accuracy") / float(np.sqrt(folds))).alias("error"))
    by = checkpointed(by)  # the fits, which both sides of the join read
    best = by.groupBy("ratio").agg(F.max_by(F.col("mean") - F.col("error"), F.struct("mean", -F.col("c"))).alias("least"))
    return by.join(best, "ratio").where("mean >= least").groupBy("ratio").agg(F.min("c").alias("c"))


def decisions(uncapped: DataFrame, capped: DataFrame) -> DataFrame:
    """Scores with and without the cap on subjects, what the cap changes, and the decision that follows."""
    both = R.compare_outer(uncapped.select("feature", F.col("mean_pi").alias("free")), capped.select("feature", F.col("mean_pi").alias("held")), "feature", "free", "held")
    role = R.first_of([(F.col("delta") <= 0.2, "Stable"), (F.col("delta") > 0.35, "Subject-dominated")], "Reduced")
    x = both.join(uncapped.select("feature", "label"), "feature", "left").withColumn("capping", role)
    flagged = F.col("capping") == "Subject-dominated"
    rules = [((F.col("label") == "High") & (F.col("held") >= 0.5) & ~flagged, "Strong"), (F.col("label").isin("High", "Moderate") & (F.col("held") >= 0.4) & ~flagged, "Moderate"), (flagged, "Exploratory")]
    return x.withColumn("decision", R.first_of(rules, "Exclude"))


def scores(fits: DataFrame, ratios: list[float], high: float = 0.7, some: float = 0.5) -> DataFrame:
    """Frequencies of each feature by mixing ratio, their mean and most, the mean size when kept, and a label."""
    by = fits.groupBy("feature", "ratio").agg(F.avg(F.col("kept").cast("double")).alias("pi"), F.sum(F.when(F.col("kept"), F.col("size"))).alias("s"), F.count_if("kept").alias("k"))
    per = [F.max(F.when(F.col("ratio") == r, F.col("pi"))) for r in ratios]
    out = by.groupBy("feature").agg(F.avg("pi").alias("mean_pi"), F.max("pi").alias("max_pi"), F.coalesce(F.try_divide(F.sum("s"), F.sum("k")), F.lit(0.0)).alias("mean_size"), F.array(*per).alias("__pi"))
    return out.withColumn("label", R.consistency([F.col("__pi")[i] for i in range(len(ratios))], high, some)).drop("__pi")
