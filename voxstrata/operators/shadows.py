"""Which features a forest of trees uses more than permuted copies of them (Kursa and Rudnicki).

Forests are Spark's own, on the bounded sample of ``stability.class_sample``, whose columns are what is permuted, inside the tasks.

Defined cases: fewer than two classes or five rows of each give no result; constant features are rejected; features that
the rounds don't decide are Tentative.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_least(hits: int, rounds: int) -> float:
    """P(so many or more heads in ``rounds`` throws of a fair coin)."""
    return sum(math.comb(rounds, k) for k in range(hits, rounds + 1)) / 2**rounds


def verdict(hits: int, rounds: int, features: int, level: float = 0.05) -> str:
    """Two-sided, with Bonferroni's correction for the number of features."""
    if at_least(hits, rounds) * features * 2 <= level:
        return "Confirmed"
    return "Rejected" if at_least(rounds - hits, rounds) * features * 2 <= level else "Tentative"


def enough(features: int, level: float = 0.05) -> int:
    """The least rounds after which a feature that always wins can be told apart, however many features there are."""
    return math.ceil(math.log2(2 * max(features, 1) / level))


def shadow_forest(sample: DataFrame, features: list[str], rounds: int | None = None, trees: int = 100, depth: int = 5, share: float = 90.0, seed: int = 0) -> DataFrame:
    """(feature, hits, rounds, importance, decision): a hit is a round in which a feature beats that percentile of the copies.

    Where no rounds are given, there are twice as many as ``enough``.
    """
    spark, schema = sample.sparkSession, "feature string, hits long, rounds long, importance double, decision string"
    held = sample.toPandas()  # bounded by class_sample
    names, y = np.unique(held["__class"].to_numpy(str), return_inverse=True)
    if len(names) < 2 or np.bincount(y).min() < 5:
        return spark.createDataFrame([], schema)
    x, k = held[features].to_numpy(float), len(features)
    hits, importance = np.zeros(k, int), np.zeros(k)
    rounds = rounds or 2 * enough(k)
    copies = -(-max(5, k) // k)  # at least five copies, so that a percentile means something
    sent = spark.sparkContext.broadcast((x, y.astype(float)))

    def rows_of(turn: int):
        """Rows by their numbers, with the permuted copies of a round: each task draws the same orders."""

        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, y = sent.value
            rng = np.random.default_rng([seed, turn])
            both = np.hstack([x, *(rng.permuted(x, axis=0) for _ in range(copies))])
            for frame in frames:
                at = frame["id"].to_numpy()
                yield pd.DataFrame({"label": y[at], "x": list(both[at])})

        return make

    for i in range(rounds):
        rows = spark.range(len(y)).mapInPandas(rows_of(i), "label double, x array<double>").select("label", array_to_vector(F.col("x")).alias("features")).cache()  # a fit passes over its rows several times
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed + i).fit(rows)
        rows.unpersist()
        gain = forest.featureImportances.toArray()
        hits += gain[:k] > max(np.percentile(gain[k:], share), 0)
        importance += gain[:k] / rounds
    made = [(f, int(h), rounds, float(g), verdict(int(h), rounds, k)) for f, h, g in zip(features, hits, importance)]
    return spark.createDataFrame(made, schema)
