"""Registered model queries. SQL can't express the fits; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descent as G
from ..operators import layout as L
from ..operators import models as M
from ..operators import relational as R
from ..operators import shadows as H
from ..operators import stability as V
from ..operators import statistics as T
from ..sources.shared import checkpointed
from .catalogue import query, table

STAGES = ["first", "second", "third", "fourth"]
#: Part samples of a selection.
REPLICATES = 100
#: Mixing ratios of a selection: fixed values.
RATIOS = [0.3, 0.5, 0.7, 0.9]


@query()
def lmm_contrasts(spark, d):
    """Stage contrasts of two standardised features in each group, suppliers as subjects, adjusted within the group."""
    quarter = F.quarter("l_shipdate")
    stage = R.first_of([(quarter == i + 1, s) for i, s in enumerate(STAGES[:3])], STAGES[3])
    x = table(spark, d, "lineitem").select("l_returnflag", "l_suppkey", stage.alias("stage"), "l_quantity", "l_discount")
    long = R.unpivot_long(x, ["l_returnflag", "l_suppkey", "stage"], ["l_quantity", "l_discount"])
    keys = ["feature", "l_returnflag"]
    fits = M.random_intercept(M.standardised(long, keys, "value"), keys, "l_suppkey", "stage", STAGES)
    return T.adjusted(checkpointed(fits), "p", ["l_returnflag"]).withColumn("effect", R.effect_size(F.col("estimate")))


@query()
def stability_scores(spark, d):
    """How often each numeric feature is kept when the flag is predicted, over all part samples and ratios at one strength."""
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    sample = V.class_sample(table(spark, d, "lineitem"), "l_returnflag", ["A", "N", "R"], features, ["l_orderkey", "l_linenumber"])
    return V.scores(V.replicates(sample, features, REPLICATES, RATIOS, c=0.01), RATIOS)


@query()
def lmm_interaction(spark, d):
    """Stage by flag models of two features, suppliers as subjects: terms, means, contrasts and figures of the fit."""
    quarter = F.quarter("l_shipdate")
    stage = R.first_of([(quarter == i + 1, s) for i, s in enumerate(STAGES[:3])], STAGES[3])
    x = table(spark, d, "lineitem").where("l_returnflag != 'N'").select("l_returnflag", "l_suppkey", stage.alias("at"), "l_quantity", "l_discount")
    long = R.unpivot_long(x, ["l_returnflag", "l_suppkey", "at"], ["l_quantity", "l_discount"])
    return M.interaction(long, ["feature"], "l_suppkey", "at", STAGES, "l_returnflag", ["A", "R"])


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.e, b.e) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM p)
SELECT vec_id, rank::INT AS rank, neighbour, round(d, 4) AS distance FROM r WHERE rank <= 15"""
)
def knn_topk(spark, d):
    """The 15 nearest neighbours of each vector, among all vectors, which a layout starts from."""
    return L.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 15).withColumn("distance", F.round("distance", 4))


@query()
def neighbour_graph(spark, d):
    """About the 15 nearest neighbours of each vector by descent; tests measure the share found."""
    return G.graph(table(spark, d, "embeddings"), "vec_id", "embedding", 15).withColumn("distance", F.round("distance", 4))


@query()
def graph_layout(spark, d):
    """A layout of all vectors over the graph of all of them."""
    return G.graph_layout(table(spark, d, "embeddings"), "vec_id", "embedding", 15)


@query()
def umap_layouts(spark, d):
    """Layouts of all vectors under three settings."""
    return L.layouts(table(spark, d, "embeddings"), "vec_id", "embedding", [(5, 0.1), (15, 0.1), (30, 0.5)])


@query()
def stability_decisions(spark, d):
    """Strengths by the one-error rule, then scores with and without a cap on the rows of a supplier, and decisions."""
    features, ratios = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], RATIOS
    rows, classes, key, cap = table(spark, d, "lineitem"), ["A", "N", "R"], ["l_orderkey", "l_linenumber"], 15
    sample = checkpointed(V.class_sample(rows, "l_returnflag", classes, features, key))
    pool = checkpointed(V.subject_sample(rows, "l_returnflag", classes, features, key, "l_suppkey", cap))
    strength = {r["ratio"]: r["c"] for r in V.chosen_strength(sample, features, ratios).collect()}  # a row for each ratio
    free = V.scores(checkpointed(V.replicates(sample, features, REPLICATES, ratios, strength)), ratios)
    held = V.scores(checkpointed(V.replicates(pool, features, REPLICATES, ratios, strength, cap=cap)), ratios)
    return V.decisions(free, held)


@query()
def shadow_features(spark, d):
    """Which numeric features tell the flag apart better than permuted copies, over as many forests as can tell any of them apart, twice."""
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    sample = V.class_sample(table(spark, d, "lineitem"), "l_returnflag", ["A", "N", "R"], features, ["l_orderkey", "l_linenumber"])
    return H.shadow_forest(sample, features, trees=20)
