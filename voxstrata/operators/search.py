"""Searches that need more than a join: trees by name with a stop at matches, containment by an index of character runs.

Defined cases: null keys, parents and names match nothing, and null parents lead nowhere; a node that is reached more than
once counts once for each root, on its shortest way, ties by the least path; cycles end, because no node is visited twice;
empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Characters in a run of the index.
RUN = 3


def matches(name: Column, patterns: list[str]) -> Column:
    """Whether a name holds any of the patterns, in any case."""
    return F.coalesce(reduce(Column.__or__, (F.lower(name).contains(p.lower()) for p in patterns), F.lit(False)), F.lit(False))


def find_below(tree: DataFrame, roots: DataFrame, patterns: list[str], most_depth: int | None = 3, stop: bool = True, rounds: int = 1000) -> DataFrame:
    """(root, key, name, depth, path, and what roots carry): nodes below each root whose names match.

    tree: (key, parent, name); roots: (key, further columns). Children of a root have depth 0. Matching nodes leave the frontier (with
    ``stop``), as do nodes that a root has visited, so keys may come in any order and parents may form cycles. A round is a join
    of the frontier with the tree, written once; ``path`` lists the names on the way.
    """
    carried = [c for c in roots.columns if c != "key"]
    nodes = tree.where("key IS NOT NULL AND parent IS NOT NULL").select("key", "parent", "name")
    start = roots.where("key IS NOT NULL").groupBy("key").agg(*(F.first(c).alias(c) for c in carried)) if carried else roots.where("key IS NOT NULL").distinct()
    start = written(start)
    frontier = start.select(F.col("key").alias("root"), "key", F.array().cast("array<string>").alias("path"))
    visited, found, depth = frontier.select("root", "key"), None, 0
    while depth < rounds and (most_depth is None or depth <= most_depth):
        above = frontier.select("root", F.col("key").alias("parent"), F.col("path").alias("way"))
        reached = nodes.join(above, "parent").select("root", "key", "name", F.concat("way", F.array(F.coalesce("name", F.lit("")))).alias("path"))
        least = reached.groupBy("root", "key").agg(F.min(F.struct("path", "name")).alias("m")).select("root", "key", "m.*")
        level = written(least.join(visited, ["root", "key"], "left_anti").withColumn("hit", matches(F.col("name"), patterns)))
        if level.isEmpty():
            break
        hits = level.where("hit").select("root", "key", "name", F.lit(depth).alias("depth"), "path")
        found = hits if found is None else found.unionByName(hits)
        visited = visited.unionByName(level.select("root", "key"))
        frontier, depth = (level.where("NOT hit") if stop else level).select("root", "key", "path"), depth + 1
    if found is None:
        found = frontier.select("root", "key", F.lit("").alias("name"), F.lit(0).alias("depth"), "path").limit(0)
    return found.join(start.withColumnRenamed("key", "root"), "root").select("root", "key", "name", "depth", F.array_join("path", "/").alias("path"), *carried)


def runs(text: Column, n: int = RUN) -> Column:
    """The distinct runs of 1 to n characters of a text, and the empty one."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.transform(F.array(*map(F.lit, range(1, n + 1))), lambda k: F.substring(text, i, k)))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(each)))


def _own_runs(needle: Column, n: int = RUN) -> Column:
    """The runs of n characters of a needle, or the whole of a shorter one: a text that holds the needle holds them all."""
    length = F.length(needle)
    return F.when(length <= n, F.array(needle)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(length - n + 1, F.lit(1))), lambda i: F.substring(needle, i, F.lit(n))))


def containing(rows: DataFrame, texts: DataFrame, needles: list[Column], text: str = "text", n: int = RUN) -> DataFrame:
    """rows joined to the texts that hold all of a row's needles, in any case: what a join on ``contains`` gives, by equal keys.

    An inverted index lists the texts that each run of up to n characters occurs in. A distinct set of needles is looked up by
    its rarest run alone (a set with a run that no text has is dropped), and what that leads to is checked by ``contains``.
    Rows and whole texts are joined to what is left, so neither is copied into the index. Null needles match nothing.
    """
    clash = set(rows.columns) & set(texts.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    x = rows.withColumn("__n", F.array(*(F.lower(c.cast("string")) for c in needles)))
    sets = x.select("__n").distinct().where(F.forall("__n", lambda v: v.isNotNull()))
    lows = texts.where(F.col(text).isNotNull()).select(F.lower(text).alias("__t")).distinct()
    index = written(lows.select("__t", F.explode(runs(F.col("__t"), n)).alias("__run")))
    wanted = written(sets.select("__n", F.explode(F.array_distinct(F.flatten(F.transform("__n", lambda v: _own_runs(v, n))))).alias("__run")))
    often = index.groupBy("__run").agg(F.count("*").alias("__often"))
    rarest = wanted.join(often, "__run", "left").groupBy("__n").agg(F.min(F.struct(F.coalesce("__often", F.lit(0)).alias("o"), F.col("__run").alias("r"))).alias("m")).where("m.o > 0").select("__n", F.col("m.r").alias("__run"))
    met = rarest.join(index, "__run").where(F.forall("__n", lambda v: F.col("__t").contains(v))).select("__n", "__t")
    return x.join(met, "__n").join(texts.withColumn("__t", F.lower(text)), "__t").drop("__n", "__t")


def correlation_filter(edges: DataFrame, features: DataFrame, rounds: int = 10_000) -> DataFrame:
    """features (place, feature, variance) with ``kept`` and, for those dropped, ``by``: the place of the feature it was dropped for.

    edges: pairs of places (i, j) that are correlated beyond the limit. The rule is sequential: features in order of place, each
    against its later partners that are left, in order; of the two the one of less variance goes (the later one at equal
    variance), and a feature that goes is held against no further ones. What a feature does depends on the features before it
    within two steps of the graph alone, so a round takes all those that are the least among these at once; they share no
    partner. Features that are through leave the graph. A round is a few joins of what is left, written once.
    """
    facts = written(features.select(F.col("place").alias("p"), F.col("variance").alias("v")))
    pairs = edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    vi, vj = facts.withColumnsRenamed({"p": "i", "v": "vi"}), facts.withColumnsRenamed({"p": "j", "v": "vj"})
    left = written(pairs.join(vi, "i").join(vj, "j").select("i", "j", (F.col("vi") < F.col("vj")).alias("first_goes")))
    gone = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        both = left.select(F.col("i").alias("a"), F.col("j").alias("b")).unionByName(left.select(F.col("j").alias("a"), F.col("i").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        far = both.join(near.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b").groupBy("a").agg(F.min("mb").alias("mm"))
        ready = near.join(far, "a").where((F.col("a") == F.col("m")) & (F.col("a") == F.col("mm"))).select(F.col("a").alias("i"))
        mine = left.join(ready, "i")
        ends = mine.groupBy("i").agg(F.min(F.when(F.col("first_goes"), F.col("j"))).alias("end"))
        told = mine.join(ends, "i")
        drops = told.where("end IS NULL OR j < end").select(F.col("j").alias("p"), F.col("i").alias("by")).unionByName(ends.where("end IS NOT NULL").select(F.col("i").alias("p"), F.col("end").alias("by")))
        through = written(ready.select(F.col("i").alias("p"), F.lit(None).cast("long").alias("by")).unionByName(drops))
        out = through.where("by IS NOT NULL").groupBy("p").agg(F.min("by").alias("by"))
        gone = out if gone is None else gone.unionByName(out)
        over = through.select("p").distinct()
        left = written(left.join(over.withColumnRenamed("p", "i"), "i", "left_anti").join(over.withColumnRenamed("p", "j"), "j", "left_anti").select("i", "j", "first_goes"))
    else:
        raise RuntimeError(f"not settled in {rounds} rounds")
    if gone is None:
        return features.withColumns({"kept": F.lit(True), "by": F.lit(None).cast("long")})
    return features.join(gone.withColumnRenamed("p", "place"), "place", "left").withColumn("kept", F.col("by").isNull())
