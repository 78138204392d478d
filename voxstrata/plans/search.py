"""Registered queries: searches of trees, containment, the correlation filter, headers of written recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational, search
from ..sources import audio, headers, shared
from .catalogue import query, r4, table
from .frames import BLOCKS

PATTERNS, DEPTH = ["WIDGET", "gear"], 3


@query(
    f"""WITH RECURSIVE t AS (SELECT p_partkey AS key, p_partkey * 7919 % 400 AS parent, p_name AS name FROM part),
w AS (SELECT r.p_partkey AS root, r.p_partkey AS key, ''::VARCHAR AS name, -1 AS depth, []::VARCHAR[] AS path, [r.p_partkey] AS seen, false AS hit, r.p_brand FROM part r WHERE p_partkey < 400 AND p_partkey % 50 = 7
  UNION ALL SELECT w.root, t.key, t.name, w.depth + 1, list_append(w.path, t.name), list_append(w.seen, t.key), contains(lower(t.name), 'widget') OR contains(lower(t.name), 'gear'), w.p_brand
  FROM w JOIN t ON t.parent = w.key WHERE NOT w.hit AND w.depth < {DEPTH} AND NOT list_contains(w.seen, t.key)),
o AS (SELECT *, row_number() OVER (PARTITION BY root, key ORDER BY depth, path) AS k FROM w WHERE depth >= 0)
SELECT root, key, name, depth, array_to_string(path, '/') AS path, p_brand FROM o WHERE k = 1 AND hit"""
)
def folder_search(spark, d):
    """Nodes named after a pattern below some roots, whose column they carry; parents have smaller or larger keys, some in cycles."""
    t = table(spark, d, "part")
    tree = t.select(F.col("p_partkey").alias("key"), (F.col("p_partkey") * 7919 % 400).alias("parent"), F.col("p_name").alias("name"))
    roots = t.where("p_partkey < 400 AND p_partkey % 50 = 7").select(F.col("p_partkey").alias("key"), "p_brand")
    return search.find_below(tree, roots, PATTERNS, DEPTH)


KINDS = ["red", "BLUE", "hot", "small", "ring"]


@query(
    f"""WITH f AS (SELECT DISTINCT 'Week_' || p_size || '_' || p_name || '_' || p_brand || '_Snip' AS folder FROM part),
c AS (SELECT c_custkey, 'week_' || (c_custkey % 50 + 1) || '_' AS a, list_extract({KINDS}, c_custkey % 5 + 1) AS b, 'brand#' || (c_nationkey % 25 + 1) || '_snip' AS c FROM customer)
SELECT c_custkey, count(folder) AS n_folders, max(folder) AS folder FROM c LEFT JOIN f ON contains(lower(folder), lower(a)) AND contains(lower(folder), lower(b)) AND contains(lower(folder), lower(c)) GROUP BY c_custkey"""
)
def token_lookup(spark, d):
    """How many folders hold three pieces of each row, and the last of them."""
    folders = table(spark, d, "part").select(F.concat(F.lit("Week_"), F.col("p_size").cast("string"), F.lit("_"), "p_name", F.lit("_"), "p_brand", F.lit("_Snip")).alias("folder")).distinct()
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    pieces = [F.concat(F.lit("week_"), (F.col("c_custkey") % 50 + 1).cast("string"), F.lit("_")), F.get(F.array(*map(F.lit, KINDS)), (F.col("c_custkey") % 5).cast("int")), F.concat(F.lit("brand#"), (F.col("c_nationkey") % 25 + 1).cast("string"), F.lit("_snip"))]
    # rows that share their pieces share the answer: each set of pieces is looked up and counted once
    names = [f"piece_{i}" for i in range(len(pieces))]
    asked = rows.withColumns(dict(zip(names, pieces)))
    found = search.containing(asked.select(*names).distinct(), folders, list(map(F.col, names)), "folder").groupBy(*names).agg(F.count("*").alias("n"), F.max("folder").alias("folder"))
    return asked.join(found, names, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_folders"), "folder")


LAGS, LIMIT = 9, 0.15


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding AS x FROM embeddings),
f AS MATERIALIZED (SELECT vec_id, k * 64 + i AS place, x[i + 1]::DOUBLE * x[(i + k) % 64 + 1]::DOUBLE AS v FROM e, range(0, {LAGS}) a(k), range(0, 64) b(i)),
s AS MATERIALIZED (SELECT place, var_pop(v) AS variance FROM f GROUP BY place),
c AS MATERIALIZED (SELECT a.place AS i, b.place AS j, corr(a.v, b.v) AS r FROM f a JOIN f b ON a.vec_id = b.vec_id AND a.place < b.place GROUP BY 1, 2 HAVING abs(corr(a.v, b.v)) > {LIMIT}),
n AS MATERIALIZED (SELECT s.place, coalesce(list({{'j': j, 'goes': s.variance < t.variance}}) FILTER (WHERE j IS NOT NULL), []) AS near FROM s LEFT JOIN c ON i = s.place LEFT JOIN s t ON t.place = j GROUP BY s.place),
w AS (SELECT -1::BIGINT AS place, []::BIGINT[] AS gone
  UNION ALL SELECT n.place, CASE WHEN list_contains(gone, n.place) THEN gone ELSE list_concat(gone,
    list_concat(list_transform(list_filter(near, lambda x: NOT list_contains(gone, x.j) AND x.j < coalesce(list_min(list_transform(list_filter(near, lambda y: y.goes AND NOT list_contains(gone, y.j)), lambda y: y.j)), 99999)), lambda x: x.j),
      CASE WHEN len(list_filter(near, lambda y: y.goes AND NOT list_contains(gone, y.j))) > 0 THEN [n.place] ELSE [] END)) END
  FROM w JOIN n ON n.place = w.place + 1)
SELECT s.place, NOT list_contains(gone, s.place) AS kept, round(variance, 6) AS variance FROM s, w WHERE w.place = {LAGS * 64 - 1}"""
)
def feature_filter(spark, d):
    """Which of 576 features, products of components, a sequential filter by correlation keeps."""
    e = F.col("embedding").cast("array<double>")
    lag = lambda k: F.transform(e, lambda v, i: v * F.get(e, (i + k) % 64))
    x = table(spark, d, "embeddings").select(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LAGS - 1)), lag)).alias("x"))
    pairs = relational.vector_correlations(x, "x", LAGS * 64).where(F.abs("r") > LIMIT)
    spread = x.select(F.posexplode("x").alias("place", "v")).groupBy(F.col("place").cast("long").alias("place")).agg(F.var_pop("v").alias("variance"))
    out = search.correlation_filter(pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")), spread)
    return out.select("place", "kept", F.round("variance", 6).alias("variance"))


@query(
    f"""WITH {BLOCKS}, c AS (SELECT clip, max(t) + 1 AS n, 1000 * (1 + clip % 3) AS rate FROM s GROUP BY clip)
SELECT clip, 'set_' || clip % 5 AS parent, rate::INT AS sampling_rate, 1 AS channels, 16 AS bits, round(n / rate::DOUBLE, 6) AS duration, 44 + 2 * n AS size, 44 AS bytes_read, NULL::VARCHAR AS error FROM c"""
)
def header_durations(spark, d):
    """Recordings are written from vectors, eight each, and their headers read: 44 bytes of each file, whatever its length."""
    x = table(spark, d, "embeddings").groupBy(F.expr("vec_id div 8").alias("clip")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda r: r["embedding"])).alias("samples"))
    made = x.select(F.concat(F.lit("set_"), (F.col("clip") % 5).cast("string"), F.lit("/clip_"), F.col("clip").cast("string"), F.lit(".wav")).alias("path"), "samples", (1000 * (1 + F.col("clip") % 3)).alias("sampling_rate"))
    root = shared.fresh(spark, "recordings")
    headers.write_files(audio.encoded_clips(made), root).count()
    out = headers.read_headers(spark, root)
    return out.select(F.regexp_extract("name", r"clip_(\d+)", 1).cast("long").alias("clip"), "parent", "sampling_rate", "channels", "bits", F.round("duration", 6).alias("duration"), "size", "bytes_read", "error")
