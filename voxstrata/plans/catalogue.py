"""The registered queries outside the llm subpackage, each with SQL to hold its result against.

Doubles are rounded to four places on both sides: sums in another order differ in their last bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators import statistics as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query; without SQL, tests hold it against brute force."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = "SELECT {ids}, 'l_quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT {ids}, 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT {ids}, 'l_discount', l_discount FROM lineitem UNION ALL SELECT {ids}, 'l_tax', l_tax FROM lineitem"


@query(
    f"""WITH long AS ({LONG.format(ids="l_returnflag, l_linestatus, l_suppkey")})
SELECT feature, l_returnflag, l_linestatus, count(value) AS n, count(DISTINCT l_suppkey) AS n_subjects, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd,
  round(quantile_cont(value, 0.5::DOUBLE), 4) AS median, round(quantile_cont(value, 0.75::DOUBLE) - quantile_cont(value, 0.25::DOUBLE), 4) AS iqr, min(value) AS least, max(value) AS most
FROM long GROUP BY ALL"""
)
def descriptives_by_cell(spark, d):
    """Descriptives of every numeric feature in each group and stage."""
    x = R.unpivot_long(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"], FEATURES)
    out = R.descriptives(x, ["feature", "l_returnflag", "l_linestatus"], "l_suppkey")
    return out.select("feature", "l_returnflag", "l_linestatus", "n", "n_subjects", *(r4(c).alias(c) for c in ("mean", "sd", "median", "iqr")), "least", "most")


@query(
    """SELECT c_mktsegment, o_orderstatus, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY GROUPING SETS ((c_mktsegment), (c_mktsegment, o_orderstatus), (c_mktsegment, o_orderstatus, o_orderpriority))"""
)
def counts_grouping_sets(spark, d):
    """Three levels of counts in one pass."""
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = [F.col(k) for k in ("c_mktsegment", "o_orderstatus", "o_orderpriority")]
    return x.groupingSets([c[:1], c[:2], c], *c).agg(F.count("*").alias("n"))


@query(
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE x IS NULL) AS n_missing, count(x) AS n_present, round(coalesce(avg((x = 0)::INT::DOUBLE), 0), 4) AS zero_fraction, round(var_pop(x), 4) AS variance FROM (SELECT nullif({c}, {v}) AS x FROM lineitem)"
        for c, v in (("l_quantity", 7), ("l_discount", 0.05), ("l_tax", 0.02))
    )
)
def missingness_profile(spark, d):
    """Nulls, zeros and population variance of each column in one pass."""
    x = table(spark, d, "lineitem").select(*(F.nullif(F.col(c), F.lit(float(v))).alias(c) for c, v in (("l_quantity", 7), ("l_discount", 0.05), ("l_tax", 0.02))))
    out = R.profile(x, x.columns)
    return out.select("feature", "n_missing", "n_present", r4("zero_fraction").alias("zero_fraction"), r4("variance").alias("variance"))


@query("\nUNION ALL\n".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM lineitem" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]))
def corr_pairs(spark, d):
    """Pearson correlation of all feature pairs."""
    return R.correlations(table(spark, d, "lineitem"), FEATURES).select("a", "b", r4("r").alias("r"))


P_VALUE = "((o_orderkey * 7919) % 9973 + 1) / 9974.0::DOUBLE"


def _adjust_sql(factor: str) -> str:
    return f"""WITH p AS (SELECT o_orderkey, o_orderpriority, {P_VALUE} AS p FROM orders),
m AS (SELECT o_orderpriority AS o, count(*) AS m, list_sum(list_transform(range(1, count(*) + 1), lambda i: 1.0::DOUBLE / i)) AS h FROM p GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY p) + count(*) OVER (PARTITION BY o_orderpriority, p) - 1 AS k FROM p JOIN m ON o_orderpriority = o)
SELECT o_orderkey, o_orderpriority, round(least(1.0, min(p * m / k * {factor}) OVER (PARTITION BY o_orderpriority ORDER BY k DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS adjusted FROM r"""


def _adjust(spark, d, method):
    x = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (((F.col("o_orderkey") * 7919) % 9973 + 1) / F.lit(9974.0)).alias("p"))
    return T.adjusted(x, "p", ["o_orderpriority"], method).select("o_orderkey", "o_orderpriority", r4("adjusted").alias("adjusted"))


@query(_adjust_sql("1.0"))
def bh_adjust(spark, d):
    """Benjamini-Hochberg values within each family."""
    return _adjust(spark, d, "bh")


@query(_adjust_sql("h"))
def by_adjust(spark, d):
    """Benjamini-Yekutieli values within each family."""
    return _adjust(spark, d, "by")


MID = """WITH v AS (SELECT event_type, round(value, 0) AS value FROM events WHERE value IS NOT NULL),
m AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS mid FROM v)"""


@query(
    MID
    + """, g AS (SELECT event_type, sum(mid) AS r, count(*) AS g FROM m GROUP BY 1), t AS (SELECT sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM v GROUP BY value)),
s AS (SELECT sum(r * r / g) AS s, sum(g)::DOUBLE AS n, count(*) AS k FROM g)
SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)), 4) AS h, k - 1 AS df, n::BIGINT AS n FROM s, t"""
)
def kruskal_stat(spark, d):
    """Kruskal-Wallis statistic of event values by type, ties corrected."""
    x = table(spark, d, "events").where("value IS NOT NULL").select("event_type", F.round("value", 0).alias("value"), F.lit(0).alias("all"))
    return T.kruskal(x, ["all"], "value", "event_type").select(r4("h").alias("h"), "df", "n")


@query(
    """WITH v AS (SELECT event_type AS g, round(value, 0) AS value FROM events WHERE value IS NOT NULL),
b AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM v) a JOIN (SELECT DISTINCT g FROM v) b ON a.g < b.g),
m AS (SELECT a, b, g, rank() OVER (PARTITION BY a, b ORDER BY value) + (count(*) OVER (PARTITION BY a, b, value) - 1) / 2.0::DOUBLE AS mid FROM b JOIN v ON g = a OR g = b)
SELECT a, b, round(sum(mid) - count(*) * (count(*) + 1) / 2.0::DOUBLE, 4) AS u, count(*) AS n_a FROM m WHERE g = a GROUP BY a, b"""
)
def ranksum_stat(spark, d):
    """Rank-sum statistic of all pairs of event types."""
    x = table(spark, d, "events").where("value IS NOT NULL").select("event_type", F.round("value", 0).alias("value"))
    return T.rank_sums(x, "value", "event_type").select("a", "b", r4("u").alias("u"), "n_a")


@query(
    """WITH s AS (SELECT user_id, value AS v, value - lag(value) OVER w AS d, CASE WHEN value <> 0 THEN lag(value) OVER w / value END AS ratio,
  CASE WHEN count(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS ma,
  CASE WHEN count(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3 THEN avg(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS m3
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n, round(avg(abs(d)), 6) AS mean_jitter, round(100 * avg(abs(d)) / nullif(avg(abs(v)), 0), 6) AS jitter_percent,
  round(20 * avg(abs(CASE WHEN ratio > 0 THEN log10(ratio) END)), 6) AS shimmer_db, round(100 * avg(abs(d / nullif(v, 0))), 6) AS perturbation_factor,
  round(100 * avg(abs(1 - v / nullif(ma, 0))), 6) AS perturbation_quotient, round(sum(abs(m3 - v)) / nullif(sum(v), 0), 6) AS rap,
  round(1000 * var_pop(v) / nullif(avg(v) ** 2, 0), 6) AS variability_index
FROM s GROUP BY user_id"""
)
def perturbation_family(spark, d):
    """Jitter, shimmer, quotients and indices of each user's values in time order."""
    out = T.perturbation(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("user_id", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query(
    """SELECT event_id, round(avg(value) OVER w, 4) AS truncated, round(sum(value) OVER w / 5, 4) AS padded FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
)
def moving_means(spark, d):
    """Edge-truncated and zero-padded five-point means."""
    return T.moving(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", r4("truncated").alias("truncated"), r4("padded").alias("padded"))


SPECTRUM = "list_transform(embedding, lambda x: abs(x::DOUBLE))"


@query(
    f"""WITH s AS (SELECT vec_id, {SPECTRUM} AS s, range(0, len(embedding)) AS i FROM embeddings),
c AS (SELECT *, list_sum(list_transform(list_zip(s, i), lambda p: p[1] * p[2])) / list_sum(s) AS c, list_sum(list_transform(s, lambda x: x * x)) AS e FROM s)
SELECT vec_id, round(c, 4) AS centroid, round(sqrt(list_sum(list_transform(list_zip(s, i), lambda p: p[1] * (p[2] - c) ** 2)) / list_sum(s)), 4) AS bandwidth,
  round(exp(list_avg(list_transform(s, lambda x: ln(greatest(x * x, 1e-10))))) / list_avg(list_transform(s, lambda x: greatest(x * x, 1e-10))), 4) AS flatness,
  round(-list_sum(list_transform(s, lambda x: CASE WHEN x > 0 THEN x * x / e * log2(x * x / e) ELSE 0 END)) / log2(len(s)), 4) AS entropy FROM c"""
)
def spectral_shape(spark, d):
    """Centroid, bandwidth, flatness and entropy of each vector taken as a spectrum."""
    x = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("s"))
    s = F.col("s")
    return x.select("vec_id", *(r4(f(s)).alias(n) for n, f in (("centroid", S.centroid), ("bandwidth", S.bandwidth), ("flatness", S.flatness), ("entropy", S.spectral_entropy))))


@query(
    f"""WITH b AS (SELECT vec_id, unnest({SPECTRUM}) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
c AS (SELECT *, sum(v) OVER (PARTITION BY vec_id ORDER BY i) AS cum, sum(v) OVER (PARTITION BY vec_id) AS total FROM b)
SELECT vec_id, min(i) FILTER (WHERE cum >= 0.85 * total) AS rolloff, min(i) FILTER (WHERE cum >= 0.15 * total) AS rollon FROM c GROUP BY vec_id"""
)
def rolloff_rollon(spark, d):
    """First bins at which the cumulated value reaches a share of the total."""
    b = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.abs(F.col("v").cast("double")).alias("v"))
    w = Window.partitionBy("vec_id")
    c = b.withColumn("cum", F.sum("v").over(w.orderBy("i"))).withColumn("total", F.sum("v").over(w))
    return c.groupBy("vec_id").agg(F.min(F.when(F.col("cum") >= 0.85 * F.col("total"), F.col("i"))).alias("rolloff"), F.min(F.when(F.col("cum") >= 0.15 * F.col("total"), F.col("i"))).alias("rollon"))


@query(
    """WITH f AS (SELECT vec_id, unnest(range(0, len(embedding) - 15, 8)) AS begin, embedding FROM embeddings WHERE len(embedding) >= 16)
SELECT vec_id, begin // 8 AS frame, round(sqrt(list_avg(list_transform(embedding[begin + 1:begin + 16], lambda x: x::DOUBLE * x::DOUBLE))), 4) AS rms FROM f"""
)
def frame_hop(spark, d):
    """Overlapping frames of each vector with their root mean square."""
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode(S.frames(F.col("embedding").cast("array<double>"), 16, 8)).alias("frame", "x"))
    return x.select("vec_id", F.col("frame").cast("long").alias("frame"), r4(F.sqrt(S.dot(F.col("x"), F.col("x")) / F.size("x"))).alias("rms"))


@query(
    """WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, lag(list_transform(embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
SELECT vec_id, round(list_inner_product(e, p) / sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(p, p)), 4) AS similarity FROM x WHERE p IS NOT NULL"""
)
def cosine_consecutive(spark, d):
    """Cosine of each vector with the one before it under its label."""
    x = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    return T.previous(x, ["label"], "vec_id").select("vec_id", r4(S.cosine(F.col("e"), F.col("e_before"))).alias("similarity"))


@query(
    """SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / nullif(stddev_pop(l_quantity) OVER w, 0), 4) AS z,
  round((l_quantity - min(l_quantity) OVER w) / nullif(max(l_quantity) OVER w - min(l_quantity) OVER w, 0), 4) AS minmax, round(l_quantity / nullif(max(abs(l_quantity)) OVER w, 0), 4) AS maxabs
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)"""
)
def scaled_in_group(spark, d):
    """Standard, min-max and max-abs scaling within each cell: statistics are aggregated first and joined back, so no cell meets in one task."""
    x, q = table(spark, d, "lineitem"), F.col("l_quantity")
    cell = ["l_returnflag", "l_linestatus"]
    stats = x.groupBy(*cell).agg(F.avg(q).alias("m"), F.stddev_pop(q).alias("s"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.max(F.abs(q)).alias("big"))
    x = x.join(F.broadcast(stats), cell)  # a row for each flag and status
    return x.select("l_orderkey", "l_linenumber", r4(F.try_divide(q - F.col("m"), F.col("s"))).alias("z"), r4(F.try_divide(q - F.col("lo"), F.col("hi") - F.col("lo"))).alias("minmax"), r4(F.try_divide(q, F.col("big"))).alias("maxabs"))


MIX = "(o_orderkey * 48271) % 65537"


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY {MIX}, o_orderkey) AS k FROM orders) WHERE k <= 2")
def cap_per_cell(spark, d):
    """At most two orders of each customer and status."""
    return R.cap_per_cell(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], [F.expr(MIX), F.col("o_orderkey")], 2).select("o_orderkey")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {MIX}, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE k <= round(0.7::DOUBLE * n)")
def stratified_sample(spark, d):
    """Seven tenths of each status."""
    return R.stratified(table(spark, d, "orders").withColumn("mix", F.expr(MIX)), "o_orderstatus", "mix", ["o_orderkey"], 0.7).select("o_orderkey")


BY_YEAR = "SELECT l_partkey, sum(l_discount::DECIMAL(18,2))::DOUBLE / count(*) AS {n} FROM lineitem WHERE year(l_shipdate) = {y} GROUP BY 1"


@query(
    f"""WITH c AS (SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, round(coalesce(early, 0), 6) AS early, round(coalesce(late, 0), 6) AS late
FROM ({BY_YEAR.format(n="early", y=1994)}) a FULL JOIN ({BY_YEAR.format(n="late", y=1996)}) b ON a.l_partkey = b.l_partkey),
s AS (SELECT *, CASE WHEN abs(early * 10) < 0.2 THEN 'Negligible' WHEN abs(early * 10) < 0.5 THEN 'Small' WHEN abs(early * 10) < 0.8 THEN 'Medium' ELSE 'Large' END AS e,
  CASE WHEN abs(late * 10) < 0.2 THEN 'Negligible' WHEN abs(late * 10) < 0.5 THEN 'Small' WHEN abs(late * 10) < 0.8 THEN 'Medium' ELSE 'Large' END AS l FROM c)
SELECT l_partkey, early, late, e AS early_size, l AS late_size, CASE WHEN early < 0.001 THEN '***' WHEN early < 0.01 THEN '**' WHEN early < 0.05 THEN '*' ELSE '' END AS stars,
  CASE WHEN e = 'Large' AND l IN ('Negligible', 'Small') THEN 'Temporary' WHEN e = 'Large' AND l = 'Large' THEN 'Permanent' ELSE 'Other' END AS class FROM s"""
)
def decision_rules(spark, d):
    """Two summaries compared by a full outer join, then labelled by ordered rules."""
    x = table(spark, d, "lineitem")
    of = lambda y, n: x.where(F.year("l_shipdate") == y).groupBy("l_partkey").agg((F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / F.count("*")).alias(n))
    c = R.compare_outer(of(1994, "early"), of(1996, "late"), "l_partkey", "early", "late").withColumns({k: F.round(k, 6) for k in ("early", "late")})
    c = c.withColumn("early_size", R.effect_size(F.col("early") * 10)).withColumn("late_size", R.effect_size(F.col("late") * 10))
    return c.select("l_partkey", "early", "late", "early_size", "late_size", R.stars(F.col("early")).alias("stars"), R.permanence(F.col("early_size"), F.col("late_size")).alias("class"))


@query(
    """SELECT o_custkey, max((s = 'F')::INT) AS in_f, max((s = 'O')::INT) AS in_o, max((s = 'P')::INT) AS in_p FROM (SELECT o_custkey, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')) GROUP BY 1"""
)
def set_union_flags(spark, d):
    """Union of three key sets with membership flags."""
    x = table(spark, d, "orders")
    return R.membership({s.lower(): x.where(F.col("o_orderstatus") == s) for s in "FOP"}, "o_custkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_intersect_only(spark, d):
    """Keys in two sets and not in the third."""
    x = table(spark, d, "orders")
    of = lambda s: x.where(F.col("o_orderstatus") == s).select("o_custkey")
    return of("F").intersect(of("O")).join(of("P"), "o_custkey", "left_anti")


@query(
    "SELECT l_suppkey, "
    + ", ".join(f"round(avg(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 4) AS mean_{f}" for f in "ANR")
    + " FROM lineitem GROUP BY l_suppkey"
)
def pivot_means(spark, d):
    """Mean of each supplier and flag, wide."""
    p = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return p.select("l_suppkey", *(r4(f).alias(f"mean_{f}") for f in "ANR"))


@query(
    """WITH u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, w::INT AS week FROM u, range(0, 28) t(w)),
n AS (SELECT user_id, (epoch(ts)::BIGINT // 604800 % 28)::INT AS week, count(*) AS n FROM events GROUP BY 1, 2)
SELECT g.user_id, g.week, coalesce(n, 0) AS n FROM g LEFT JOIN n ON g.user_id = n.user_id AND g.week = n.week"""
)
def subject_week_grid(spark, d):
    """Every user and week number, with the events there."""
    x = table(spark, d, "events").withColumn("week", S.week_number("ts", 28))
    return R.grid(x, x, "user_id", "week", 28)


@query(
    """WITH s AS (SELECT user_id, min(epoch(ts)) AS a, min(epoch(ts)) + 86400.0 * 3 AS b FROM events GROUP BY 1)
SELECT e.event_id, round(epoch(e.ts) - a, 4) AS since FROM events e JOIN s ON e.user_id = s.user_id AND epoch(e.ts) BETWEEN a AND b"""
)
def range_join_spans(spark, d):
    """Events inside each user's first three days."""
    x = table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    s = x.groupBy("user_id").agg(F.min("t").alias("a"), (F.min("t") + 86400.0 * 3).alias("b"))
    return R.range_join(x, s, ["user_id"], F.col("t"), "a", "b", 86400.0).select("event_id", r4(F.col("t") - F.col("a")).alias("since"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def latest_version(spark, d):
    """The newest event of each user and type."""
    return R.latest(table(spark, d, "events"), ["user_id", "event_type"], F.col("ts"), "event_id")


@query(
    r"""SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)(/[^?#]*)?', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)(/[^?#]*)?', 2) AS host, lower(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g')) AS safe FROM pages"""
)
def path_parts(spark, d):
    """Parts of a path by pattern, and a safe name."""
    parts = r"^(https?)://([^/]+)(/[^?#]*)?"
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", parts, 1).alias("scheme"), F.regexp_extract("url", parts, 2).alias("host"), F.lower(F.regexp_replace("url", "[^A-Za-z0-9_]", "_")).alias("safe"))


@query(
    """SELECT o_custkey, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-06-17') AS n_pre, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-06-17') AS n_post,
  round(coalesce(sum(CASE WHEN o_orderdate >= TIMESTAMP '1995-06-17' THEN o_totalprice::DECIMAL(18,2) END), 0)::DOUBLE / 3600, 6) AS post_total, mode(o_orderpriority ORDER BY o_orderpriority) AS most, count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY 1"""
)
def prepost_conditional(spark, d):
    """Conditional counts and sums, the least mode, and distinct counts by group."""
    post = F.col("o_orderdate") >= F.lit("1995-06-17").cast("timestamp")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(~post).alias("n_pre"), F.count_if(post).alias("n_post"), F.round(F.coalesce(F.sum(F.when(post, F.col("o_totalprice").cast("decimal(18,2)"))), F.lit(0)).cast("double") / 3600, 6).alias("post_total"), F.mode("o_orderpriority", True).alias("most"), F.countDistinct("o_orderstatus").alias("n_status"))


@query(
    """WITH x AS (SELECT user_id, epoch(ts) / 86400.0 - 18000 AS t, value FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*) AS n, round(regr_slope(value, t), 4) AS slope, round(sqrt(greatest(var_pop(value) - covar_pop(t, value) ** 2 / nullif(var_pop(t), 0), 0)), 2) AS rmse FROM x GROUP BY 1 HAVING count(*) >= 3"""
)
def least_squares_fit(spark, d):
    """Trend of each user's values in days."""
    x = table(spark, d, "events").where("value IS NOT NULL").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6 - 18000)
    n = x.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3")
    return T.line_fit(x, "user_id", F.col("t"), F.col("value")).join(n, "user_id").select("user_id", "n", r4("slope").alias("slope"), F.round("rmse", 2).alias("rmse"))


@query(
    """WITH x AS (SELECT user_id, value AS a, lead(value) OVER w AS b, lead(value, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id, (a <= b)::INT * 4 + (b <= c)::INT * 2 + (a <= c)::INT AS k, count(*) AS n FROM x WHERE c IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS q FROM p)
SELECT user_id, round(-sum(q * log2(q)), 4) AS entropy FROM t GROUP BY 1"""
)
def permutation_entropy(spark, d):
    """Entropy of the order patterns of three successive values."""
    w = T.in_order("user_id", "ts", "event_id")
    x = table(spark, d, "events").select("user_id", F.col("value").alias("a"), F.lead("value").over(w).alias("b"), F.lead("value", 2).over(w).alias("c")).where("c IS NOT NULL")
    p = x.groupBy("user_id", F.expr("int(a <= b) * 4 + int(b <= c) * 2 + int(a <= c)").alias("k")).agg(F.count("*").alias("n"))
    q = F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))
    return p.withColumn("q", q).groupBy("user_id").agg(r4(-F.sum(F.col("q") * F.log2("q"))).alias("entropy"))
