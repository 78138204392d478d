"""More registered queries: transforms of spectra, time aggregates, scaling, resampling, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators import statistics as T
from .catalogue import SPECTRUM, query, r4, table

N = 64  # length of the vectors


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def spectra(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("s"))


@query(
    f"""WITH t AS (SELECT k, i, 2 * pi() * (k * i % {N}) / {N} AS a FROM range(0, {N // 2 + 1}) x(k), range(0, {N}) y(i)),
e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT vec_id, k AS bin, round(sqrt(sum(v * cos(a)) ** 2 + sum(v * sin(a)) ** 2), 4) AS magnitude FROM e JOIN t USING (i) GROUP BY vec_id, k"""
)
def dft_magnitude(spark, d):
    """Fourier magnitudes of each vector."""
    x = vectors(spark, d).select("vec_id", F.posexplode(S.dft_magnitude(F.col("e"), N)).alias("bin", "m"))
    return x.select("vec_id", F.col("bin").cast("long").alias("bin"), r4("m").alias("magnitude"))


@query(
    f"""WITH t AS (SELECT k, i, sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / {N}.0::DOUBLE) * cos(pi() * k * (2 * i + 1) / {2 * N}) AS a FROM range(0, 13) x(k), range(0, {N}) y(i)),
e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT vec_id, k AS coefficient, round(sum(v * a), 4) AS value FROM e JOIN t USING (i) GROUP BY vec_id, k"""
)
def dct_coefficients(spark, d):
    """The first thirteen cosine coefficients of each vector."""
    x = vectors(spark, d).select("vec_id", F.posexplode(S.dct(F.col("e"), N, 13)).alias("k", "v"))
    return x.select("vec_id", F.col("k").cast("long").alias("coefficient"), r4("v").alias("value"))


BANDS = S.octave_bins([float(i) for i in range(N)], 2.0, 4)


def _contrast_sql() -> str:
    db = lambda x: f"10 * log10(greatest(pow({x}, 2), 1e-12))"
    one = []
    for k, (first, n, counted) in enumerate(BANDS):
        few = max(1, round(0.1 * counted))
        band = f"list_sort(s[{first + 1}:{first + n}])"
        one.append(f"SELECT vec_id, {k}::BIGINT AS band, round({db(f'list_avg({band}[{n - few + 1}:{n}])')} - {db(f'list_avg({band}[1:{few}])')}, 4) AS contrast FROM s")
    return f"WITH s AS (SELECT vec_id, {SPECTRUM} AS s FROM embeddings) " + " UNION ALL ".join(one)


@query(_contrast_sql())
def spectral_contrast(spark, d):
    """Contrast within octave bands of each vector taken as a spectrum."""
    x = spectra(spark, d).select("vec_id", F.posexplode(S.contrast(F.col("s"), BANDS, 0.1)).alias("band", "c"))
    return x.select("vec_id", F.col("band").cast("long").alias("band"), r4("c").alias("contrast"))


@query(
    f"""WITH s AS (SELECT vec_id, label, {SPECTRUM} AS s FROM embeddings), n AS (SELECT vec_id, label, list_transform(s, lambda x: x / list_sum(s)) AS s FROM s),
p AS (SELECT vec_id, s, lag(s) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM n)
SELECT vec_id, round(list_distance(s, p), 4) AS flux,
  round(sqrt(list_sum(list_transform(list_zip(s, p), lambda t: (10 * log10(greatest(t[1] * t[1], 1e-12)) - 10 * log10(greatest(t[2] * t[2], 1e-12))) ** 2))) / len(s), 4) AS distance
FROM p WHERE p IS NOT NULL"""
)
def spectral_change(spark, d):
    """Flux and log-spectral distance of each spectrum from the one before it under its label."""
    x = T.previous(spectra(spark, d), ["label"], "vec_id")
    s, p = F.col("s"), F.col("s_before")
    return x.select("vec_id", r4(S.flux(s, p)).alias("flux"), r4(S.log_spectral_distance(s, p)).alias("distance"))


@query(
    """WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS m, count(*) AS n, sum(v * v) AS q FROM e GROUP BY 1, 2)
SELECT label, max(n) AS n_cycles, round(10 * log10(max(n) * sum(m * m) / sum(q - n * m * m)), 4) AS hnr FROM m GROUP BY label"""
)
def mean_cycle_hnr(spark, d):
    """Harmonics-to-noise ratio of each label's vectors about their mean cycle, from moments: no row meets its mean again."""
    e = vectors(spark, d).select("label", F.posexplode("e").alias("i", "v"))
    m = e.groupBy("label", "i").agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.var_pop("v").alias("s"))
    ratio = F.max("n") * F.sum(F.col("m") * F.col("m")) / F.sum(F.col("n") * F.col("s"))
    return m.groupBy("label").agg(F.max("n").alias("n_cycles"), r4(10 * F.log10(ratio)).alias("hnr"))


@query(
    """WITH x AS (SELECT event_type, value, epoch(ts) / 86400.0 - 18000 AS t FROM events WHERE value IS NOT NULL),
c AS (SELECT event_type AS g, avg(value) AS m, median(value) AS md FROM x GROUP BY 1)
SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, round(avg((value - m) ** 3) / pow(avg((value - m) ** 2), 1.5), 4) AS skew, round(kurtosis_pop(value), 4) AS kurt,
  round(avg(abs(value - m)), 4) AS mean_abs_dev, round(median(abs(value - md)), 4) AS median_abs_dev, round(any_value(md), 4) AS median, round(quantile_cont(value, 0.25::DOUBLE), 4) AS q1,
  round(quantile_cont(value, 0.75::DOUBLE), 4) AS q3, round(quantile_cont(value, 0.75::DOUBLE) - quantile_cont(value, 0.25::DOUBLE), 4) AS iqr, max(value) AS most, min(value) AS least, round(max(value) - min(value), 4) AS span,
  round(regr_slope(value, t), 4) AS slope, round(sqrt(var_pop(value) * (1 - corr(value, t) ** 2)), 4) AS rmse
FROM x JOIN c ON event_type = g GROUP BY event_type"""
)
def time_aggregates(spark, d):
    """Fifteen statistics of each type's values over time."""
    x = table(spark, d, "events").where("value IS NOT NULL").select("event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6 - 18000).alias("t"))
    out = T.time_aggregate(x, ["event_type"], "value", "t")
    return out.select("event_type", *(c if c in ("most", "least") else r4(c).alias(c) for c in out.columns[1:]))


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 7) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce(q, avg(q) OVER ()), 4) AS imputed FROM x"""
)
def mean_impute(spark, d):
    """Missing values take the mean of those present."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("q"))
    return R.imputed(x, ["q"]).select("l_orderkey", "l_linenumber", r4("q").alias("imputed"))


@query(
    """WITH x AS (SELECT p_partkey, p_type, p_size, p_retailprice FROM part)
SELECT p_type, count(*) AS n, round(sum(p_retailprice), 2) AS total, round(avg(p_retailprice), 2) AS mean, count(DISTINCT p_size) AS n_sizes, floor(sum(p_size) / 3600)::BIGINT || ':' || lpad((sum(p_size) % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((sum(p_size) % 60)::VARCHAR, 2, '0') AS clock
FROM x GROUP BY 1"""
)
def group_summary(spark, d):
    """Counts, totals and means of each group, with a total written as a clock time."""
    g = table(spark, d, "part").groupBy("p_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"), F.round(F.avg("p_retailprice"), 2).alias("mean"), F.countDistinct("p_size").alias("n_sizes"), S.clock(F.sum("p_size")).alias("clock"))


@query(
    "WITH w AS (SELECT l_suppkey, "
    + ", ".join(f"coalesce(sum(l_discount::DECIMAL(18,2)) FILTER (WHERE l_returnflag = '{f}')::DOUBLE / count(*) FILTER (WHERE l_returnflag = '{f}'), 0) * 10 AS {f}" for f in "ANR")
    + " FROM lineitem GROUP BY 1) SELECT l_suppkey, CASE WHEN (A >= 0.5)::INT + (N >= 0.5)::INT + (R >= 0.5)::INT >= 2 THEN 'High' WHEN (A >= 0.45)::INT + (N >= 0.45)::INT + (R >= 0.45)::INT >= 2 THEN 'Moderate' ELSE 'Low' END AS consistency FROM w"
)
def consistency_labels(spark, d):
    """A label from how many of three columns pass each of two thresholds; thresholds are parameters."""
    mean = F.try_divide(F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double"), F.count(F.lit(1)))
    x = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(mean)
    scores = [F.coalesce(F.col(c), F.lit(0.0)) * 10 for c in "ANR"]
    return x.select("l_suppkey", R.consistency(scores, 0.5, 0.45).alias("consistency"))


@query(
    """WITH RECURSIVE t AS (SELECT n_nationkey AS key, n_name AS name, n_regionkey AS parent FROM nation),
w AS (SELECT key, name, 0 AS depth FROM t WHERE parent = 0 UNION ALL SELECT t.key, t.name, w.depth + 1 FROM t JOIN w ON t.parent = w.key AND t.key > w.key WHERE w.depth < 3)
SELECT key, name, min(depth)::INT AS depth FROM w GROUP BY ALL"""
)
def folder_walk(spark, d):
    """Nodes reachable from a root in at most three steps, level by level."""
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    return R.walk(t, F.col("parent") == 0, 3)


@query(
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IS NOT NULL)"
)
def pending_keys(spark, d):
    """Keys that no written row has: what an interrupted run still has to do."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.pending(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query(
    """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), g AS (SELECT vec_id, unnest(e) AS v, unnest(range(0, len(e))) AS i FROM m),
r AS (SELECT a.vec_id, b.i - a.i AS lag, sum(a.v * b.v) AS r FROM g a JOIN g b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 0 AND 4 GROUP BY 1, 2)
SELECT vec_id, lag, round(r, 4) AS r FROM r"""
)
def autocorrelation(spark, d):
    """Products of each vector with itself at lags 0 to 4."""
    x = vectors(spark, d).select("vec_id", F.posexplode(S.autocorrelation(F.col("e"), 4)).alias("lag", "r"))
    return x.select("vec_id", F.col("lag").cast("long").alias("lag"), r4("r").alias("r"))


def _near(m: int) -> str:
    return " AND ".join(f"abs(e[i + {k}] - e[j + {k}]) <= r" for k in range(1, m + 1))


@query(
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), e AS (SELECT *, 0.2::DOUBLE * sqrt(list_sum(list_transform(e, lambda x: (x - list_sum(e) / len(e)) ** 2)) / len(e)) AS r FROM v),
p AS (SELECT vec_id, count(*) FILTER ({_near(2)}) AS b, count(*) FILTER ({_near(3)}) AS a FROM e, range(0, {N - 2}) x(i), range(0, {N - 2}) y(j) WHERE i < j GROUP BY 1)
SELECT vec_id, b AS n_near, a AS n_stay, round(CASE WHEN a > 0 THEN -ln(a / b::DOUBLE) END, 4) AS entropy FROM p"""
)
def sample_entropy(spark, d):
    """Sample entropy of each vector's components in order, within a fifth of their deviation."""
    x = vectors(spark, d).withColumn("r", 0.2 * S.deviation(F.col("e")))
    e, r, last = F.col("e"), F.col("r"), F.lit(N - 3)
    x = x.select("vec_id", S.near_pairs(e, 2, r, last).cast("long").alias("n_near"), S.near_pairs(e, 3, r, last).cast("long").alias("n_stay"))
    return x.withColumn("entropy", F.when(F.col("n_stay") > 0, r4(-F.log(F.col("n_stay") / F.col("n_near")))))
