"""Registered rank tests and what box plots show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import statistics as T
from ..sources.shared import checkpointed
from .catalogue import query, r4, table

CELL = ["feature", "l_returnflag", "l_linestatus"]


def cells(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    return R.unpivot_long(x, CELL[1:], ["l_quantity", "l_extendedprice"])


def rounded(spark, d, *keys):
    return table(spark, d, "events").where("value IS NOT NULL").select(*keys, "event_type", F.round("value", 0).alias("value"))


LONG = """SELECT 'l_quantity' AS feature, l_returnflag, l_linestatus, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_returnflag, l_linestatus, l_extendedprice FROM lineitem"""


@query(
    f"""WITH x AS ({LONG}), q AS (SELECT feature, l_returnflag, l_linestatus, count(v) AS n, quantile_cont(v, 0.25::DOUBLE) AS q1, quantile_cont(v, 0.5::DOUBLE) AS median, quantile_cont(v, 0.75::DOUBLE) AS q3 FROM x GROUP BY ALL)
SELECT feature, l_returnflag, l_linestatus, any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
  min(v) FILTER (v >= q1 - 1.5::DOUBLE * (q3 - q1)) AS whisker_low, max(v) FILTER (v <= q3 + 1.5::DOUBLE * (q3 - q1)) AS whisker_high,
  count(*) FILTER (v < q1 - 1.5::DOUBLE * (q3 - q1) OR v > q3 + 1.5::DOUBLE * (q3 - q1)) AS n_outliers
FROM x JOIN q USING (feature, l_returnflag, l_linestatus) GROUP BY feature, l_returnflag, l_linestatus"""
)
def box_stats(spark, d):
    """Box-plot figures of two features in each cell."""
    return T.box_stats(cells(spark, d), CELL, "value").select(*CELL, "n", *(r4(c).alias(c) for c in ("q1", "median", "q3")), "whisker_low", "whisker_high", "n_outliers")


@query(
    """WITH v AS (SELECT day(ts)::INT AS day, event_type, round(value, 0) AS value FROM events WHERE value IS NOT NULL),
m AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY value) + (count(*) OVER (PARTITION BY day, value) - 1) / 2.0::DOUBLE AS mid FROM v),
g AS (SELECT day, event_type, sum(mid) AS r, count(*) AS g FROM m GROUP BY ALL), t AS (SELECT day, sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT day, count(*) AS c FROM v GROUP BY day, value) GROUP BY day),
s AS (SELECT day, sum(r * r / g) AS s, sum(g)::DOUBLE AS n, count(*) AS k FROM g GROUP BY day),
h AS (SELECT day, k - 1 AS df, n, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM s JOIN t USING (day)),
p AS (SELECT *, exp(-h / 2) * (1 + h / 2) AS p FROM h WHERE df = 4), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS i, count(*) OVER () AS m FROM p)
SELECT day, round(h, 4) AS h, round(p, 4) AS p, round(least(1, min(p * m / i) OVER (ORDER BY i DESC)), 4) AS p_adjusted FROM r"""
)
def kruskal_tests(spark, d):
    """Kruskal-Wallis tests of event values by type on each day of the month that has all five types, adjusted over the days."""
    out = T.kruskal(rounded(spark, d, F.dayofmonth("ts").alias("day")), ["day"], "value", "event_type").where("df = 4").drop("n", "df").withColumn("all", F.lit(0))
    return T.adjusted(checkpointed(out), "p", ["all"]).select("day", r4("h").alias("h"), r4("p").alias("p"), r4("adjusted").alias("p_adjusted"))


#: The error function's power series: terms up to 90 give the tail to nine places below 5.6 standard deviations.
SERIES = "1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(greatest(x, 1e-300)) - lgamma(k + 1)) / (2 * k + 1)))"


@query(
    f"""WITH v AS (SELECT event_type AS g, round(value, 0) AS value FROM events WHERE value IS NOT NULL),
b AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM v) a JOIN (SELECT DISTINCT g FROM v) b ON a.g < b.g),
m AS (SELECT a, b, g, value, rank() OVER (PARTITION BY a, b ORDER BY value) + (count(*) OVER (PARTITION BY a, b, value) - 1) / 2.0::DOUBLE AS mid FROM b JOIN v ON g = a OR g = b),
t AS (SELECT a, b, sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT a, b, count(*) AS c FROM m GROUP BY a, b, value) GROUP BY a, b),
u AS (SELECT a, b, sum(mid) FILTER (g = a) - (count(*) FILTER (g = a)) * (count(*) FILTER (g = a) + 1) / 2.0::DOUBLE AS u, (count(*) FILTER (g = a))::DOUBLE AS x, (count(*) FILTER (g = b))::DOUBLE AS y FROM m GROUP BY a, b),
z AS (SELECT a, b, u, x AS n_a, y AS n_b, greatest(abs(u - x * y / 2) - 0.5, 0) / sqrt(x * y / 12 * (x + y + 1 - ties / ((x + y) * (x + y - 1)))) / sqrt(2) AS x FROM u JOIN t USING (a, b))
SELECT a, b, u, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, round(CASE WHEN x > 4 THEN 0 ELSE {SERIES} END, 4) AS p FROM z"""
)
def ranksum_tests(spark, d):
    """Rank-sum tests of all pairs of event types, by the normal tail with continuity and tie corrections."""
    return T.rank_sums(rounded(spark, d), "value", "event_type").select("a", "b", "u", "n_a", "n_b", r4("p").alias("p"))
