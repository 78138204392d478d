"""Registered queries: recurrences, polynomials, densities, simulated residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits, recurrence
from .catalogue import query, r4, table


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w AS (SELECT event_id, user_id, k, value AS y FROM e WHERE k = 1 UNION ALL SELECT e.event_id, e.user_id, e.k, coalesce(8.0::DOUBLE / 9 * y + e.value / 9, y) FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT event_id, round(y, 4) AS smoothed FROM w"""
)
def smoothed_values(spark, d):
    """Each user's values under a first-order filter, in order; it begins at the first value."""
    x = table(spark, d, "events").select("event_id", "user_id", "value")
    out = recurrence.linear_scan(x, ["user_id"], ["event_id"], F.lit(8 / 9), F.col("value") / 9, first=F.col("value"))
    return out.select("event_id", r4("y").alias("smoothed"))


@query(
    """WITH x AS (SELECT event_type, value AS y, epoch_us(ts) / 86400e6::DOUBLE AS t FROM events WHERE value IS NOT NULL),
m AS (SELECT event_type AS g, avg(t) AS m, stddev_pop(t) AS s FROM x GROUP BY 1), z AS (SELECT event_type, y, (t - m) / s AS z FROM x JOIN m ON g = event_type),
a AS (SELECT event_type AS g, avg(y) AS y0, avg(z * y) AS c1, avg(z ** 3) AS a FROM z GROUP BY 1),
q AS (SELECT z.*, y0, c1, a, z * z - a * z - 1 AS p2 FROM z JOIN a ON g = event_type),
b AS (SELECT event_type AS g, avg(p2 * y) / avg(p2 * p2) AS c2, avg(z ** 3 * p2) / avg(p2 * p2) AS d, avg(z ** 4) AS e, avg(z ** 3) AS f FROM q GROUP BY 1),
r AS (SELECT q.*, c2, d, e, f, z ** 3 - d * p2 - e * z - f AS p3 FROM q JOIN b ON g = event_type),
c AS (SELECT event_type AS g, avg(p3 * y) / avg(p3 * p3) AS c3 FROM r GROUP BY 1),
s AS (SELECT r.*, c3 FROM r JOIN c ON g = event_type)
SELECT event_type, 1 AS degree, count(*) AS n, round(any_value(y0), 4) AS c0, round(any_value(c1), 4) AS c1, NULL::DOUBLE AS c2, NULL::DOUBLE AS c3, round(sqrt(avg((y - y0 - c1 * z) ** 2)), 4) AS rmse FROM s GROUP BY 1
UNION ALL SELECT event_type, 2, count(*), round(any_value(y0 - c2), 4), round(any_value(c1 - a * c2), 4), round(any_value(c2), 4), NULL, round(sqrt(avg((y - y0 - c1 * z - c2 * p2) ** 2)), 4) FROM s GROUP BY 1
UNION ALL SELECT event_type, 3, count(*), round(any_value(y0 - c2 + c3 * (d - f)), 4), round(any_value(c1 - a * c2 + c3 * (d * a - e)), 4), round(any_value(c2 - d * c3), 4), round(any_value(c3), 4), round(sqrt(avg((y - y0 - c1 * z - c2 * p2 - c3 * p3) ** 2)), 4) FROM s GROUP BY 1"""
)
def polynomial_fits(spark, d):
    """Polynomials of degrees 1 to 3 of each type's values over time, with their residual error; coefficients of scaled time."""
    x = table(spark, d, "events").select("event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6).alias("t"))
    out = fits.polynomials(x, ["event_type"], "t", "value", [1, 2, 3])
    return out.select("event_type", "degree", "n", *(r4(F.get("scaled", F.lit(k))).alias(f"c{k}") for k in range(4)), r4("rmse").alias("rmse"))


POINTS, FINER = 128, 8


@query(
    f"""WITH v AS (SELECT event_type, value FROM events WHERE value IS NOT NULL),
g AS (SELECT event_type AS g, count(*) AS n, min(value) AS low, (max(value) - min(value)) / {(POINTS - 1) * FINER} AS bin, stddev_samp(value) * pow(0.75 * count(*), -0.2) AS h FROM v GROUP BY 1),
p AS (SELECT g, h, bin, (value - low) / bin AS pos FROM v JOIN g ON g = event_type),
w AS (SELECT g, any_value(h) AS h, any_value(bin) AS bin, b, sum(w) AS w FROM (SELECT g, h, bin, floor(pos) AS b, 1 - (pos - floor(pos)) AS w FROM p UNION ALL SELECT g, h, bin, floor(pos) + 1, pos - floor(pos) FROM p) GROUP BY g, b),
f AS (SELECT g, point, sum(w * exp(-0.5 * ((point * {FINER} - b) * bin / h) ** 2)) AS f FROM w, range(0, {POINTS}) x(point) GROUP BY 1, 2),
s AS (SELECT g, f / sum(f) OVER (PARTITION BY g) AS p FROM f)
SELECT s.g AS event_type, any_value(n) AS n, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / log2({POINTS}), 4) AS entropy FROM s JOIN g ON s.g = g.g GROUP BY s.g"""
)
def value_entropy(spark, d):
    """Entropy of each type's values by a kernel density at 128 points."""
    return fits.density_entropy(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value", POINTS, FINER).select("event_type", "n", r4("entropy").alias("entropy"))


SIMULATED, SEED, SUBJECT_SD = 500, 1, 500.0


def _simulated_sql() -> str:
    mix = lambda name, source, x, keep: f"{name}1 AS (SELECT {keep}, xor(({x}) >> 16, {x}) * {fits.MIX} % {fits.WORD} AS x FROM {source}), {name}2 AS (SELECT {keep}, xor(x >> 16, x) * {fits.MIX} % {fits.WORD} AS x FROM {name}1), {name} AS (SELECT {keep}, xor(x >> 16, x) AS x FROM {name}2)"
    return f"""WITH n AS (SELECT DISTINCT c_custkey AS id FROM customer UNION SELECT c_nationkey FROM customer),
{mix("l", "n", f"id % {fits.WORD}", "id")}, {mix("u", "n", f"id // {fits.WORD} + 1", "id")},
k0 AS (SELECT l.id, (l.x + u.x * 3) % {fits.WORD} AS v FROM l JOIN u USING (id)), {mix("k", "k0", "v", "id")},
t0 AS (SELECT turn, draw, (turn * 8 + draw) * {fits.TURN} % {fits.WORD} AS v FROM range(0, {SIMULATED}) a(turn), range(0, 4) b(draw)), {mix("t", "t0", "v", "turn, draw")},
d0 AS (SELECT id, turn, draw, (k.x + t.x + {SEED * fits.ROW % fits.WORD}) % {fits.WORD} AS v FROM k JOIN t ON draw < 2 OR id < 25), {mix("d", "d0", "v", "id, turn, draw")},
r AS (SELECT id, turn, draw // 2 AS part, sqrt(-2 * ln(max((x + 0.5::DOUBLE) / {fits.WORD}) FILTER (WHERE draw % 2 = 0))) * cos(2 * pi() * max((x + 0.5::DOUBLE) / {fits.WORD}) FILTER (WHERE draw % 2 = 1)) AS e FROM d GROUP BY id, turn, draw // 2),
m AS (SELECT c_mktsegment AS s, avg(c_acctbal) AS m FROM customer GROUP BY 1), c AS (SELECT c_custkey, c_nationkey, c_acctbal - m AS gap, sqrt(avg((c_acctbal - m) ** 2) OVER ()) AS sd FROM customer JOIN m ON s = c_mktsegment)
SELECT c_custkey, round(avg((sd * a.e + {SUBJECT_SD} * b.e < gap)::INT::DOUBLE), 4) AS residual FROM c JOIN r a ON a.id = c_custkey AND a.part = 0 JOIN r b ON b.id = c_nationkey AND b.part = 1 AND b.turn = a.turn GROUP BY c_custkey"""


@query(_simulated_sql())
def simulated_residuals(spark, d):
    """The share of 500 simulated balances below each customer's, with segments as fixed and nations as random effects."""
    x = table(spark, d, "customer")
    means = x.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("fitted"))
    x = x.join(means, "c_mktsegment")
    sd = x.agg(F.sqrt(F.avg((F.col("c_acctbal") - F.col("fitted")) ** 2)).alias("sd"))  # one row
    out = fits.simulated_residuals(x.join(F.broadcast(sd)), "c_custkey", "c_acctbal", "fitted", F.col("sd"), "c_nationkey", F.lit(SUBJECT_SD), SIMULATED, SEED)
    return out.select("c_custkey", r4("residual").alias("residual"))
