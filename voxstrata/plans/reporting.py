"""Registered queries that clean names, check tables and lay out results: sets of rules, consensus, chains of joins, top rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..operators import statistics as T
from ..sources.shared import checkpointed
from .catalogue import SPECTRUM, query, r4, table
from .ranks import SERIES

FLAGS = ["A", "N", "R"]
SIZES = "CASE WHEN abs({0}) < 0.2 THEN 'Negligible' WHEN abs({0}) < 0.5 THEN 'Small' WHEN abs({0}) < 0.8 THEN 'Medium' ELSE 'Large' END"

PATH = "c_name || CASE c_custkey % 4 WHEN 0 THEN '/Week_' WHEN 1 THEN '/w' WHEN 2 THEN '/week - ' ELSE '/other ' END || (c_custkey % 28) || '/clip'"


@query(rf"""SELECT c_custkey, coalesce(nullif(regexp_extract(p, '[Ww]eek[\s_-]*(\d+)', 1), ''), nullif(regexp_extract(p, '[Ww](\d+)', 1), ''), '-1')::INT AS week FROM (SELECT c_custkey, {PATH} AS p FROM customer)""")
def week_from_path(spark, d):
    """Week numbers by the first of several patterns; -1 where none matches."""
    return table(spark, d, "customer").select("c_custkey", F.coalesce(S.week_of(F.expr(PATH)), F.lit(-1)).alias("week"))


FOLDER = "CASE s_suppkey % 3 WHEN 0 THEN 'P24-' || s_suppkey || ' & ' WHEN 1 THEN 'P24-1 and  24-3 ' ELSE '12 -' END || s_name || CASE s_suppkey % 2 WHEN 0 THEN '-done' ELSE ' ' END"


@query(
    rf"""SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '(?i)-DONE$', ''), '^P24-\d+[\s&]*', ''), '^and\s+\d+-\d+\s+', ''), '^\d+\s+', ''), '^-', '')) AS subject FROM (SELECT s_suppkey, {FOLDER} AS f FROM supplier)"""
)
def subject_names(spark, d):
    """Names without the markers and numbers around them, rule after rule."""
    return table(spark, d, "supplier").select("s_suppkey", S.subject_of(F.expr(FOLDER)).alias("subject"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE '?' END AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'Pre' WHEN '2-HIGH' THEN 'Early' WHEN '3-MEDIUM' THEN 'Late' END AS stage FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def stage_relabel(spark, d):
    """Codes with a default, and stages of which those without a label are dropped."""
    x = table(spark, d, "orders").withColumn("status", R.coded("o_orderstatus", {"F": "Filled", "O": "Open"}))
    stages = {"1-URGENT": "Pre", "2-HIGH": "Early", "3-MEDIUM": "Late", "5-LOW": None}
    return R.relabelled(x, "o_orderpriority", stages, "stage").select("o_orderkey", "status", "stage")


@query("SELECT c_custkey, coalesce(n_name, 'Unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON c_nationkey = n_nationkey")
def dimension_default(spark, d):
    """A dimension's value or a default."""
    names = table(spark, d, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("key"), "n_name")
    x = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    return R.with_dimension(x, names, "key", "n_name", "Unknown").select("c_custkey", "n_name")


RULES = {"quantity_positive": "l_quantity > 0", "discount_in_range": "l_discount BETWEEN 0 AND 0.05", "flag_known": "l_returnflag IN ('A', 'N')", "key_present": "l_orderkey IS NOT NULL"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS n_broken FROM lineitem" for k, c in RULES.items()))
def sanity_rules(spark, d):
    """Rows that break each rule, all rules in one pass."""
    return R.broken(table(spark, d, "lineitem"), {k: F.expr(c) for k, c in RULES.items()})


@query("SELECT DISTINCT o_orderpriority FROM orders EXCEPT SELECT * FROM (VALUES ('1-URGENT'), ('2-HIGH'))")
def unexpected_values(spark, d):
    """Values of a column that are not among those allowed."""
    allowed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "o_orderpriority string")
    return table(spark, d, "orders").select("o_orderpriority").distinct().subtract(allowed)


COLUMNS = {"l_quantity": "l_quantity", "l_rare": "CASE WHEN l_quantity > 30 THEN l_quantity END", "l_sparse": "CASE WHEN l_linenumber = 1 THEN l_tax ELSE 0 END", "l_fixed": "l_quantity * 0 + 3", "l_tax": "l_tax"}


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS feature, CASE WHEN '{k}' = 'l_tax' THEN 'named' WHEN count(*) FILTER (x IS NULL) / count(*)::DOUBLE > 0.5 THEN 'missing' WHEN coalesce(avg((x = 0)::INT), 0) > 0.5 THEN 'zero' WHEN coalesce(var_pop(x), 0) <= 1e-8 THEN 'constant' ELSE 'kept' END AS reason FROM (SELECT {c} AS x FROM lineitem)"
        for k, c in COLUMNS.items()
    )
)
def drop_reasons(spark, d):
    """Why a column is left out: named, mostly missing, mostly zero, nearly constant."""
    x = table(spark, d, "lineitem").select(*(F.expr(c).alias(k) for k, c in COLUMNS.items()))
    return R.drop_reasons(R.profile(x, x.columns), ["l_tax"])


FAMILIES = {"Metal": ["small", "red"], "Colour": ["blue", "green", "s"]}


@query(
    """WITH f AS (SELECT p_brand, CASE WHEN p_name LIKE 'small%' OR p_name LIKE 'red%' THEN 'Metal' WHEN p_name LIKE 'blue%' OR p_name LIKE 'green%' OR p_name LIKE 's%' THEN 'Colour' ELSE 'Other' END AS family FROM part)
SELECT p_brand, count(*) AS total, count(*) FILTER (family = 'Metal') AS n_metal, count(*) FILTER (family = 'Colour') AS n_colour, count(*) FILTER (family = 'Other') AS n_other FROM f GROUP BY 1"""
)
def family_counts(spark, d):
    """Families by ordered rules of prefixes, counted for each group, zeros included."""
    x = table(spark, d, "part").select("p_brand", S.by_prefix(F.col("p_name"), FAMILIES, "Other").alias("family"))
    return R.counted(x, ["p_brand"], "family", ["Metal", "Colour", "Other"])


CENTS = "sum(CASE WHEN year(l_shipdate) {0} 1996 THEN round(l_discount * 100)::BIGINT ELSE 0 END) / nullif(count(*) FILTER (year(l_shipdate) {0} 1996), 0)::DOUBLE / 5"
LABELS = f"""d AS (SELECT l_partkey, l_returnflag, {CENTS.format("<=")} AS early, {CENTS.format(">")} AS late FROM lineitem GROUP BY ALL),
c AS (SELECT *, {SIZES.format("early")} AS e, {SIZES.format("late")} AS l FROM d WHERE early IS NOT NULL AND late IS NOT NULL),
k AS (SELECT l_partkey, l_returnflag, early, CASE WHEN e = 'Large' AND l IN ('Negligible', 'Small') THEN 'Temporary' WHEN e = 'Large' AND l = 'Large' THEN 'Permanent' ELSE 'Other' END AS category FROM c)"""


def labelled(spark, d):
    """Each part's category under each flag, from the sizes of two shares; those with both."""
    x = table(spark, d, "lineitem").withColumn("cents", F.round(F.col("l_discount") * 100).cast("long"))
    early = F.year("l_shipdate") <= 1996
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("cents"))), F.count_if(c)) / 5
    g = x.groupBy("l_partkey", "l_returnflag").agg(mean(early).alias("early"), mean(~early).alias("late")).where("early IS NOT NULL AND late IS NOT NULL")
    return g.select("l_partkey", "l_returnflag", "early", R.permanence(R.effect_size(F.col("early")), R.effect_size(F.col("late"))).alias("category"))


@query(
    f"""WITH {LABELS}, w AS (SELECT l_partkey, {", ".join(f"coalesce(any_value(category) FILTER (l_returnflag = '{f}'), '-') AS category_{f}" for f in FLAGS)} FROM k GROUP BY 1)
SELECT l_partkey, category, string_agg(l_returnflag, ', ' ORDER BY l_returnflag) AS groups, count(*) AS n_groups, any_value(category_A) AS category_A, any_value(category_N) AS category_N, any_value(category_R) AS category_R
FROM k JOIN w USING (l_partkey) WHERE category IN ('Temporary', 'Permanent') GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def group_consensus(spark, d):
    """Parts that at least two groups put in the same category."""
    return R.consensus(labelled(spark, d), "l_partkey", "l_returnflag", "category", ["Temporary", "Permanent"], FLAGS)


@query(f"WITH {LABELS} SELECT l_returnflag, count(*) AS total, count(*) FILTER (category = 'Temporary') AS n_temporary, count(*) FILTER (category = 'Permanent') AS n_permanent, count(*) FILTER (category = 'Other') AS n_other FROM k GROUP BY 1")
def category_counts(spark, d):
    """Categories counted for each group."""
    return R.counted(labelled(spark, d), ["l_returnflag"], "category", ["Temporary", "Permanent", "Other"])


@query(f"WITH {LABELS} SELECT l_partkey, l_returnflag, category, round(early, 4) AS early FROM k ORDER BY category, abs(early) DESC NULLS LAST, l_partkey, l_returnflag LIMIT 50")
def top_by_category(spark, d):
    """The first fifty by category, size and name."""
    x = R.top(labelled(spark, d), 50, F.asc("category"), F.desc_nulls_last(F.abs("early")), F.asc("l_partkey"), F.asc("l_returnflag"))
    return x.withColumn("early", r4("early"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
def top_scores(spark, d):
    """The thirty highest scores, ties by key."""
    return R.top(table(spark, d, "customer").select("c_custkey", "c_acctbal"), 30, F.desc("c_acctbal"), F.asc("c_custkey"))


@query("SELECT p_partkey, p_brand, coalesce(nullif(regexp_extract(p_brand, '#(\\d+)', 1), '')::INT, 999) AS number FROM part ORDER BY number, p_partkey LIMIT 20")
def numeric_name_order(spark, d):
    """The first twenty by the number in a name; names without one come last."""
    number = F.coalesce(F.nullif(F.regexp_extract("p_brand", r"#(\d+)", 1), F.lit("")).cast("int"), F.lit(999))
    return R.top(table(spark, d, "part").select("p_partkey", "p_brand", number.alias("number")), 20, "number", "p_partkey")


@query("SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS place FROM orders ORDER BY place, o_totalprice DESC, o_orderkey LIMIT 40")
def factor_order(spark, d):
    """The first forty in a given order of levels."""
    place = F.array_position(F.array(*map(F.lit, "POF")), F.col("o_orderstatus")).cast("int")
    return R.top(table(spark, d, "orders").withColumn("place", place), 40, "place", F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderstatus", "place")


Z = 1.959963984540054


@query(
    f"""WITH m AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) - 1.0::DOUBLE AS f, avg(l_quantity) AS mean, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, {Z} + ({Z}**3 + {Z}) / (4 * f) + (5 * {Z}**5 + 16 * {Z}**3 + 3 * {Z}) / (96 * f**2) + (3 * {Z}**7 + 19 * {Z}**5 + 17 * {Z}**3 - 15 * {Z}) / (384 * f**3) AS t FROM m)
SELECT l_returnflag, l_linestatus, n, round(mean, 4) AS mean, round(se, 4) AS se, round(mean - t * se, 4) AS low, round(mean + t * se, 4) AS high FROM t"""
)
def cell_intervals(spark, d):
    """Standard errors and 95 % intervals by Student's t."""
    x = R.intervals(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return x.select("l_returnflag", "l_linestatus", "n", *(r4(c).alias(c) for c in ("mean", "se", "low", "high")))


@query(
    """SELECT count(*) AS n, count(value) AS n_valid, count(*) - count(value) AS n_invalid, round(100.0::DOUBLE * count(value) / count(*), 2) AS valid_percent, count(DISTINCT user_id) AS n_subjects,
  round(avg(value), 2) AS mean, round(median(value), 2) AS median, round(stddev_samp(value), 2) AS sd, printf('%.2f - %.2f', min(value), max(value)) AS range FROM (SELECT user_id, CASE WHEN value > 5 THEN value END AS value FROM events)"""
)
def overall_figures(spark, d):
    """One row on a whole table: counts, valid share (0 where it is empty), mean, exact median, range as text."""
    x = table(spark, d, "events").select(F.lit(1).alias("all"), "user_id", F.when(F.col("value") > 5, F.col("value")).alias("value"))
    n, valid = F.count("*"), F.count("value")
    one = x.agg(n.alias("n"), valid.alias("n_valid"), (n - valid).alias("n_invalid"), F.round(F.coalesce(F.try_divide(100.0 * valid, n), F.lit(0.0)), 2).alias("valid_percent"), F.round(F.avg("value"), 2).alias("mean"), F.round(F.stddev_samp("value"), 2).alias("sd"), F.format_string("%.2f - %.2f", F.min("value"), F.max("value")).alias("range"))
    subjects = x.select("user_id").distinct().agg(F.count("user_id").alias("n_subjects"))
    median = T.quantiles(x, ["all"], "value", {"median": 0.5}).select(F.round("median", 2).alias("median"))
    return one.join(F.broadcast(subjects)).join(F.broadcast(median), how="left")  # a row each


@query("""WITH p AS (SELECT DISTINCT o_orderpriority AS stage, o_custkey FROM orders WHERE o_custkey IS NOT NULL), t AS (SELECT count(DISTINCT o_custkey) AS n_all FROM p)
SELECT stage, count(*) AS n_subjects, any_value(n_all) AS n_all, count(*) < any_value(n_all) AS incomplete FROM p, t GROUP BY stage""")
def stage_balance(spark, d):
    """Subjects of each stage against all."""
    return R.unbalanced(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "stage"), "stage", "o_custkey")


@query(
    """WITH e AS (SELECT user_id, event_type, (epoch(ts)::BIGINT // 604800 % 28)::INT AS week FROM events), g AS (SELECT user_id, w::INT AS week FROM (SELECT DISTINCT user_id FROM e), range(0, 28) t(w)),
n AS (SELECT user_id, week, count(*) AS n FROM e WHERE event_type = 'click' GROUP BY 1, 2), r AS (SELECT DISTINCT user_id, week FROM e WHERE event_type <> 'click')
SELECT g.user_id, g.week, CASE WHEN r.week IS NULL THEN 'X' ELSE coalesce(n, 0)::VARCHAR END AS mark FROM g LEFT JOIN n ON g.user_id = n.user_id AND g.week = n.week LEFT JOIN r ON g.user_id = r.user_id AND g.week = r.week"""
)
def recorded_grid(spark, d):
    """Subjects by weeks: X where nothing was recorded, else how many were processed."""
    x = table(spark, d, "events").select("user_id", "event_type", S.week_number("ts", 28).alias("week"))
    cells = R.grid(x.where("event_type = 'click'"), x, "user_id", "week", 28)
    return R.marked_grid(cells, x.where("event_type <> 'click'"), ["user_id", "week"])


@query(
    """WITH s AS (SELECT l_suppkey, count(*) AS n_obs, count(DISTINCT l_partkey) AS n_subjects FROM lineitem GROUP BY 1), p AS (SELECT s_suppkey, (s_suppkey * 7919 % 997 + 1) / 998.0::DOUBLE AS p FROM supplier WHERE s_acctbal > 0),
a AS (SELECT s_suppkey, least(1, min(p * m / k) OVER (ORDER BY k DESC)) AS p_adjusted FROM (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM p)),
w AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'A') AS raw_mean_A, avg(l_quantity) FILTER (l_returnflag = 'R') AS raw_mean_R FROM lineitem GROUP BY 1), v AS (SELECT l_suppkey, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1)
SELECT s.l_suppkey, n_obs, n_subjects, round(p, 4) AS p, round(p_adjusted, 4) AS p_adjusted, round(raw_mean_A, 4) AS raw_mean_A, round(raw_mean_R, 4) AS raw_mean_R, printf('%.4f ± %.4f', round(m, 4), round(s, 4)) AS mean_sd
FROM s LEFT JOIN p ON s.l_suppkey = p.s_suppkey LEFT JOIN a ON s.l_suppkey = a.s_suppkey LEFT JOIN w ON s.l_suppkey = w.l_suppkey LEFT JOIN v ON s.l_suppkey = v.l_suppkey"""
)
def report_chain(spark, d):
    """Status, p values, adjusted p values and wide means of each feature, with means and deviations as text."""
    x, key = table(spark, d, "lineitem"), "l_suppkey"
    of = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    text = F.format_string("%.4f ± %.4f", r4(F.avg("l_quantity")), r4(F.stddev_samp("l_quantity")))
    means = x.groupBy(key).agg(F.count("*").alias("n_obs"), r4(of("A")).alias("raw_mean_A"), r4(of("R")).alias("raw_mean_R"), text.alias("mean_sd"))
    parts = x.select(key, "l_partkey").distinct().groupBy(key).agg(F.count("l_partkey").alias("n_subjects"))
    p = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias(key), ((F.col("s_suppkey") * 7919 % 997 + 1) / F.lit(998.0)).alias("p"), F.lit(0).alias("all"))
    p = T.adjusted(p, "p", ["all"]).select(key, r4("p").alias("p"), r4("adjusted").alias("p_adjusted"))
    return means.join(parts, key).join(p, key, "left")


SHARES = "CASE WHEN sum(round(l_discount * 100)::BIGINT) % 3 = 0 THEN 0 ELSE sum(round(l_discount * 100)::BIGINT)::DOUBLE END"


@query(
    f"""WITH c AS (SELECT l_partkey % 50 AS feature, l_orderkey % 40 AS replicate, l_returnflag AS label, {SHARES} AS v FROM lineitem GROUP BY 1, 2, 3),
o AS (SELECT feature, replicate, max((v > 0)::INT) AS taken, sum(v) AS s, count(*) AS n, {", ".join(f"max((v > 0)::INT) FILTER (label = '{f}') AS t_{f}" for f in FLAGS)} FROM c GROUP BY 1, 2)
SELECT feature, round(avg(taken), 4) AS share_any, {", ".join(f"round(avg(t_{f}), 4) AS share_{f}" for f in FLAGS)}, round(coalesce(sum(s) FILTER (taken = 1) / sum(n) FILTER (taken = 1), 0), 4) AS when_selected, round(sum(s) / sum(n), 4) AS mean_all FROM o GROUP BY 1"""
)
def selection_shares(spark, d):
    """Shares of replicates that select a feature, in any class and in each, and mean absolute coefficients."""
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("long"))
    x = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("feature"), (F.col("l_orderkey") % 40).alias("replicate"), F.col("l_returnflag").alias("label")).agg(F.when(cents % 3 == 0, 0.0).otherwise(cents.cast("double")).alias("v"))
    out = R.selection_shares(x, "feature", "replicate", "label", "v", FLAGS)
    return out.select("feature", *(r4(c).alias(c) for c in out.columns[1:]))


@query(
    f"""WITH v AS (SELECT dayofweek(ts)::INT + 1 AS day, event_type AS g, round(value, 0) AS value FROM events WHERE value IS NOT NULL),
b AS (SELECT a.day, a.g AS a, b.g AS b FROM (SELECT DISTINCT day, g FROM v) a JOIN (SELECT DISTINCT day, g FROM v) b ON a.day = b.day AND a.g < b.g),
m AS (SELECT day, a, b, g, value, rank() OVER (PARTITION BY day, a, b ORDER BY value) + (count(*) OVER (PARTITION BY day, a, b, value) - 1) / 2.0::DOUBLE AS mid FROM b JOIN v USING (day) WHERE g = a OR g = b),
t AS (SELECT day, a, b, sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT day, a, b, count(*) AS c FROM m GROUP BY day, a, b, value) GROUP BY day, a, b),
u AS (SELECT day, a, b, sum(mid) FILTER (g = a) - (count(*) FILTER (g = a)) * (count(*) FILTER (g = a) + 1) / 2.0::DOUBLE AS u, (count(*) FILTER (g = a))::DOUBLE AS x, (count(*) FILTER (g = b))::DOUBLE AS y FROM m GROUP BY day, a, b),
z AS (SELECT day, a, b, u, greatest(abs(u - x * y / 2) - 0.5, 0) / sqrt(x * y / 12 * (x + y + 1 - ties / ((x + y) * (x + y - 1)))) / sqrt(2) AS x FROM u JOIN t USING (day, a, b)),
p AS (SELECT day, a, b, u, CASE WHEN x > 4 THEN 0 ELSE {SERIES} END AS p FROM z),
r AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY p) + count(*) OVER (PARTITION BY day, p) - 1 AS k, count(*) OVER (PARTITION BY day) AS m FROM p)
SELECT day, a, b, u, round(p, 4) AS p, round(least(1, min(p * m / k * list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i))) OVER (PARTITION BY day ORDER BY k DESC)), 4) AS p_adjusted FROM r"""
)
def pair_tests(spark, d):
    """All pairs of types on each day of the week, exact where groups are small and untied, adjusted within the day for any dependence."""
    x = table(spark, d, "events").where("value IS NOT NULL").select(F.dayofweek("ts").alias("day"), "event_type", F.round("value", 0).alias("value"))
    out = T.adjusted(checkpointed(T.rank_sums(x, "value", "event_type", ["day"], 2, exact=True)), "p", ["day"], "by")
    return out.select("day", "a", "b", "u", r4("p").alias("p"), r4("adjusted").alias("p_adjusted"))


@query(
    f"""WITH s AS (SELECT vec_id, {SPECTRUM} AS s FROM embeddings), r AS (SELECT vec_id, unnest(range(0, len(s))) AS i, unnest(list_transform(range(1, len(s) + 1), lambda k: list_sum(s[1:k]))) AS run, list_sum(s) AS whole FROM s)
SELECT vec_id, greatest(count(*) FILTER (run <= 0.25::DOUBLE * whole) - 1, 0)::INT AS q25, greatest(count(*) FILTER (run <= 0.5::DOUBLE * whole) - 1, 0)::INT AS q50 FROM r GROUP BY 1"""
)
def energy_quartile_bins(spark, d):
    """The bin before the first whose running sum is strictly over a quarter, and over a half."""
    x = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("s"))
    return x.select("vec_id", S.before_share(F.col("s"), 0.25).alias("q25"), S.before_share(F.col("s"), 0.5).alias("q50"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), o AS (SELECT vec_id, e, list_transform(range(2, len(e) + 1), lambda k: e[k] - e[k - 1]) AS a FROM v),
t AS (SELECT vec_id, e, a, list_transform(range(2, len(a) + 1), lambda k: a[k] - a[k - 1]) AS b FROM o)
SELECT vec_id, round(list_sum(list_transform(a, lambda x: x * x)), 4) AS first, round(list_sum(list_transform(b, lambda x: x * x)), 4) AS second, len(b)::INT AS n, (list_position(list_transform(e, lambda x: abs(x - 0.1::DOUBLE)), list_min(list_transform(e, lambda x: abs(x - 0.1::DOUBLE)))) - 1)::BIGINT AS nearest,
  ceil(log2(len(e)))::INT AS power, round(e[1] * 48000 / (2 * pi()), 4) AS hz FROM t"""
)
def vector_deltas(spark, d):
    """Energy of first and second differences, the component nearest to a value, the power of two that holds the length, radians in Hz."""
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one, two, e = S.differences(F.col("e")), S.differences(F.col("e"), 2), F.col("e")
    return x.select("vec_id", r4(S.dot(one, one)).alias("first"), r4(S.dot(two, two)).alias("second"), F.size(two).alias("n"), S.nearest_bin(e, F.lit(0.1)).alias("nearest"), S.next_power(F.size(e)).alias("power"), r4(S.radians_to_hz(e[0], 48000.0)).alias("hz"))
