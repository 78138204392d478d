"""Names, checks and two-level statistics on small tables with nulls, ties and empty input."""

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxstrata.functions import scalars as S
from voxstrata.operators import relational as R
from voxstrata.operators import statistics as T
from voxstrata.plans import reporting  # noqa: F401
from voxstrata.plans.catalogue import ORACLE_SQL, QUERIES


def test_names(spark):
    x = spark.createDataFrame([("P24-1-Elvis-DONE", "a/Week_ 07/b"), ("P24-2 & and  24-3 Anna", "x/w12"), ("5 Bob", "none"), (None, None)], "f string, p string")
    got = [tuple(r) for r in x.select(S.subject_of(F.col("f")), S.week_of(F.col("p"))).collect()]
    assert got == [("Elvis", 7), ("Anna", 12), ("Bob", None), (None, None)]


def test_columns(spark):
    x = spark.createDataFrame([(1, "a", 2.0)], "id int, label string, v double")
    assert R.schema_faults(x, ["id", "label", "v"], ["v"]) == []
    assert len(R.schema_faults(x, ["id", "v"], ["label", "w"])) == 3
    with pytest.raises(ValueError, match="1 columns are missing"):
        R.projected(x, ["id", "gone"])
    assert R.features_after(x.columns, "id") == ["label", "v"] and R.features_besides(x.columns, ["label"]) == ["id", "v"]


def test_correlations_with_nulls_and_constants(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 3)) + [0, 1e6, 0]
    v[:, 2] += v[:, 0]
    rows = [(float(a), float(b), None if i % 7 == 0 else float(c), 0.1) for i, (a, b, c) in enumerate(v)]
    got = {(r["a"], r["b"]): r["r"] for r in R.correlations(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd")).collect()}
    has = np.arange(200) % 7 != 0
    assert got["a", "b"] == pytest.approx(np.corrcoef(v[:, 0], v[:, 1])[0, 1], abs=1e-9)
    assert got["a", "c"] == pytest.approx(np.corrcoef(v[has, 0], v[has, 2])[0, 1], abs=1e-9)
    assert got["a", "d"] is None and len(got) == 6


def test_adjusted_over_many_spans(spark):
    p = np.random.default_rng(1).random(3000).round(3)
    df = spark.createDataFrame([(i, None if i % 2 else "g", float(x)) for i, x in enumerate(p)], "i int, g string, p double")
    got = {r["i"]: r["adjusted"] for r in T.adjusted(df, "p", ["g"]).collect()}
    for family in (0, 1):
        at = np.arange(family, 3000, 2)
        order = at[np.argsort(p[at], kind="stable")]
        want = np.minimum(1, np.minimum.accumulate((p[order] * len(at) / np.arange(1, len(at) + 1))[::-1])[::-1])
        assert np.allclose([got[int(i)] for i in order], want)


def test_previous_rows(spark):
    df = spark.createDataFrame([(None, 3, "x"), (None, 1, "y"), ("a", 5, "z"), ("a", 9, None), ("b", 1, "w")], "g string, o int, v string")
    got = {(r["g"], r["o"]): (r["o_before"], r["v_before"]) for r in T.previous(df, ["g"], "o").collect()}
    assert got == {(None, 3): (1, "y"), ("a", 9): (5, "z")}
    assert T.previous(df.limit(0), ["g"], "o").count() == 0


def test_intervals_of_few(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None)], "g string, v double")
    got = {r["g"]: r for r in R.intervals(df, ["g"], "v").collect()}
    assert got["a"]["high"] == pytest.approx(2 + 12.7062047 * 1.0, abs=1e-5)
    assert got["b"]["se"] is None and got["c"]["n"] == 0


def test_descriptives_of_null_cells(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 1, 2.0), ("a", 2, None)], "g string, s int, value double")
    got = {r["g"]: r for r in R.descriptives(df, ["g"], "s").collect()}
    assert got[None]["median"] == 1.5 and got[None]["n_subjects"] == 1 and got["a"]["n"] == 0 and got["a"]["median"] is None


@pytest.mark.parametrize("name", ["recorded_grid", "subject_week_grid"])
def test_weeks_turn_at_rounded_seconds(spark, tmp_path, name):
    """Times within a second of a week's end, before and after 1970, fall into the week that the SQL says."""
    turn = [datetime.datetime(1970, 1, 1) + datetime.timedelta(days=7 * w) for w in (-3, 0, 1, 2, 2817, 2818)]
    near = [0, 1, 499_999, 500_000, 500_001, 999_999, 1_000_000, 1_500_000]
    at = [t + datetime.timedelta(microseconds=sign * m) for t in turn for m in near for sign in (-1, 1)]
    events = [(i, t, i, e) for i, t in enumerate([*at, None]) for e in ("click", "view")]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchdf()
    got = QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).to_numpy())) == sorted(map(tuple, want.astype(str).to_numpy()))
