"""Every registered query against its SQL on the smallest tables, and operators against brute force."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from voxstrata.operators import statistics
from voxstrata.plans import features, models, ranks, reporting, streams  # noqa: F401
from voxstrata.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(frame, columns):
    cell = lambda v: "None" if v is None or v != v else repr(float(v) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_adjusted_has_nulls_and_ties(spark):
    p = [0.01, 0.02, 0.02, None, 1.0]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(p)], "i int, p double, g int")
    got = {r["i"]: r["adjusted"] for r in statistics.adjusted(df, "p", ["g"]).collect()}
    assert got[3] is None
    assert got[0] == pytest.approx(0.08 / 3) and got[1] == got[2] == pytest.approx(0.08 / 3) and got[4] == 1.0


def test_mid_ranks_sum(spark):
    df = spark.createDataFrame([(0, float(v), "a") for v in (1, 1, 2, 3, 3, 3)], "w int, v double, g string")
    got = statistics.value_ranks(df, ["w"], "v", "g").agg(F.sum(F.col("n") * F.col("mid"))).first()[0]
    assert got == 21


def test_harmonic_numbers(spark):
    got = spark.range(1, 400).select("id", statistics.harmonic(F.col("id")).alias("h")).collect()
    assert all(abs(r["h"] - sum(1 / k for k in range(1, r["id"] + 1))) < 1e-12 for r in got)
