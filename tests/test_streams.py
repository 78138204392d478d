"""Streaming operators on small streams that arrive in parts."""

from voxstrata.streaming import streams as Q

SCHEMA = "id int, k string, t int, v double"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_filter_keeps_its_state(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{n}" for n in ("src", "out", "state"))
    put(spark, src, [(1, "a", 1, 1.0), (2, "a", 2, 3.0), (3, "b", 1, None)])
    Q.run_once(Q.smoothed(Q.stream_of(spark, src), "k", "t", "v", 0.5), out, state)
    put(spark, src, [(4, "a", 3, 4.0), (5, "b", 2, 2.0)])
    got = Q.run_once(Q.smoothed(Q.stream_of(spark, src), "k", "t", "v", 0.5), out, state)
    assert {(r["k"], r["t"]): r["smoothed"] for r in got.collect()} == {("a", 1): 1.0, ("a", 2): 2.0, ("a", 3): 3.0, ("b", 1): None, ("b", 2): 2.0}


def test_rows_are_taken_once(spark, tmp_path):
    src, out = (f"file://{tmp_path}/{n}" for n in ("src", "out"))
    put(spark, src, [(1, "a", 1, 1.0), (1, "a", 1, 1.0), (2, "b", 1, 2.0)])
    Q.append_new(Q.stream_of(spark, src), ["id"], out, f"file://{tmp_path}/s1")
    put(spark, src, [(3, "c", 1, 3.0)])
    Q.append_new(Q.stream_of(spark, src), ["id"], out, f"file://{tmp_path}/s1")
    Q.append_new(Q.stream_of(spark, src), ["id"], out, f"file://{tmp_path}/s2")  # its state is lost: all comes again
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
