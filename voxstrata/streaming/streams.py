"""Structured Streaming: hopping windows, running filters and files taken once.

Defined cases: events later than the watermark are left out of windows that have closed; null times join no window; an
empty stream gives no rows; a file seen again is not written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import fresh


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path[:-1] + f"[{path[-1]}]")  # a pattern, as a lone file is no folder


def hop_windows(events: DataFrame, time: str, size: str, slide: str, delay: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of hopping windows, each given out once the watermark has passed its end."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(28,4)")).alias("total"))


def smoothed(events: DataFrame, key: str, order: str, value: str, weight: float = 0.999) -> DataFrame:
    """A first-order recursive filter of each key's values, carried from batch to batch; null values pass the state on."""
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"{key} {types[key]}, {order} {types[order]}, smoothed double"

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([order, value], kind="stable")
        y = state.get[0] if state.exists else None
        out = []
        for x in rows[value]:
            if not pd.isna(x):
                y = float(x) if y is None else weight * y + (1 - weight) * float(x)
            out.append(y)
        if y is not None:
            state.update((y,))
        yield pd.DataFrame({key: group[0], order: rows[order].to_numpy(), "smoothed": out})

    return events.select(key, order, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, schema, "y double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, state: str) -> DataFrame:
    """Everything that is there now, appended to Parquet at ``path``; ``state`` remembers what has been taken."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def append_new(stream: DataFrame, keys: list[str], path: str, state: str, make: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """Each batch writes the rows whose keys are not yet under ``path``: a repeated batch writes nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = make(batch.dropDuplicates(keys))
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            done = spark.read.schema(out.schema).parquet(path)
            out = out.join(done.select(*keys), keys, "left_anti")
        out.write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def closed_windows(spark: SparkSession, path: str, **how) -> DataFrame:
    """hop_windows over a table read as a stream, to its end."""
    out = hop_windows(stream_of(spark, path), **how)
    return run_once(out, fresh(spark, "windows"), fresh(spark, "windows-state"))
