"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at a time; a longer document is a batch of its own.
BATCH_BYTES = 1 << 19
#: Bytes of an Arrow batch between the JVM and Python, so that long texts don't add up.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by size rather than by 10,000 rows: texts differ too much in length for a number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read through Spark so that any file system it knows will do."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    small_batches(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("voxstrata.shared.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="voxstrata-", dir="/tmp")
        spark.conf.set("voxstrata.shared.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch either way
        return


class Scratch:
    """Tables written to the shared folder, cutting lineage; ``drop`` removes those that nobody reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _remove(self.spark, df._scratch_path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the shared folder; partitions keep their rows and order."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(text: str = "text") -> Column:
    """Whole texts as UTF-8 bytes, null as empty: no decoding between the JVM and numpy."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def byte_batches(frames: Iterator[pd.DataFrame], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pd.DataFrame]:
    """Cut the frames of a task so that each holds about ``limit`` bytes of text, and at least one row."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].map(len).to_numpy().cumsum()
        group = sizes // limit
        start = 0
        for end in [*((group[1:] != group[:-1]).nonzero()[0] + 1), len(frame)]:
            yield frame.iloc[start:end]
            start = end


#: Bytes of features that a model is fitted on at most.
FIT_BYTES = 128 << 20


def fitting_rows(docs: DataFrame, chosen: DataFrame, features, schema: str, size: str, seed: int, limit: int = FIT_BYTES) -> pd.DataFrame:
    """Features of the chosen documents, one row for each row of ``chosen``, at most ``limit`` bytes of them, on the driver.

    chosen: (doc_id, ...), a bounded number of distinct rows; features: a function for mapInPandas that passes chosen's columns
    on and adds binary ones. Of several texts under one doc_id one is taken, by its features. Rows are taken in the order of a
    hash of the doc_id, up to the first that goes beyond the limit.
    """
    rows = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id").mapInPandas(features, schema)
    one = rows.groupBy(*chosen.columns).agg(F.min(F.struct(*(c for c in rows.columns if c not in chosen.columns))).alias("__f")).select(*chosen.columns, "__f.*")
    one = Scratch(docs.sparkSession, "fit").write(one)
    order = one.select(*chosen.columns, F.octet_length(size).alias("__bytes"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("__h")).toPandas()  # as many rows as chosen
    order = order.sort_values(["__h", *chosen.columns])
    kept = order[(order["__bytes"].cumsum() <= limit) | (np.arange(len(order)) == 0)]
    ids = docs.sparkSession.createDataFrame(kept[chosen.columns], chosen.schema) if len(kept) else chosen.limit(0)
    return one.join(F.broadcast(ids), chosen.columns).toPandas().sort_values(chosen.columns, kind="stable").reset_index(drop=True)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n: the folds that the labels are split by."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: Bits of the filter that spares rows a shuffle (4 MB; a false positive costs a row).
FILTER_BITS = 1 << 25


def maybe_among(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS, key: str = "id") -> DataFrame:
    """docs with ``__maybe``, false only where its key is not among ids: by a bitmap of fixed size that is broadcast."""
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__map"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    near = docs.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("__bucket"), "left")
    return near.withColumn("__maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("__bucket", "__map")


def only(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of docs whose id may be among ids: a superset."""
    return maybe_among(docs, ids, bits).where("__maybe").drop("__maybe")
