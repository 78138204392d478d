"""Recordings and their cycle files as DataFrames: binaryFile scans, decoded in tasks; faults become a column.

Defined cases: a file that isn't a readable recording has an ``error`` and null fields; an empty folder gives no rows;
channels are averaged to one; names that don't follow the pattern have null treatment, week and subject.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLIP = "sampling_rate int, channels int, bits int, duration double, samples array<double>, error string"
CYCLES = "cycles array<struct<start:bigint,end:bigint>>, error string"
#: The folder name of a set of clips, and the time in the name of a cycle file.
SNIP = r"(?i)week[_\s]*(\d+)[_\s]+(.+?)[_\s]+([BUS])[_\s]*snip"
VERSION = r"@(\d{2}[A-Za-z]{3}\d{2})\((\d{2})-(\d{2})\)"


def riff(content: bytes) -> dict:
    """Format fields and the place of the samples, from the chunks of a RIFF header; ValueError where there are none."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, out = 12, {}
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(content):
            out["code"], out["channels"], out["sampling_rate"], out["byte_rate"], _, out["bits"] = struct.unpack_from("<HHIIHH", content, at + 8)
        if name == b"data":
            if "byte_rate" not in out:
                raise ValueError("samples before the format")
            return out | {"begin": at + 8, "size": size, "duration": size / out["byte_rate"] if out["byte_rate"] else None}
        at += 8 + size + size % 2
    raise ValueError("no samples")


def samples_of(content: bytes, head: dict) -> np.ndarray:
    """Samples between -1 and 1, channels averaged."""
    kinds = {16: "<i2", 32: "<i4"}
    if head["code"] not in (1, 0xFFFE) or head["bits"] not in kinds:
        raise ValueError(f"samples of {head['bits']} bits, format {head['code']}")
    width = head["bits"] // 8 * head["channels"]
    raw = content[head["begin"] : head["begin"] + head["size"]]
    x = np.frombuffer(raw[: len(raw) // width * width], kinds[head["bits"]]).astype(float) / (2 ** (head["bits"] - 1) - 1)
    return x.reshape(-1, head["channels"]).mean(1)


def _decoded(scan: DataFrame, schema: str, decode) -> DataFrame:
    names = [part.split(" ", 1)[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    if content is None:
                        raise ValueError("no content")
                    rows.append((path, *decode(content), None))
                except (ValueError, struct.error) as fault:
                    rows.append((path, *[None] * (len(names) - 1), str(fault)))
            yield pd.DataFrame(rows, columns=["path", *names])

    return scan.select("path", "content").mapInPandas(run, "path string, " + schema)


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)


def path_fields(path: Column) -> list[Column]:
    """Treatment, week, subject and the clip's name from a path."""
    part = lambda k: F.nullif(F.regexp_extract(path, SNIP, k), F.lit(""))
    return [F.upper(part(3)).alias("treatment"), part(1).cast("int").alias("week"), F.trim(part(2)).alias("subject"), F.regexp_extract(path, r"([^/@]+?)(@[^/]*)?\.[A-Za-z]+$", 1).alias("clip")]


def read_clips(spark: SparkSession, root: str, rate: int | None = None) -> DataFrame:
    """One row for each .wav file below root; other rates than ``rate`` are an error."""
    return clips_of(files(spark, root, "*.[wW][aA][vV]").where(~F.col("path").rlike(r"/\._[^/]*$")), rate)


def clips_of(scan: DataFrame, rate: int | None = None) -> DataFrame:
    """The same from (path, content) rows of any table."""

    def decode(content: bytes) -> tuple:
        head = riff(content)
        if rate is not None and head["sampling_rate"] != rate:
            raise ValueError(f"sampling rate {head['sampling_rate']}")
        return head["sampling_rate"], head["channels"], head["bits"], head["duration"], samples_of(content, head)

    clips = _decoded(scan, CLIP, decode)
    return clips.select(*path_fields(F.col("path")), *clips.columns)


def read_cycles(spark: SparkSession, root: str) -> DataFrame:
    """The newest cycle file of each clip: pairs of first and last sample, from little-endian unsigned integers."""

    def decode(content: bytes) -> tuple:
        if len(content) < 8:
            raise ValueError("no header")
        n = int(np.frombuffer(content[:4], "<u4")[0])
        if len(content) < 8 + 8 * n:
            raise ValueError("fewer cycles than the header says")
        return ([{"start": int(a), "end": int(b)} for a, b in np.frombuffer(content[8 : 8 + 8 * n], "<u4").reshape(-1, 2)],)

    scan = files(spark, root, "*.cycles")
    stamp = F.concat_ws(" ", F.regexp_extract("path", VERSION, 1), F.concat_ws(":", F.regexp_extract("path", VERSION, 2), F.regexp_extract("path", VERSION, 3)))
    version = F.coalesce(F.try_to_timestamp(F.initcap(stamp), F.lit("ddMMMyy HH:mm")), F.lit("1900-01-01").cast("timestamp"))
    listed = scan.drop("content").select("path", version.alias("version"), *path_fields(F.col("path")))
    newest = listed.groupBy("treatment", "week", "subject", "clip").agg(F.max_by("path", F.struct("version", "path")).alias("path"))
    return newest.join(_decoded(scan, CYCLES, decode), "path")


def annotated(clips: DataFrame, cycles: DataFrame) -> DataFrame:
    """Clips with the cycles of the same treatment, week, subject and name; those without are left out."""
    keys = ["treatment", "week", "subject", "clip"]
    return clips.where("error IS NULL").join(cycles.where("error IS NULL").select(*keys, "cycles"), keys)


def cycle_measures(clips: DataFrame) -> DataFrame:
    """One row for each cycle: period, peak to peak amplitude and energy per second; gaps between cycles are flagged."""
    x = clips.select("treatment", "week", "subject", "clip", "sampling_rate", "samples", "cycles", F.posexplode("cycles").alias("cycle", "c"))
    end = F.coalesce(F.try_element_at("cycles", F.col("cycle") + 2)["start"], F.col("c")["end"] + 1)
    part = F.slice("samples", F.col("c")["start"].cast("int") + 1, (end - F.col("c")["start"]).cast("int"))
    x = x.withColumn("x", part).withColumn("gap", end != F.col("c")["end"] + 1)
    period = F.size("x") / F.col("sampling_rate")
    energy = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    return x.select("treatment", "week", "subject", "clip", "cycle", period.alias("period"), (F.array_max("x") - F.array_min("x")).alias("amplitude"), F.try_divide(energy, period).alias("energy"), "gap")


def wave_bytes(x: np.ndarray, rate: int) -> bytes:
    """A RIFF file of one channel of 16 bits; samples beyond -1 and 1 are clipped."""
    data = np.clip(np.rint(np.asarray(x, float) * 32767), -32767, 32767).astype("<i2").tobytes()
    form = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data


def cycle_bytes(cycles) -> bytes:
    """A cycle file of (start, end) pairs."""
    pairs = np.array([(c["start"], c["end"]) for c in cycles], "<u4").reshape(-1, 2)
    return struct.pack("<II", len(pairs), 2) + pairs.tobytes()


def _encoded(df: DataFrame, encode, *columns: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [None if any(v is None or (np.isscalar(v) and pd.isna(v)) for v in row) else encode(*row) for row in zip(*(frame[c] for c in columns))]
            yield pd.DataFrame({"path": frame["path"], "content": made})

    return df.select("path", *columns).mapInPandas(run, "path string, content binary")


def encoded_clips(clips: DataFrame) -> DataFrame:
    """(path, content) of recordings, for a table that ``clips_of`` reads; null samples give null content."""
    return _encoded(clips, lambda x, rate: wave_bytes(x, int(rate)), "samples", "sampling_rate")


def encoded_cycles(cycles: DataFrame) -> DataFrame:
    """(path, content) of cycle files; null cycles give null content."""
    return _encoded(cycles, cycle_bytes, "cycles")


def wide(features: DataFrame, key: str, order: list[tuple[str, str]]) -> DataFrame:
    """One row for each clip with a column ``family_feature`` for each pair in ``order``: no column list is collected."""
    cell = [F.max(F.when((F.col("family") == family) & (F.col("feature") == name), F.col("value"))).alias(f"{family}_{name}") for family, name in order]
    return features.groupBy(key).agg(*cell)
