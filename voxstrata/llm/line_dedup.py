"""Line dedup: hashed lines range-partitioned and sorted by (key, document, position), streamed for first occurrences.

What comes back is a compressed bitmap a document, with a bit for each line that stays; the texts are not shuffled to
find it. The ranges are cut by key *and* document, so a line that a third of all documents hold is spread over many
tasks; a first pass over the sorted partitions tells each of them how its outermost keys go on in the others.

Defined cases: a null or empty text is one empty line; lines with keys under ``min_chars`` code points stay; repeated
rows of one document count as one holder, and each of them gets the same bitmap; documents without a doc_id keep all
their lines and count for none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import Scratch, checkpointed, maybe_among, table, text_bytes

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, doc_id, version, pos): 128 bits of each key that is long enough. version tells apart texts under one doc_id."""
    lines = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "doc_id", "version", "pos")


def _runs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the keys of a sorted frame start and end, and for each row whether it begins a document of its key."""
    h1, h2, doc = (frame[c].to_numpy() for c in ("h1", "h2", "doc_id"))
    new = np.ones(len(frame), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    fresh = new.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(frame)), fresh


def _outer_keys(min_docs: int):
    """For each partition its first and its last key, with the largest documents that hold them there."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[tuple[int, int, list[int]]] = []
        for frame in frames:
            if not len(frame):
                continue
            starts, ends, fresh = _runs(frame)
            part = int(frame["part"].iloc[0])
            for s, e in {(starts[0], ends[0]), (starts[-1], ends[-1])} if len(starts) > 1 else {(starts[0], ends[0])}:
                docs = frame["doc_id"].to_numpy()[s:e][fresh[s:e]][:min_docs].tolist()
                key = (int(frame["h1"].iloc[s]), int(frame["h2"].iloc[s]))
                seen.append((*key, docs))
            seen.sort(key=lambda x: x[:2])
            first, last = seen[0][:2], seen[-1][:2]
            merged = {k: sorted({d for x in seen if x[:2] == k for d in x[2]}, reverse=True)[:min_docs] for k in (first, last)}
            seen = [(*k, merged[k]) for k in sorted(merged)]
        for k in seen:
            yield pd.DataFrame({"part": [part], "h1": [k[0]], "h2": [k[1]], "docs": [k[2]]})

    return scan


def _stream(min_docs: int, outer: dict[tuple[int, int], tuple[int, int]]):
    """Rows to drop. outer: for keys at the ends of partitions, how many documents hold them and the largest of them."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # rows of an unfinished key with too few documents so far
        going: tuple[int, int, int] | None = None  # an unfinished key that is being dropped: h1, h2, its keeper

        def decide(frame: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame | None, tuple | None]:
            h1, h2, doc = (frame[c].to_numpy() for c in ("h1", "h2", "doc_id"))
            starts, ends, fresh = _runs(frame)
            counts = np.add.reduceat(fresh.astype(np.int64), starts)
            keeper = doc[starts].copy()
            for i in {0, len(starts) - 1}:
                key = (int(h1[starts[i]]), int(h2[starts[i]]))
                if key in outer:
                    counts[i], keeper[i] = outer[key]
                elif going is not None and key == going[:2]:
                    counts[i], keeper[i] = min_docs, going[2]
            rows = np.repeat(np.arange(len(starts)), ends - starts)
            drop = (counts[rows] >= min_docs) & (doc != keeper[rows])
            rest = after = None
            if not last:
                if counts[-1] >= min_docs:
                    after = (int(h1[-1]), int(h2[-1]), int(keeper[-1]))
                else:
                    rest = frame.iloc[starts[-1] :]
            return frame.loc[drop, ["doc_id", "version", "pos"]], rest, after

        for frame in frames:
            if not len(frame):
                continue
            frame = (pd.concat([held, frame]) if held is not None else frame).reset_index(drop=True)
            out, held, going = decide(frame, False)
            if len(out):
                yield out
        if held is not None:
            out, _, _ = decide(held.reset_index(drop=True), True)
            if len(out):
                yield out

    return scan


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, partitions: int | None = None) -> DataFrame:
    """(doc_id, version, pos) of each line whose key at least ``min_docs`` documents hold, but for those of the largest."""
    spark = docs.sparkSession
    lines = checkpointed(line_hashes(docs, min_chars))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("version"), F.col("pos")]
    ranged = lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("part", F.spark_partition_id()))
    ends = ranged.select("part", "h1", "h2", "doc_id").mapInPandas(_outer_keys(min_docs), "part int, h1 long, h2 long, docs array<long>")
    # two keys and a few documents for each partition: bounded by their number
    holders: dict[tuple[int, int], set[int]] = {}
    for r in ends.toLocalIterator():
        holders.setdefault((r["h1"], r["h2"]), set()).update(r["docs"])
    outer = {k: (len(v), max(v)) for k, v in holders.items() if len(v) >= min_docs}
    return ranged.select("h1", "h2", "doc_id", "version", "pos").mapInPandas(_stream(min_docs, outer), "doc_id long, version long, pos int")


@F.pandas_udf(BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for n, gone in zip(n_lines, dropped):
        keep = np.ones(n, np.uint8)
        if gone is not None and len(gone):
            keep[np.asarray(gone, np.int64)] = 0
        out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
    return pd.Series(out)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, version, n_lines, n_dropped, keep): keep is a zlib-compressed bitmap of the lines that stay.

    One row for each row of documents; version is a hash of the text (null for a null text).
    """
    gone = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "version").agg(F.collect_set("pos").alias("dropped"))
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = docs.select("doc_id", F.xxhash64("text").alias("version"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    joined = counts.join(gone, ["doc_id", "version"], "left")
    return joined.select("doc_id", "version", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), _bitmap("n_lines", "dropped").alias("keep"))


def kept_text(text: bytes, n_dropped: int, keep: bytes | None) -> bytes:
    """The text without the lines whose bit is unset."""
    if not n_dropped:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return b"\n".join(line for line, bit in zip(lines, bits) if bit)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of documents with what is left of their texts as ``kept`` (binary), n_lines and n_dropped.

    The bitmaps of equal rows are equal, so one of each is joined back.
    """
    one = Scratch(docs.sparkSession, "bitmaps").write(bitmaps.where("n_dropped > 0").dropDuplicates(["doc_id", "version"]).drop("n_lines"))
    text = text_bytes()
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    left = docs.select(*columns, text.alias("__text"), F.coalesce(lines, F.lit(1)).cast("long").alias("n_lines"), F.xxhash64("text").alias("version"))
    # only documents that may have lost a line are shuffled
    marked = maybe_among(left, one, key="doc_id")
    near = marked.where("__maybe").drop("__maybe").join(one, ["doc_id", "version"], "left")
    rest = marked.where("NOT __maybe").drop("__maybe").withColumns({"n_dropped": F.lit(0).cast("long"), "keep": F.lit(None).cast("binary")})
    both = near.unionByName(rest).drop("version")

    @F.pandas_udf(BinaryType())
    def cut(text: pd.Series, n_dropped: pd.Series, keep: pd.Series) -> pd.Series:
        return pd.Series([kept_text(t, n, k) for t, n, k in zip(text, n_dropped, keep)])

    n = F.coalesce("n_dropped", F.lit(0)).cast("long")
    return both.select(*columns, "n_lines", n.alias("n_dropped"), F.when(n > 0, cut("__text", n, "keep")).otherwise(F.col("__text")).alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = apply_bitmaps(docs, keep_bitmaps(docs), ["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the repeated lines taken out of their texts; n_chars follows."""
    columns = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row")  # whatever the columns are called
    out = apply_bitmaps(docs.select("doc_id", "text", row), keep_bitmaps(docs.select("doc_id", "text")), ["doc_id", "__row"])
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*(new.get(c, F.col("__row").getField(c)).alias(c) for c in columns))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, UNNEST(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND k.doc_id <> h.keeper) AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
