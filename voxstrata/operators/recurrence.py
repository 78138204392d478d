"""Linear recurrences y[t] = factor[t] * y[t - 1] + offset[t] within groups, as an associative scan over sorted partitions.

Rows are sorted once by group and order into range partitions (a group may fill many) and written. A first pass over the
partitions composes each one's steps for its first and its last group to a pair (factor, offset): at most two rows a
partition, from which the value that each partition begins with follows by composing pairs in order. A second pass runs
through each partition from that value. No task holds a group, and both passes stream.

Defined cases: a null factor or offset leaves y as it was; at a group's first row y[t - 1] is ``initial``, or, where ``first``
is given, y is that column's value there (null is taken as ``initial``); null groups are groups of their own; equal orders
follow each other in any order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

_OWN = ["__key", "__a", "__b", "__f"]


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
    """The rows of each group in a batch, in order, with the group's key."""
    for frame in frames:
        keys = frame["__key"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield keys[a], frame.iloc[a:b]


def _steps(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    a, b = part["__a"].to_numpy(float, na_value=np.nan), part["__b"].to_numpy(float, na_value=np.nan)
    skip = np.isnan(a) | np.isnan(b)
    return np.where(skip, 1.0, a), np.where(skip, 0.0, b)


def _run(a: np.ndarray, b: np.ndarray, y: float) -> list[float]:
    return list(accumulate(zip(a.tolist(), b.tolist()), lambda v, s: s[0] * v + s[1], initial=y))[1:]


def _begun(part: pd.DataFrame, initial: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a segment that begins its group: with a value of its own the first one doesn't look back."""
    a, b = _steps(part)
    f = part["__f"].iloc[0]
    if own:
        a[0], b[0] = 0.0, initial if pd.isna(f) else f
    return a, b


def linear_scan(df: DataFrame, within: list[str], order: list[str], factor: Column, offset: Column, initial: float = 0.0, first: Column | None = None, to: str = "y", partitions: int | None = None) -> DataFrame:
    """df with ``to``: the recurrence's value at each row. ``partitions`` range partitions are made, by Spark's own number if none is given."""
    x = df.withColumns({"__key": F.to_json(F.struct(*within)) if within else F.lit(""), "__a": factor.cast("double"), "__b": offset.cast("double"), "__f": (F.lit(None) if first is None else first).cast("double")})
    keys = [*within, *order]
    x = checkpointed((x.repartitionByRange(partitions, *keys) if partitions else x.repartitionByRange(*keys)).sortWithinPartitions(*keys))
    own = first is not None

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []  # of the first group: key, factor, offset, value if it begins here; then the last group's key and value
        last_key, y = None, initial
        for key, part in _segments(frames):
            fresh = key != last_key if last_key is not None else True
            if not held:
                a, b = _steps(part)
                begun = _run(*_begun(part, initial, own), initial)[-1]
                held = [key, float(np.prod(a)), _run(a, b, 0.0)[-1], begun]
                y = begun
            elif key == held[0] and last_key == held[0]:
                a, b = _steps(part)
                held[1], held[2], held[3] = held[1] * float(np.prod(a)), _run(a, b, held[2])[-1], _run(a, b, held[3])[-1]
                y = held[3]
            else:
                a, b = _begun(part, initial, own) if fresh else _steps(part)
                y = _run(a, b, initial if fresh else y)[-1]
            last_key = key
        if held:
            yield pd.DataFrame({"pid": [TaskContext.get().partitionId()], "key": [held[0]], "a": [held[1]], "b": [held[2]], "begun": [held[3]], "last_key": [last_key], "last": [y]})

    ends = x.select(*_OWN).mapInPandas(compose, "pid int, key string, a double, b double, begun double, last_key string, last double")
    starts: dict[int, float] = {}
    key, y = None, initial
    for r in sorted(ends.collect(), key=lambda r: r["pid"]):  # a row a partition
        goes_on = key is not None and r["key"] == key
        if goes_on:
            starts[r["pid"]] = y
        if r["last_key"] == r["key"]:
            y = r["a"] * y + r["b"] if goes_on else r["begun"]
        else:
            y = r["last"]
        key = r["last_key"]
    sent = df.sparkSession.sparkContext.broadcast(starts)
    kept = [c for c in x.columns if c not in _OWN]

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, y = None, None
        for key, part in _segments(frames):
            if last_key is None:
                y = sent.value.get(TaskContext.get().partitionId())
            elif key != last_key:
                y = None
            a, b = _begun(part, initial, own) if y is None else _steps(part)
            values = _run(a, b, initial if y is None else y)
            y, last_key = values[-1], key
            yield part[kept].assign(**{to: values})

    schema = x.select(*kept, F.lit(0.0).alias(to)).schema
    return x.mapInPandas(fill, schema)
