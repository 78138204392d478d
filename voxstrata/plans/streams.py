"""Registered streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.streams import closed_windows
from .catalogue import query


@query(
    """WITH e AS (SELECT event_type, epoch_us(ts) AS t, value FROM events WHERE ts IS NOT NULL), m AS (SELECT (max(t) // 1000) * 1000 - 3600000000 AS mark FROM e),
w AS (SELECT event_type, value, ((t // 1800000000) - k) * 1800000000 AS b FROM e, range(0, 2) x(k))
SELECT strftime(make_timestamp(b), '%Y-%m-%d %H:%M:%S') AS begin, event_type, count(*) AS n, round(sum(value::DECIMAL(28,4))::DOUBLE, 2) AS total FROM w, m WHERE b + 3600000000 <= mark GROUP BY b, event_type"""
)
def stream_hop_windows(spark, d):
    """Hourly windows every half hour over the stream of events, as far as the watermark has closed them."""
    out = closed_windows(spark, f"{d}/events.parquet", time="ts", size="1 hour", slide="30 minutes", delay="1 hour", keys=["event_type"], value="value")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "event_type", "n", F.round(F.col("total").cast("double"), 2).alias("total"))
