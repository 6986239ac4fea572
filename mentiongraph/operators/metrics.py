"""Processing metrics per tumbling interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph_state import _r6


def processing_metrics(events: DataFrame, interval_s: int = 3600, now: Column | None = None, skipped: str = "skipped") -> DataFrame:
    """Ok, failed (type ``error``) and skipped counts, rate, mean latency and event-time lag per epoch-aligned window.

    The lag is what ``now`` (the time of processing) is ahead of the window's newest event, 0 at least; skipped
    records count in no other figure but the lag. The partial aggregate runs map-side; one row per window comes out.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = F.floor(t / interval_s) * interval_s
    kind = F.coalesce("event_type", F.lit(""))
    ok = ~kind.isin("error", skipped)
    g = events.groupBy(w.cast("long").alias("window_start")).agg(
        F.count(F.when(ok, 1)).alias("processed_ok"),
        F.count(F.when(kind == "error", 1)).alias("failed"),
        F.count(F.when(kind == skipped, 1)).alias("skipped"),
        F.avg(F.when(ok, F.col("value"))).alias("_lat"),
        F.max(t).alias("_last"))
    at = F.unix_micros((F.current_timestamp() if now is None else now).cast("timestamp")) / 1e6
    return g.select("window_start", "processed_ok", "failed", "skipped",
                    _r6(F.col("processed_ok") / F.lit(float(interval_s))).alias("articles_per_second"),
                    _r6(F.coalesce(F.col("_lat"), F.lit(0.0))).alias("avg_latency_ms"),
                    _r6(F.greatest(F.lit(0.0), at - F.col("_last"))).alias("lag_seconds"))
