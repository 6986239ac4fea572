"""Ordered / windowed operators.

``rolling_hour_count`` (W1) counts, for every row, the rows of the same key in the hour before it
(both ends inclusive, rows after it at the same instant excluded). Instead of one RANGE window per
key (a hot key would sit in one task) rows are cut into (key, hour) partitions: a row at t sees the
rows of its own hour up to itself, plus the rows of the previous hour at or after t - 1h. The
previous hour is brought into the same partition by shifting it forward by one hour, so both
counts come from running sums of one window partitioned by (key, hour).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def rolling_hour_count(df: DataFrame, key: str, ts: str, tiebreak: str, out: str, span_us: int = HOUR_US) -> DataFrame:
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    q = df.select(key, ts, tiebreak, us.alias("_t"), F.lit(0).alias("_kind"))
    pts = df.select(key, F.lit(None).cast(df.schema[ts].dataType).alias(ts), F.lit(None).cast(df.schema[tiebreak].dataType).alias(tiebreak),
                    (us + F.lit(span_us)).alias("_t"), F.lit(1).alias("_kind"))
    u = q.unionByName(pts).withColumn("_h", F.floor(F.col("_t") / F.lit(span_us)))
    w = Window.partitionBy(key, "_h").orderBy("_t", "_kind", tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    wall = Window.partitionBy(key, "_h")
    u = (u.withColumn("_cq", F.sum(1 - F.col("_kind")).over(w))
          .withColumn("_cp", F.sum("_kind").over(w))
          .withColumn("_tp", F.sum("_kind").over(wall)))
    return (u.filter(F.col("_kind") == 0)
            .select(tiebreak, key, ts, (F.col("_cq") + F.col("_tp") - F.col("_cp")).cast("long").alias(out)))


def every_n(df: DataFrame, seq: str, n: int) -> DataFrame:
    """Rows whose 1-based sequence number is a multiple of n (community / export trigger)."""
    return df.filter((F.col(seq) % F.lit(max(1, n))) == 0)
