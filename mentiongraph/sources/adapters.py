"""Map the driver's tables onto the record shapes the operators consume.

``mentions``  lineitem joined to orders (and part for the entity type): one row per entity mention.
              article = order, entity = ``part-<partkey>``, type = brand, sentence = line number,
              score = (discount - 0.05) * 20 in [-1, 1], time = order date. Mentions inside one
              article are ordered by line number, then part key, then the remaining columns, so the
              order is total; articles are ordered by (time, order key).
``articles``  documents as raw articles (id, title, content, feed, tags, published time).
``posts``     conversations as social posts with a nested author.
``pages_raw`` pages (url, html).
``stream_events`` events with ``ts`` cast to TIMESTAMP so watermarks accept it.

All joins are plain equi-joins; Catalyst prunes columns and AQE decides on broadcast from the
measured size of each side (no unconditional broadcast of a table that grows with the data).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Order of mentions inside one article (tie-break columns after the line number).
MENTION_ORDER = ["sent_idx", "t_part", "t_supp", "t_qty", "t_price", "t_disc", "t_tax", "t_rf", "t_ls", "t_ship"]

MENTIONS_PER_TASK = 500_000

# Fixed base time for documents and conversations (they carry no time of their own).
ARTICLE_BASE_TIME = "2024-01-01 00:00:00"


def mention_partitions(spark: SparkSession, sf_dir: str) -> int | None:
    """How many tasks share the mentions so that none gets more than MENTIONS_PER_TASK; None for a table of one task's size."""
    n = math.ceil(table(spark, sf_dir, "lineitem").count() / MENTIONS_PER_TASK)
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > 1 else None


def mentions(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """``partitions``: how many tasks join the lines to their orders; left to Spark without."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    if partitions:
        li, orders = li.repartition(partitions, "l_orderkey"), orders.repartition(partitions, "o_orderkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    m = (li.join(orders, li.l_orderkey == orders.o_orderkey)
         .join(part, li.l_partkey == part.p_partkey, "left"))
    score = F.round((F.col("l_discount") - F.lit(0.05)) * F.lit(20.0), 6)
    return (m.select(
        F.col("l_orderkey").alias("article_id"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("entity"),
        F.coalesce(F.col("p_brand"), F.lit("")).alias("etype"),
        F.col("l_linenumber").cast("int").alias("sent_idx"),
        score.alias("score"),
        F.abs(score).alias("confidence"),
        F.col("l_partkey").alias("t_part"), F.col("l_suppkey").alias("t_supp"),
        F.col("l_quantity").alias("t_qty"), F.col("l_extendedprice").alias("t_price"),
        F.col("l_discount").alias("t_disc"), F.col("l_tax").alias("t_tax"),
        F.col("l_returnflag").alias("t_rf"), F.col("l_linestatus").alias("t_ls"),
        F.col("l_shipdate").alias("t_ship"))
        .filter(F.trim(F.col("entity")) != ""))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    base = F.to_timestamp(F.lit(ARTICLE_BASE_TIME))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.trim(F.substring_index(F.col("text"), "\n", 1)).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://news.example/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("link"),
        F.col("doc_id").alias("feed_id"),
        F.col("source").alias("feed_title"),
        F.timestamp_seconds(F.unix_seconds(base) + F.col("doc_id") * 60).alias("published_at"),
        F.array(F.col("lang")).alias("tags"),
        F.col("source").alias("source"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    base = F.unix_seconds(F.to_timestamp(F.lit(ARTICLE_BASE_TIME)))
    even = (F.col("turn") % 2) == 0
    return conv.select(
        F.col("conv_id"), F.col("turn"),
        F.col("text"),
        F.date_format(F.timestamp_seconds(base + F.col("conv_id") * 60 + F.col("turn")),
                      "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.when(even, F.format_string("at://%s.example/app.post/%d-%d", F.col("role"), F.col("conv_id"), F.col("turn")))
         .alias("uri"),
        F.lit(None).cast("string").alias("web_url"),
        F.lit(None).cast("string").alias("id"),
        F.struct(F.concat(F.col("role"), F.lit(".example")).alias("handle"),
                 F.when(F.col("role") == "assistant", F.lit(None).cast("string"))
                  .otherwise(F.initcap(F.col("role"))).alias("display_name")).alias("author"),
        F.concat(F.lit("q"), (F.col("conv_id") % 3).cast("string")).alias("query"),
    )


def pages_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url"), F.col("html"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id", "event_type", "value",
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity"),
    )
