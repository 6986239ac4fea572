"""Priority topics kept from batch to batch (D2, D3, D4): one bounded list a key, copied on write.

``register`` reads the lists of the batch's own keys (hash parts pruned, keys semi-joined), merges the
requests and writes the new lists as the next version's delta; every ``compact_every`` versions a
whole copy is written. A batch id that was registered before changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.versions import Commit, VersionedTables
from .intake import PRIORITY_MAX_TOPICS, PRIORITY_TTL_SECONDS, active_queries, merge_priority_topics

LISTS = "key string, topics array<struct<topic:string,requested_at:timestamp>>, part int"


class PriorityTopics:
    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = PRIORITY_TTL_SECONDS, max_topics: int = PRIORITY_MAX_TOPICS,
                 parts: int = 64, compact_every: int = 16):
        if min(parts, compact_every, max_topics) < 1 or ttl_seconds < 0:
            raise ValueError("parts, compact_every and max_topics are at least 1, ttl_seconds at least 0")
        self.spark, self.ttl_seconds, self.max_topics, self.parts, self.compact_every = spark, ttl_seconds, max_topics, parts, compact_every
        self.tables = VersionedTables(spark, path)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max_by("topics", "version").alias("topics"))

    def lists(self, commit: Commit | None = None) -> DataFrame:
        """(key, topics): every key's list, the newest topic first."""
        return self._newest(self.tables.read("topics", LISTS, commit or self.tables.newest()))

    def register(self, batch_id: int, requests: DataFrame) -> None:
        """Upsert the requests (key, topic, requested_at) of a batch."""
        if self.tables.of_batch(batch_id) is not None:
            return
        now = self.tables.newest()
        version = now.version + 1 if now else 1
        part = F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int").alias("part")
        keys = materialize(requests.filter("key is not null").select("key", part).distinct(), "priority-keys")
        wanted = [r.part for r in keys.select("part").distinct().collect()]  # at most self.parts numbers
        stored = self.tables.read("topics", LISTS, now).filter(F.col("part").isin(wanted)).join(keys, ["key", "part"], "left_semi")
        merged = merge_priority_topics(self._newest(stored), requests, "key", self.ttl_seconds, self.max_topics)
        whole = now is not None and version % self.compact_every == 0
        if whole:
            merged = materialize(merged, "priority-lists")
            merged = merged.unionByName(self.lists(now).join(merged.select("key"), "key", "left_anti"))
        self.tables.write("topics", version, merged.select("key", "topics", part), ("part",))
        self.tables.commit(version, batch_id, version if whole or now is None else now.base, {})

    def topics(self, now: str | None = None) -> DataFrame:
        """D3: (key, rank, topic, requested_at), of a moment ``now`` only those within the TTL before it."""
        rows = self.lists().select("key", F.posexplode("topics").alias("rank", "t")).select("key", "rank", "t.*")
        if now is None:
            return rows
        cutoff = F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(self.ttl_seconds))
        return rows.filter(F.col("requested_at") >= cutoff)

    def queries(self, defaults: DataFrame, now: str | None = None) -> DataFrame:
        """(key, rank, term): a key's priority topics, then its default terms (key, pos, term), each term once in any case."""
        first = self.topics(now).select("key", F.col("rank").alias("pos"), F.col("topic").alias("term"))
        w = Window.partitionBy("key").orderBy("rank")
        return active_queries(first, defaults, "key").select("key", (F.row_number().over(w) - 1).alias("rank"), "term")
