"""Structured Streaming wrappers (S1, S4-S8, ST1-ST4, ST6, ST7).

Each stream hop is a ``foreachBatch`` over the same batch functions, with a checkpoint location and
sinks keyed by ``batch_id`` (a re-run batch overwrites its own output partition, so redelivery
never duplicates rows). Watermarks bound the state of the keyed stateful parts.
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooccurrence as co
from ..operators import intake as it
from ..operators import text as tx
from ..operators.held_graph import HeldGraph
from ..operators.held_metrics import HeldMetrics
from ..operators.stored_history import StoredHistory, flatten_changes
from ..session import materialize
from ..sources import schemas

CORRELATION_TIMEOUT_SECONDS = 45


def raw_article_stream(spark: SparkSession, path: str, max_files: int = 25) -> DataFrame:
    """JSON raw articles from a folder, one a line, each with the file it came from."""
    return (spark.readStream.schema(schemas.RAW_ARTICLE)
            .option("maxFilesPerTrigger", max_files)
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path).withColumn("source_file", F.col("_metadata.file_path")))


def coerce_articles(raw: DataFrame) -> DataFrame:
    """Strict shape first, legacy mapping otherwise: id, url, content, time, metadata."""
    meta = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("title", "feed_id", "feed_title", "author", "source")]),
        F.array(F.coalesce(F.col("title"), F.lit("")), F.col("feed_id").cast("string"), F.col("feed_title"),
                F.col("author"), F.col("source")))
    return raw.select(
        F.coalesce(F.col("id"), F.lit("unknown")).alias("id"),
        F.coalesce(F.col("source_url"), F.col("link"), F.lit("")).alias("source_url"),
        F.coalesce(F.col("content"), F.lit("")).alias("content"),
        it.coerce_timestamp(F.col("published_at")).alias("published_at"),
        F.coalesce(F.col("raw_metadata"), meta).alias("raw_metadata"),
        F.col("_corrupt_record"))


def enrich(articles: DataFrame, headline_terms: list[str] | None = None) -> DataFrame:
    """ST1 body: headline gate (F3), sentences, mentions, sentence scores, pairs, assembled per
    article (P15) -> ENRICHED shape."""
    a = articles.withColumn("title", F.element_at("raw_metadata", F.lit("title")))
    a = it.headline_filter(a, F.array(*map(F.lit, headline_terms or [])).cast("array<string>"))
    docs = a.select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    sents = tx.sentences(docs)
    ments = tx.mentions(sents)
    scored = tx.attach_scores(ments, tx.sentence_scores(ments, sents))
    pairs = co.cooccurrence_pairs(scored.withColumnRenamed("doc_id", "article_id"))
    ent = scored.groupBy("doc_id").agg(F.collect_list(F.struct(
        F.col("entity").alias("text"), "type", "sentence", "sentiment_score", "confidence",
        F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"))).alias("entities"))
    pr = pairs.groupBy(F.col("article_id").alias("doc_id")).agg(F.collect_list(F.struct(
        "entity_1", "entity_2", F.col("count").cast("int").alias("count"))).alias("co_occurrence_pairs"))
    out = docs.select("doc_id").join(ent, "doc_id", "left").join(pr, "doc_id", "left")
    return out.select(F.col("doc_id").alias("article_id"), F.current_timestamp().alias("processed_at"),
                      F.coalesce("entities", F.array().cast(schemas.ENRICHED["entities"].dataType)).alias("entities"),
                      F.coalesce("co_occurrence_pairs", F.array().cast(schemas.ENRICHED["co_occurrence_pairs"].dataType))
                      .alias("co_occurrence_pairs"))


def _source_position(raw: DataFrame, source: str) -> list:
    """The dead letter's first columns: partition and offset where the source has them, the file where it is one."""
    def of(name, kind):
        return F.col(name).cast(kind) if name in raw.columns else F.lit(None).cast(kind)
    return [F.unix_millis(F.current_timestamp()).alias("failed_at"), F.lit(source).alias("source_topic"), of("partition", "int").alias("source_partition"),
            of("offset", "long").alias("source_offset"), of("source_file", "string").alias("source_file")]


def dead_letters(raw: DataFrame, source: str) -> DataFrame:
    """Records that failed to parse, with error detail and source position."""
    bad = raw.filter(F.col("_corrupt_record").isNotNull())
    return bad.select(*_source_position(raw, source),
                      F.lit("unknown").alias("article_id"), F.lit("ParseError").alias("error_type"),
                      F.lit("malformed record").alias("error_message"), F.lit("").alias("stack_trace"),
                      F.col("_corrupt_record").alias("raw_value"))


def extract_records(raw: DataFrame, extract: Callable[[str, str], list[dict]], source: str) -> DataFrame:
    """``extract(title, content)`` on each parsed record by itself -> the dead letter's columns and ``entities``.

    A record whose extraction raises gets its error type, message and trace and no entities; the others of the batch go
    on. Entities are dictionaries of ``schemas.MENTION``'s fields; fields left out are null.
    """
    fields = [f.name for f in schemas.MENTION]
    good = raw.filter(F.col("_corrupt_record").isNull())
    value = F.to_json(F.struct(*[c for c in schemas.RAW_ARTICLE.names if c != "_corrupt_record"]))
    rows = good.select(*_source_position(raw, source), F.coalesce("id", F.lit("unknown")).alias("article_id"), value.alias("raw_value"),
                       F.coalesce("title", F.element_at("raw_metadata", F.lit("title")), F.lit("")).alias("_title"),
                       F.coalesce("content", F.lit("")).alias("_content"))
    out = rows.drop("_title", "_content").schema
    for name in ("error_type", "error_message", "stack_trace"):
        out = out.add(name, "string")
    out = out.add("entities", schemas.ENRICHED["entities"].dataType)

    def run(batches):
        for batch in batches:
            found = []
            for title, content in zip(batch["_title"], batch["_content"]):
                try:
                    found.append((None, None, None, [{f: m.get(f) for f in fields} for m in extract(title, content)]))
                except Exception as e:  # one bad record is a dead letter, not the end of its batch
                    found.append((type(e).__name__, str(e), traceback.format_exc(), None))
            batch = batch.drop(columns=["_title", "_content"])
            for i, name in enumerate(("error_type", "error_message", "stack_trace", "entities")):
                batch[name] = [f[i] for f in found]
            yield batch

    return rows.mapInPandas(run, out)


def enrich_extracted(done: DataFrame) -> DataFrame:
    """ST1 body for ``extract_records``: its records without an error -> ENRICHED shape, pairs by the sentences that mentions share."""
    good = done.filter("error_type is null")
    m = good.select("article_id", F.explode("entities").alias("e")).select(
        "article_id", F.xxhash64("e.sentence").alias("sent_idx"), F.col("e.text").alias("entity")).filter("entity is not null")
    pairs = co.cooccurrence_pairs(m).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct(
        "entity_1", "entity_2", F.col("count").cast("int").alias("count")))).alias("co_occurrence_pairs"))
    return good.join(pairs, "article_id", "left").select(
        "article_id", F.current_timestamp().alias("processed_at"), "entities",
        F.coalesce("co_occurrence_pairs", F.array().cast(schemas.ENRICHED["co_occurrence_pairs"].dataType)).alias("co_occurrence_pairs"))


def start_enrichment(raw: DataFrame, out_path: str, dlq_path: str, checkpoint: str, headline_terms=None,
                     extract: Callable[[str, str], list[dict]] | None = None):
    """ST1: raw -> enriched + DLQ; both writes happen inside one batch, idempotent per batch_id. With ``extract``, a model's
    extraction record by record in place of the built-in one; a record that it fails on is a dead letter (S8)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        failed = dead_letters(batch, "raw_ingestion")
        parsed = batch.filter(F.col("_corrupt_record").isNull())
        if extract is None:
            enriched = enrich(coerce_articles(parsed), headline_terms)
        else:
            terms = F.array(*map(F.lit, headline_terms or [])).cast("array<string>")
            chosen = it.headline_filter(parsed.withColumn("_head", F.coalesce("title", F.element_at("raw_metadata", F.lit("title")), F.lit(""))), terms, "_head")
            done = materialize(extract_records(chosen.drop("_head"), extract, "raw_ingestion"), "extracted")
            enriched = enrich_extracted(done)
            failed = failed.unionByName(done.filter("error_type is not null").select(failed.columns))
        enriched.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        failed.write.mode("overwrite").parquet(f"{dlq_path}/batch_id={batch_id}")
        batch.unpersist()
    return raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def enriched_to_mentions(enriched: DataFrame) -> DataFrame:
    """Flatten enriched results back to mention rows (article order = processing time, id)."""
    m = enriched.select("article_id", "processed_at", F.posexplode("entities").alias("ord", "e"))
    return m.select(F.col("article_id"), F.col("processed_at").cast("timestamp_ntz").alias("ts"),
                    F.col("e.text").alias("entity"), F.coalesce(F.col("e.type"), F.lit("")).alias("etype"),
                    F.col("e.sentiment_score").alias("score"), F.col("ord"))


def enriched_to_pairs(enriched: DataFrame) -> DataFrame:
    """The pairs that enriched results give, in the order of each result."""
    p = enriched.select("article_id", "processed_at", F.posexplode("co_occurrence_pairs").alias("ord", "p"))
    return p.select("article_id", F.col("processed_at").cast("timestamp_ntz").alias("ts"), "p.entity_1", "p.entity_2", "p.count", "ord")


def start_graph_deltas(enriched_stream: DataFrame, state_path: str, checkpoint: str, **held):
    """ST2: enriched batches -> change events. Each batch is folded, with the pairs it gives, onto the graph held under
    ``state_path`` (``HeldGraph``), which keeps the change rows of every version; a replayed batch changes nothing."""
    def run(batch: DataFrame, batch_id: int) -> None:
        graph = HeldGraph(batch.sparkSession, state_path, **held)
        batch = batch.persist()
        graph.apply(batch_id, enriched_to_mentions(batch), ["ord"], pairs=enriched_to_pairs(batch))
        batch.unpersist()
    return enriched_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def start_metrics(enriched_stream: DataFrame, state_path: str, checkpoint: str, **rule):
    """ST3: enriched batches -> metrics (``HeldMetrics``), over a held graph of its own; a replayed batch changes nothing."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        mentions, pairs = enriched_to_mentions(batch), enriched_to_pairs(batch)
        graph = HeldGraph(batch.sparkSession, f"{state_path}/graph")
        graph.apply(batch_id, mentions, ["ord"], pairs=pairs)
        HeldMetrics(graph, f"{state_path}/metrics", **rule).apply(batch_id, mentions, pairs)
        batch.unpersist()
    return enriched_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def change_event_stream(spark: SparkSession, path: str, max_files: int = 25) -> DataFrame:
    """Nested change events as JSON files."""
    return spark.readStream.schema(schemas.CHANGE_EVENT).option("maxFilesPerTrigger", max_files).json(path)


def start_history(changes: DataFrame, path: str, checkpoint: str, **rule):
    """ST4: change events -> stored history with snapshots (``StoredHistory``); events without a time or an article are
    not stored, and a replayed batch changes nothing."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.filter("timestamp is not null and article_id is not null").persist()
        StoredHistory(batch.sparkSession, path, **rule).append(batch_id, *flatten_changes(batch))
        batch.unpersist()
    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def hourly_counts(events: DataFrame, key: str = "entity", ts: str = "ts", delay: str = "30 minutes") -> DataFrame:
    """ST7 windowed form: mentions per key per hour with a watermark bounding the state."""
    return (events.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour"), key)
            .agg(F.count(F.lit(1)).alias("mentions")))


HOUR_US = 3_600_000_000


def _rolling_key(span: int):
    import numpy as np
    import pandas as pd

    def step(key, batches, state):
        stored = state.get if state.exists else (b"", b"", b"", 0)
        own, ids, before = ([np.frombuffer(x, np.int64)] for x in stored[:3])
        done = stored[3]  # so many of the own sightings, the earliest, are already out
        for batch in batches:
            now = batch["kind"].to_numpy() == 0
            own.append(batch["us"].to_numpy(np.int64)[now])
            ids.append(batch["id"].to_numpy(np.int64)[now])
            before.append(batch["us"].to_numpy(np.int64)[~now])
        own, ids, before = (np.concatenate(x) for x in (own, ids, before))
        order = np.lexsort((ids, own))
        own, ids, before = own[order], ids[order], np.sort(before)
        watermark, end = state.getCurrentWatermarkMs() * 1000, (int(key[1]) + 1) * span
        ready = int(np.searchsorted(own, watermark))  # earlier than the watermark: no more of these come
        if ready > done:
            t = own[done:ready]
            # of the span before: the own ones are all in this part, the others in the part before
            count = np.arange(done + 1, ready + 1) - np.searchsorted(own, t - span) + len(before) - np.searchsorted(before, t - span)
            yield pd.DataFrame({"key": key[0], "ts": pd.to_datetime(t, unit="us"), "id": ids[done:ready], "mentions": count})
        if watermark > end:
            state.remove()
        else:
            state.update((own.tobytes(), ids.tobytes(), before.tobytes(), ready))
            wait = int(own[ready]) if ready < len(own) else end
            state.setTimeoutTimestamp(max(wait, watermark) // 1000 + 1)

    return step


def rolling_hours(events: DataFrame, key: str = "entity", ts: str = "ts", tiebreak: str = "event_id", delay: str = "30 minutes") -> DataFrame:
    """ST7: (key, ts, id, mentions): each sighting with the number of its key's sightings in the hour up to it, both ends
    counted, itself the last of its instant (order ``tiebreak``, a long); equal to ``windows.rolling_hour_count``.

    Keyed state with event-time timers over (key, hour): a sighting goes to its own hour and, as one before, to the next,
    so a hot key's state is two hours of sightings, ends with its hour, and hours of one key lie in different tasks. A row
    comes out once the watermark has passed it. Sightings without a key or a time are left out.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("t", F.col(ts).cast("timestamp")).withWatermark("t", delay)
    rows = rows.select("t", F.col(key).cast("string").alias("key"), F.col(tiebreak).cast("long").alias("id"), us.alias("us"),
                       F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"))
    rows = rows.withColumn("part", F.floor(F.col("us") / F.lit(HOUR_US)).cast("long") + F.col("kind"))
    return rows.groupBy("key", "part").applyInPandasWithState(
        _rolling_key(HOUR_US), "key string, ts timestamp, id long, mentions long", "own binary, ids binary, before binary, done long",
        "append", "EventTimeTimeout")


CORRELATED = "article_id string, t_raw timestamp, t_enriched timestamp, t_change timestamp, timeout_step string"


def _hop(times: list[int], start: int, limit: int, watermark: int) -> tuple[int | None, int | None]:
    """(first time in [start, start + limit], None) once no earlier one can come, (None, None) once none can come at all,
    else (None, the time that the watermark has to pass)."""
    inside = [t for t in times if start <= t <= start + limit]
    until = min(inside) if inside else start + limit
    return (None, until) if watermark <= until else (until if inside else None, None)


def _correlate_key(limit: int):
    import pandas as pd

    def step(key, batches, state):
        raws, enriched, changes = (json.loads(x) for x in state.get) if state.exists else ([], [], [])
        kinds = {"raw": raws, "enriched": enriched, "change": changes}
        for batch in batches:
            for kind, t in zip(batch["kind"], batch["us"]):
                kinds[kind].append(int(t))
        watermark = state.getCurrentWatermarkMs() * 1000
        out, wait = None, None
        if raws:
            start = min(raws)
            second, wait = _hop(enriched, start, limit, watermark)
            if wait is None and second is None:
                out = (start, None, None, "step2")
            elif wait is None:
                third, wait = _hop(changes, second, limit, watermark)
                if wait is None:
                    out = (start, second, third, "step3" if third is None else None)
        else:  # what came before its raw record, which may still come while the watermark has not passed it
            wait = max(enriched + changes)
            wait = wait if watermark <= wait else None
        if wait is None:
            state.remove()
        else:
            state.update(tuple(json.dumps(kinds[k]) for k in ("raw", "enriched", "change")))
            state.setTimeoutTimestamp(max(wait // 1000, watermark // 1000) + 1)
        if out is not None:
            row = {"article_id": [key[0]], **{n: pd.to_datetime([t], unit="us") for n, t in zip(("t_raw", "t_enriched", "t_change"), out)}, "timeout_step": [out[3]]}
            yield pd.DataFrame(row)

    return step


def correlate(raw: DataFrame, enriched: DataFrame, changes: DataFrame, timeout_s: int = CORRELATION_TIMEOUT_SECONDS,
              delay: str = "45 seconds") -> DataFrame:
    """J6/ST6: the first enriched result within ``timeout_s`` of the raw record, then the first change within ``timeout_s`` of that
    result -> one row per article, with the step at which it timed out.

    Keyed state with event-time timers: a hop is decided once the watermark (``delay`` behind each stream's newest
    record, the slowest stream counts) has passed its first match, or its limit. An article that timed out at step 2 takes no change.
    State holds one article's times and goes with its row; results whose raw record never comes go with the watermark.
    """
    def side(df: DataFrame, id_col: str, ts: str, kind: str) -> DataFrame:
        return df.select(F.col(id_col).alias("article_id"), F.lit(kind).alias("kind"), F.col(ts).alias("t")) \
            .filter("article_id is not null and t is not null").withWatermark("t", delay)

    rows = side(raw, "id", "t_raw", "raw").unionByName(side(enriched, "article_id", "t_enriched", "enriched")) \
        .unionByName(side(changes, "article_id", "t_change", "change")).withColumn("us", F.unix_micros("t"))
    return rows.groupBy("article_id").applyInPandasWithState(
        _correlate_key(timeout_s * 1_000_000), CORRELATED, "raw string, enriched string, change string", "append", "EventTimeTimeout")
