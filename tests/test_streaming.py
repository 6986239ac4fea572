"""Batch vs stream equality for the watermarked hourly count and a foreachBatch hop."""

import json

from pyspark.sql import functions as F

from mentiongraph.operators.held_graph import HeldGraph
from mentiongraph.streaming import pipelines as pl

SF = "/root/testdata/sf0.001"


def test_hourly_counts_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    schema = ev.schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(SF))
    s = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("entity"))
    q = (pl.hourly_counts(s).writeStream.outputMode("append").format("memory").queryName("hc")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start, r.entity): r.mentions for r in spark.sql("SELECT * FROM hc").collect()}
    b = ev.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("entity"))
    exp = {(r.window.start, r.entity): r.mentions for r in
           b.groupBy(F.window("ts", "1 hour"), "entity").agg(F.count(F.lit(1)).alias("mentions")).collect()}
    # append mode emits a window once the watermark passes it; all emitted windows must be exact
    assert got and all(exp[k] == v for k, v in got.items())


def test_enrich_batch_shape(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    raw = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("source_url"),
                      F.lit("http://x").alias("link"), F.lit("t").alias("title"), F.col("text").alias("content"),
                      F.lit("1700000000").alias("published_at"), F.lit(1).cast("long").alias("feed_id"),
                      F.col("source").alias("feed_title"), F.lit(None).cast("string").alias("author"),
                      F.array(F.col("lang")).alias("tags"), F.col("source"),
                      F.lit(None).cast("map<string,string>").alias("raw_metadata"),
                      F.lit(None).cast("string").alias("_corrupt_record"))
    out = pl.enrich(pl.coerce_articles(raw)).collect()
    assert len(out) == 5 and all(r.entities is not None for r in out)


def test_graph_deltas_keep_the_given_pairs(spark, tmp_path):
    """Given pairs of records of three mentions, in two batches; the second names an entity that only the first mentions."""
    from mentiongraph.sources import schemas

    def record(article, second, names, pairs):
        entities = [{"text": n, "type": "PERSON", "sentiment_score": x} for n, x in names]
        return {"article_id": article, "processed_at": f"2024-01-01T00:00:0{second}.000Z", "entities": entities,
                "co_occurrence_pairs": [{"entity_1": a, "entity_2": b, "count": n} for a, b, n in pairs]}

    records = [record("a", 1, [("Anna", 1.0), ("Bob", 0.0), ("Carl", 0.5)], [("Carl", "Anna", 2), ("Bob", "Nobody", 1)]),
               record("b", 2, [("Bob", 0.0)], [("Bob", "Anna", 3), ("Anna", "Bob", 1)])]
    stream = None
    for i, r in enumerate(records):
        spark.createDataFrame([json.dumps(r)], "string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        stream = spark.readStream.schema(schemas.ENRICHED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = pl.start_graph_deltas(stream, str(tmp_path / "state"), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
    held = HeldGraph(spark, str(tmp_path / "state"))
    edges = {(r.article_id, r.source, r.target): r for r in held.changes("relationships").collect()}
    assert set(edges) == {("a", "Anna", "Carl"), ("b", "Anna", "Bob")}
    assert edges["a", "Anna", "Carl"].new_strength == 2.0 and edges["a", "Anna", "Carl"].new_joint_sentiment == 0.75
    assert edges["b", "Anna", "Bob"].new_strength == 2.9 and edges["b", "Anna", "Bob"].new_joint_sentiment == 0.5
    entities = {(r.article_id, r.entity_id): r for r in held.changes("entities").collect()}
    assert set(entities) == {("a", "Anna"), ("a", "Bob"), ("a", "Carl"), ("b", "Bob")}
    assert entities["b", "Bob"].old_mentions == 1 and entities["b", "Bob"].new_centrality == 0.5


def test_correlation_stream_equals_batch(spark, tmp_path):
    """Each hop has its own 45 s; time-outs come once; nothing follows a step-2 time-out; a result may arrive before its raw record."""
    from mentiongraph.operators.correlate import correlate_stages

    raw = [("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 3), ("f", 2)]
    enriched = [("a", 10), ("b", 46), ("c", 40), ("d", 5), ("e", 3), ("e", 30), ("f", 47), ("lost", 9)]
    changes = [("a", 20), ("b", 50), ("c", 60), ("d", 51), ("e", 48), ("e", 40), ("f", 92), ("f", 93)]
    want = {("a", 10, 20, None), ("b", None, None, "step2"), ("c", 40, 60, None), ("d", 5, None, "step3"), ("e", 3, 40, None), ("f", 47, 92, None)}

    def write(name, rows):
        cols = ("id" if name == "raw" else "article_id", f"t_{name}")
        spark.createDataFrame([(a, 1_700_000_000 + t) for a, t in rows], f"{cols[0]} string, s long").select(
            cols[0], F.timestamp_seconds("s").alias(cols[1])).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return spark.readStream.schema(f"{cols[0]} string, {cols[1]} timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    sides = {"raw": raw, "enriched": enriched, "change": changes}
    for part in (lambda r: r[1] < 20, lambda r: 20 <= r[1] < 70, lambda r: r[1] >= 70):
        streams = [write(n, [r for r in rows if part(r)] or [("none", 1)]) for n, rows in sides.items()]
        q = (pl.correlate(*streams, delay="30 seconds").writeStream.outputMode("append").format("parquet")
             .option("checkpointLocation", str(tmp_path / "ck")).start(str(tmp_path / "out")))
        q.processAllAvailable()
        q.stop()
    for t in (400, 900):  # later records move the watermark on
        streams = [write(n, [(f"end{t}", t)]) for n in sides]
        q = (pl.correlate(*streams, delay="30 seconds").writeStream.outputMode("append").format("parquet")
             .option("checkpointLocation", str(tmp_path / "ck")).start(str(tmp_path / "out")))
        q.processAllAvailable()
        q.stop()
    rows = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.article_id in "abcdef"]
    sec = lambda t: None if t is None else int(t.timestamp()) - 1_700_000_000
    assert len(rows) == 6 and {(r.article_id, sec(r.t_enriched), sec(r.t_change), r.timeout_step) for r in rows} == want

    frame = lambda name, rows, more="": spark.createDataFrame(rows, f"article_id string, s long").select(
        "article_id", F.timestamp_seconds("s").alias(name), *[F.lit(0).cast("double" if c == "mean_sentiment" else "long").alias(c) for c in more.split()])
    batch = correlate_stages(frame("t_raw", raw), frame("t_enriched", enriched, "mean_sentiment"), frame("t_change", changes, "node_count edge_count"))
    assert {(r.article_id, r.step2, r.step3, r.timeout_step) for r in batch.collect()} == {(a, e is not None, c is not None, s) for a, e, c, s in want}


def test_rolling_hours_stream_equals_batch(spark, tmp_path):
    """Sightings out of order inside a batch, at one instant, and exactly an hour apart; the last record moves the watermark past all."""
    from mentiongraph.operators.windows import rolling_hour_count

    start = 1_704_067_200 + 1_800
    seen = [("a", s) for s in (0, 0, 10, 1_799, 1_800, 3_600, 3_601, 5_400, 5_400, 7_199, 9_001)] + [("b", s) for s in (5, 3_605, 3_606, 20_000)]
    rows = [(i, k, start + s) for i, (k, s) in enumerate(seen)]
    late = [(100, "end", start + 90_000)]

    def frame(part):
        return spark.createDataFrame(part, "event_id long, entity string, s long").select("event_id", "entity", F.timestamp_seconds("s").alias("ts"))

    for part in ([r for r in rows if r[2] < start + 3_601][::-1], [r for r in rows if r[2] >= start + 3_601], late):
        frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("event_id long, entity string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = (pl.rolling_hours(stream, delay="10 minutes").writeStream.outputMode("append").format("parquet")
             .option("checkpointLocation", str(tmp_path / "ck")).start(str(tmp_path / "out")))
        q.processAllAvailable()
        q.stop()
    got = sorted((r.key, r.ts, r.id, r.mentions) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = rolling_hour_count(frame(rows), "entity", "ts", "event_id", "mentions").collect()
    assert got == sorted((r.entity, r.ts, r.event_id, r.mentions) for r in want)


def test_metrics_stream_equals_a_sequence(spark, tmp_path):
    """Ranks after each of three articles, one a batch, equal those of an update in plain Python; a replayed batch changes nothing."""
    from mentiongraph.operators.held_metrics import HeldMetrics
    from mentiongraph.sources import schemas

    articles = [("a", ["A", "B", "C"], [("A", "B"), ("B", "C"), ("A", "nobody")]), ("b", ["D", "E", "F", "G"], [("D", "C"), ("E", "D"), ("F", "E"), ("G", "F")]),
                ("c", ["A"], [("A", "A"), ("A", "G")])]
    rank, near_of = {}, {}
    metrics = None
    for i, (article, names, pairs) in enumerate(articles):
        record = {"article_id": article, "processed_at": f"2024-01-01T00:00:0{i}.000Z",
                  "entities": [{"text": n, "type": "X", "sentiment_score": 0.5} for n in names],
                  "co_occurrence_pairs": [{"entity_1": a, "entity_2": b, "count": 1} for a, b in pairs]}
        spark.createDataFrame([json.dumps(record)], "string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        stream = spark.readStream.schema(schemas.ENRICHED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = pl.start_metrics(stream, str(tmp_path / "state"), str(tmp_path / "ck"), iterations=4, samples=2)
        q.processAllAvailable()
        q.stop()

        touched = set(names)
        for n in names:
            near_of.setdefault(n, set())
        for a, b in pairs:
            if a != b and a in near_of and b in near_of:
                near_of[a].add(b)
                near_of[b].add(a)
                touched |= {a, b}
        near = set(touched)
        for _ in range(2):
            near |= {x for n in near for x in near_of[n]}
        pr = {n: rank.get(n) or 1 / len(near) for n in near}
        for _ in range(4):
            pr = {n: 0.15 / len(near) + sum(0.85 * pr[x] / len(near_of[x] & near) for x in near_of[n] & near) for n in near}
        rank.update({n: x / sum(pr.values()) for n, x in pr.items()})

        metrics = HeldMetrics(HeldGraph(spark, str(tmp_path / "state/graph")), str(tmp_path / "state/metrics"))
        got = {r.node: r.pagerank for r in metrics.ranks().collect()}
        assert set(got) == set(rank) and all(abs(got[n] - rank[n]) < 1e-12 for n in rank)
        assert {r.node for r in metrics.touched().filter(F.col("version") == i + 1).collect()} == touched
    row = metrics.rows().orderBy(F.desc("version")).first()
    assert (row.updates_processed, row.node_count, row.edge_count, row.n_touched) == (3, 7, 7, 2)
    assert [r.node for r in row.top_pagerank] == sorted(rank, key=lambda n: (-rank[n], n)) or len(set(round(x, 9) for x in rank.values())) < len(rank)
    before = metrics.ranks().collect()
    empty = spark.createDataFrame([], "article_id string, ts timestamp_ntz, entity string")
    metrics.apply(2, empty, spark.createDataFrame([], "entity_1 string, entity_2 string"))
    assert sorted(metrics.ranks().collect()) == sorted(before) and metrics.tables.newest().version == 3


def test_a_failing_record_is_a_dead_letter(spark, tmp_path):
    """A malformed line and a record on which the extraction raises leave the others of their batch enriched."""
    def extract(title, content):
        if "poison" in content:
            raise ValueError(f"cannot read {title}")
        return [{"text": w, "type": "X", "sentence": s, "sentiment_score": 0.5} for s in content.split(".") for w in s.split()]

    lines = [json.dumps({"id": "a", "title": "One oil", "content": "Anna Bob. Carl"}), "{broken", json.dumps({"id": "b", "title": "Two OIL", "content": "poison"}),
             json.dumps({"id": "c", "title": "Three", "content": "poison"}), json.dumps({"id": "d", "raw_metadata": {"title": "oil"}, "content": None})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(lines))
    raw = pl.raw_article_stream(spark, str(tmp_path / "in"))
    for name, more in (("model", {"extract": extract}), ("built", {})):
        q = pl.start_enrichment(raw, str(tmp_path / name), str(tmp_path / f"{name}-dlq"), str(tmp_path / f"{name}-ck"), ["oil"], **more)
        q.processAllAvailable()
        q.stop()
    rows = {r.article_id: r for r in spark.read.parquet(str(tmp_path / "model")).collect()}
    assert set(rows) == {"a", "d"} and [e.text for e in rows["a"].entities] == ["Anna", "Bob", "Carl"] and rows["d"].entities == []
    assert [(p.entity_1, p.entity_2, p["count"]) for p in rows["a"].co_occurrence_pairs] == [("Anna", "Bob", 1)]
    bad = {r.article_id: r for r in spark.read.parquet(str(tmp_path / "model-dlq")).collect()}
    assert {k: v.error_type for k, v in bad.items()} == {"unknown": "ParseError", "b": "ValueError"}
    assert bad["b"].error_message == "cannot read Two OIL" and "extract" in bad["b"].stack_trace and json.loads(bad["b"].raw_value)["content"] == "poison"
    assert all(r.source_file.endswith("x.json") for r in bad.values())
    assert {r.article_id for r in spark.read.parquet(str(tmp_path / "built")).collect()} == {"a", "b", "d"}
    assert [r.raw_value for r in spark.read.parquet(str(tmp_path / "built-dlq")).collect()] == ["{broken"]
