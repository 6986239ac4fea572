"""Priority topics against a sequential replay, headline dumps, article progress, entity views."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mentiongraph.operators import correlate as cr
from mentiongraph.operators import intake as it
from mentiongraph.operators.priority import PriorityTopics

START = datetime(2024, 1, 1)


def replay(requests, ttl, most):
    held = {}
    for key, topic, t in sorted(requests, key=lambda r: r[2]):
        topic = " ".join(topic.split()).lower()
        if topic:
            items = [x for x in held.get(key, []) if x[1] != topic] + [(t, topic)]
            items = sorted((x for x in items if x[0] >= t - ttl), key=lambda x: (-x[0], x[1]))
            held[key] = items[:most]
    return {k: [(topic, t) for t, topic in v] for k, v in held.items()}


def test_priority_topics_equal_a_replay(spark, tmp_path):
    rng = random.Random(7)
    names = ["Oil ", " oil", "RAIN", "rain\tfall", "tea", "  ", "War", "sun", "sea"]
    requests = [(rng.choice("abc"), rng.choice(names), i * rng.choice([3, 5])) for i in range(120)]
    requests.sort(key=lambda r: r[2])
    store = PriorityTopics(spark, str(tmp_path / "p"), ttl_seconds=60, max_topics=3, compact_every=2)
    for b in range(4):
        rows = [(k, x, (START + timedelta(seconds=t)).isoformat() + "Z") for k, x, t in requests[30 * b:30 * b + 30]]
        frame = spark.createDataFrame(rows + [("a", "late", "no time"), (None, "x", rows[0][2])], "key string, topic string, requested_at string")
        store.register(b, frame)
        store.register(b, frame)  # a replayed batch
    got = {}
    for r in store.topics().orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append((r.topic, int((r.requested_at - START).total_seconds())))
    assert got == replay(requests, 60, 3) and store.tables.newest().version == 4
    last = max(t for _, _, t in requests)
    now = START + timedelta(seconds=last + 40)
    late = {(r.key, r.topic) for r in store.topics(now.isoformat()).collect()}
    assert late == {(k, x) for k, v in got.items() for x, t in v if t >= last - 20}
    terms = spark.createDataFrame([("a", 0, got["a"][0][0].upper()), ("a", 1, "News"), ("a", 2, "news")], "key string, pos int, term string")
    queries = [r.term for r in store.queries(terms).filter("key = 'a'").orderBy("rank").collect()]
    assert queries == [x for x, _ in got["a"]] + ["News"]


def test_headline_dumps(spark):
    good = {"seq": 0, "status": 0, "content": [{"id": 7, "title": "T", "feed_id": 2, "updated": 1700000000, "more": 1}, {"id": 8}]}
    dumps = [good, {"status": 0, "content": []}, {"status": 1, "content": {"error": "NOT_LOGGED_IN"}}, {"status": 1, "content": {"error": "X"}},
             {"status": 0, "content": {"error": "odd"}}, {"seq": 4}]
    texts = [(i, json.dumps(d)) for i, d in enumerate(dumps)] + [(9, "{no json"), (10, None)]
    rows, errors = it.headlines(spark.createDataFrame(texts, "dump int, value string"))
    assert [(r.dump, r.id, r.title, r.feed_id) for r in rows.orderBy("id").collect()] == [(0, 7, "T", 2), (0, 8, None, None)]
    assert {(r.dump, r.error) for r in errors.collect()} == {(2, "not_logged_in"), (3, "fetch_failed"), (4, "malformed"), (5, "malformed"),
                                                            (9, "malformed"), (10, "malformed")}
    articles = {r.id: r for r in it.normalise_rss(rows).collect()}
    assert articles[7].published_at.year == 2023 and articles[8].title == "" and articles[8].feed_id == 0


def test_article_progress_and_stream(spark, tmp_path):
    rows = [("b", "step1", 1, "T1", 5.0), ("a", "step1", 2, "", 0.0), ("", "step1", 3, "x", 0.0), ("b", "status", 4, "no", 0.0), (None, "step2", 5, "x", 0.0),
            ("b", "step1", 6, "", 6.0), ("b", "timeout", 7, None, 7.0), ("c", "odd", 8, None, 0.0), ("a", "error", 9, None, 9.0), ("a", "error", 10, None, 1.0)]
    schema = "article_id string, type string, seq long, title string, v double"
    got = {r.article_id: r for r in cr.article_progress(spark.createDataFrame(rows, schema), "seq", "title").collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["b"].title == "T1" and got["b"].step1.v == 6.0 and got["b"].timeout.seq == 7 and got["b"].step2 is None and got["b"].first_order == 1
    assert got["a"].title is None and got["a"].error.v == 1.0 and got["c"].first_order == 8 and got["c"].step1 is None
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = cr.article_progress(stream, "seq", "title").writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    assert {r.article_id: r for r in spark.sql("select * from progress").collect()} == got


def test_entity_view(spark):
    row = spark.sql("select array(named_struct('text', 'Anna', 'type', 'PERSON', 'sentence', concat('a\\\\nb', repeat('x', 200)), 'sentiment_score', 0.5D, "
                    "'confidence', cast(null as double), 'char_start', 0, 'char_end', 4)) as e, cast(null as array<int>) as n")
    view = row.select(cr.entity_view(F.col("e")).alias("v")).first().v[0]
    assert view.sentence == "a b" + "x" * 117 and view.sentiment == 0.5 and view.confidence == 0.0


def test_processing_metrics(spark):
    from mentiongraph.operators.metrics import processing_metrics

    rows = [(10, "ok", 2.0), (20, "ok", 4.0), (30, "error", 9.0), (40, "skipped", 9.0), (50, None, None), (3_700, "skipped", 1.0), (9_000, "ok", 1.0)]
    events = spark.createDataFrame(rows, "s long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = [tuple(r) for r in processing_metrics(events, now=F.timestamp_seconds(F.lit(7_200))).orderBy("window_start").collect()]
    assert got == [(0, 3, 1, 1, round(3 / 3600, 6), 3.0, 7_150.0), (3_600, 0, 0, 1, 0.0, 0.0, 3_500.0), (7_200, 1, 0, 0, round(1 / 3600, 6), 1.0, 0.0)]
