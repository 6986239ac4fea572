"""Hand-checked micro fixtures (FIXTURES.md part A) and brute-force comparisons."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mentiongraph.functions.scan import ewma_scan, positions
from mentiongraph.operators import cooccurrence as co
from mentiongraph.operators import graph_algo as ga
from mentiongraph.operators import graph_state as gs
from mentiongraph.operators import history as hs
from mentiongraph.operators import intake as it
from mentiongraph.operators import text as tx
from mentiongraph.operators import windows as win

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _mentions(spark, rows):
    """rows: (article_id, ts, entity, sent_idx, score, start)."""
    return spark.createDataFrame(
        [(a, t, e, "PERSON", s, sc, st) for a, t, e, s, sc, st in rows],
        "article_id long, ts timestamp_ntz, entity string, etype string, sent_idx int, score double, char_start int")


def test_cooccurrence_fixture_18(spark):
    m = _mentions(spark, [(1, T0, "A", 0, 0.0, 0), (1, T0, "B", 0, 0.0, 5), (1, T0, "B", 1, 0.0, 10), (1, T0, "C", 1, 0.0, 15)])
    got = {(r.entity_1, r.entity_2): r["count"] for r in co.cooccurrence_pairs(m).collect()}
    assert got == {("A", "B"): 2, ("B", "C"): 2, ("A", "C"): 1}


def test_ewma_scan_matches_sequential_fold(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    for key in ("k1", "k2", "k3"):
        x = None
        for k in range(1, 301):
            v = rnd.choice([-1.0, -0.4, 0.0, 0.2, 0.8, 1.0])
            x = v if x is None else 0.95 * x + 0.05 * v
            rows.append((key, k, v))
            expect[(key, k)] = x
    df = spark.createDataFrame(rows, "key string, k long, v double")
    got = ewma_scan(df, ["key"], "k", [("v", "x")]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.x - expect[(r.key, r.k)]) < 1e-12


def test_positions_two_level(spark):
    rows = [("a", d, i) for d in range(5) for i in range(7)] + [("b", 3, 1)]
    df = spark.createDataFrame(rows, "key string, day int, i int")
    got = sorted((r.key, r.day, r.i, r.p) for r in positions(df, ["key"], ["day", "i"], ["day"], "p").collect())
    a = [r for r in got if r[0] == "a"]
    assert [r[3] for r in a] == list(range(1, 36))
    assert [r[3] for r in got if r[0] == "b"] == [1]


def test_graph_fold_fixture_1(spark):
    m = _mentions(spark, [(1, T0, "Alice", 0, 1.0, 0), (1, T0, "Bob", 0, 1.0, 10),
                          (2, T0, "Alice", 0, -1.0, 0), (2, T0, "Bob", 0, -1.0, 10)])
    fold = gs.fold_graph(m, ["sent_idx", "char_start"])
    ents = {(r.article_id, r.entity_id): r for r in gs.entity_changes(fold).collect()}
    e1 = ents[(1, "Alice")]
    assert (e1.old_mentions, e1.new_mentions, e1.old_sentiment, e1.new_sentiment) == (0, 1, 0.0, 1.0)
    assert (e1.old_centrality, e1.new_centrality) == (0.0, 1.0)
    e2 = ents[(2, "Alice")]
    assert e2.new_mentions == 2 and abs(e2.new_sentiment - 0.9) < 1e-9 and e2.new_centrality == 1.0
    rels = gs.edge_changes(fold).collect()
    assert len(rels) == 1 and rels[0].article_id == 1
    assert (rels[0].old_strength, rels[0].new_strength, rels[0].new_joint_sentiment) == (0.0, 1.0, 1.0)
    edge = gs.edge_state(fold).collect()[0]
    assert edge.strength == 1.0 and abs(edge.joint_sentiment - 0.995) < 1e-9
    tot = {r.article_id: (r.node_count, r.edge_count) for r in fold.totals.collect()}
    assert tot == {1: (2, 1), 2: (2, 1)}
    val = gs.validate_changes(fold).collect()
    assert all(len(r.errors) == 0 for r in val)


def test_small_sentiment_change_still_reported_fixture_2(spark):
    m = _mentions(spark, [(1, T0, "Alice", 0, 0.0, 0), (1, T0, "Bob", 0, 0.0, 10),
                          (2, T0, "Alice", 0, 0.001, 0), (2, T0, "Bob", 0, 0.001, 10)])
    fold = gs.fold_graph(m, ["sent_idx", "char_start"])
    ch = [r for r in gs.entity_changes(fold).collect() if r.article_id == 2]
    assert len(ch) == 2 and all(abs(r.delta_sentiment - 0.00005) < 1e-9 for r in ch)


def test_relationship_strength_fixture_4(spark):
    m = _mentions(spark, [(1, T0, "A", 0, 0.1, 0), (1, T0, "B", 0, 0.2, 5),
                          (2, T0 + dt.timedelta(seconds=100), "A", 0, 0.2, 0),
                          (2, T0 + dt.timedelta(seconds=100), "B", 0, 0.3, 5)])
    fold = gs.fold_graph(m, ["sent_idx", "char_start"])
    r = ga.relationship_strength(fold).collect()[0]
    assert abs(r.strength - 1.898901) < 1e-6 and r.updates == 2
    adj = ga.adjacency(ga.relationship_strength(fold))
    pr = {x.node: x.pagerank for x in ga.pagerank(adj, adj.select(F.col("src").alias("node"))).collect()}
    assert abs(pr["A"] - 0.5) < 1e-9 and abs(pr["B"] - 0.5) < 1e-9


def test_chunks_fixture_19(spark):
    rows = []
    for doc, n in ((1, 20), (2, 9), (3, 8)):
        rows += [(doc, i, i * 10, i * 10 + 9, "x") for i in range(n)]
    s = spark.createDataFrame(rows, "doc_id long, sent_idx int, char_start int, char_end int, sentence string")
    got = {}
    for r in tx.chunks(s).collect():
        got.setdefault(r.doc_id, []).append((r.start_sentence, r.end_sentence))
    assert sorted(got[1]) == [(0, 7), (6, 13), (12, 19)]
    assert sorted(got[2]) == [(0, 7), (6, 8)]
    assert sorted(got[3]) == [(0, 7)]


def test_sentences_offsets(spark):
    d = spark.createDataFrame([(1, "One two. Three!  Four?\nFive")], "doc_id long, text string")
    got = [(r.sent_idx, r.char_start, r.char_end, r.sentence) for r in tx.sentences(d).orderBy("sent_idx").collect()]
    text = "One two. Three!  Four?\nFive"
    assert [text[a:b] for _, a, b, _ in got] == ["One two.", "Three!", "Four?", "Five"]


def test_signed_score_fixture_20(spark):
    df = spark.createDataFrame([("POSITIVE", 0.9), ("NEGATIVE", 0.8), ("OTHER", 0.7)], "label string, c double")
    got = [r.s for r in df.select(tx.signed_score(F.col("label"), F.col("c")).alias("s")).collect()]
    assert got == [0.9, -0.8, 0.0]


def test_post_title_fixture_22(spark):
    df = spark.createDataFrame([("a" * 121,), ("   ",), ("x  y\n z",)], "t string")
    got = [r.t for r in df.select(it.post_title(F.col("t")).alias("t")).collect()]
    assert got == ["a" * 117 + "...", "Bluesky post", "x y z"]


def test_post_normalise_fixture_10(spark):
    p = spark.createDataFrame(
        [("hello", "2024-05-01T10:00:00Z", "at://x/app.bsky.feed.post/abc", "https://bsky.app/profile/x/post/abc", None,
          ("alice.example", "Alice"), "election")],
        "text string, created_at string, uri string, web_url string, id string, "
        "author struct<handle:string,display_name:string>, query string")
    r = it.normalise_posts(p).collect()[0]
    assert r.source == "bluesky" and list(r.tags) == ["social media", "election"]
    assert r.author == "Alice" and r.link == "https://bsky.app/profile/x/post/abc"


def test_topic_terms_fixture_24(spark):
    assert spark.range(1).select(hs.topic_terms_col(F.lit("EU, vote! a 2024-x"))).first()[0] == ["vote", "2024-x"]


def test_topic_terms_column(spark):
    df = spark.createDataFrame([("EU, vote! a 2024-x",)], "t string")
    assert list(df.select(hs.topic_terms_col(F.col("t")).alias("x")).collect()[0].x) == ["vote", "2024-x"]


def test_term_dedupe_fixture_12(spark):
    df = spark.createDataFrame([(1, "Election, election ,, Vote,VOTE")], "k long, t string")
    got = [r.term for r in it.dedupe_terms(df, "k", "t").orderBy("pos").collect()]
    assert got == ["Election", "Vote"]


def test_rolling_hour_count_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        rows.append((i, rnd.randint(1, 4), T0 + dt.timedelta(seconds=rnd.randint(0, 5 * 3600))))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    got = {r.event_id: r.rate for r in win.rolling_hour_count(df, "user_id", "ts", "event_id", "rate").collect()}
    for eid, uid, ts in rows:
        exp = sum(1 for e2, u2, t2 in rows if u2 == uid and t2 >= ts - dt.timedelta(hours=1)
                  and (t2 < ts or (t2 == ts and e2 <= eid)))
        assert got[eid] == exp


def test_snapshot_schedule_fixture_23(spark):
    times = [T0 + dt.timedelta(seconds=i) for i in range(1, 151)] + [T0 + dt.timedelta(minutes=30)]
    ev = spark.createDataFrame([(i + 1, t) for i, t in enumerate(times)], "event_id long, event_time timestamp_ntz")
    got = sorted(r.snapshot_event_id for r in hs.snapshot_schedule(ev, every_n=100, every_minutes=10).collect())
    assert got == [1, 101, 151]


def test_html_text_fixture_14(spark):
    good = "<html><head><title>t</title></head><body><nav>menu</nav><p>" + "word " * 20 + "</p><table><tr><td>x</td></tr></table></body></html>"
    df = spark.createDataFrame([(good,), ("<p>short</p>",), (None,)], "h string")
    got = [r.t for r in df.select(tx.html_text(F.col("h"), F.lit("fallback")).alias("t")).collect()]
    assert got[0] == ("word " * 20).strip() and got[1] == "fallback" and got[2] == "fallback"


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and df.columns == ["entity_1", "entity_2", "total_count", "n_articles"]


def test_communities_two_triangles(spark):
    e = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("A", "C", 1.0), ("D", "E", 1.0), ("E", "F", 1.0),
                               ("D", "F", 1.0), ("C", "D", 0.1)], "source string, target string, strength double")
    nodes = spark.createDataFrame([(n,) for n in "ABCDEFG"], "node string")
    got = {r.node: r.community_id for r in ga.dense_community_ids(ga.communities(nodes, e)).collect()}
    assert got["A"] == got["B"] == got["C"] and got["D"] == got["E"] == got["F"] and got["A"] != got["D"]
    assert sorted(set(got.values())) == list(range(len(set(got.values()))))  # dense ids
    assert got["G"] not in (got["A"], got["D"])  # isolated node keeps its own community


@pytest.mark.parametrize("alpha", [0.001, 0.05, 0.3, 0.999999, 1.0])
def test_ewma_scan_keeps_all_history_at_any_alpha(spark, alpha):
    n = 9000
    value = [1.0 if k == 1 else ((k * 37) % 11 - 5) / 5.0 * (k > 6000) for k in range(1, n + 1)]
    rows = spark.createDataFrame([("hot", k, v) for k, v in enumerate(value, 1)] + [("one", 1, 0.5)], "key string, k long, v double")
    got = {r.k: r.x for r in ewma_scan(rows, ["key"], "k", [("v", "x")], alpha=alpha).where("key = 'hot'").collect()}
    x = value[0]
    for k, v in enumerate(value, 1):
        x = x if k == 1 else (1 - alpha) * x + alpha * v
        assert abs(got[k] - x) < 1e-9
    assert len(got) == n


def test_positions_keep_rows_with_null_buckets(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 1, 2), ("a", 2, 3), (None, 1, 4)], "key string, day int, n int")
    got = {r.n: r.k for r in positions(rows, ["key"], ["day", "n"], ["day"], "k").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_capitalised_names_keep_their_accents(spark):
    from mentiongraph.operators import text

    sents = spark.createDataFrame([(1, 0, "Die Zürich École met Garçon in München")], "doc_id long, sent_idx int, sentence string")
    assert [r.entity for r in text.mentions(sents).collect()] == ["Die", "Zürich", "École", "Garçon", "München"]
