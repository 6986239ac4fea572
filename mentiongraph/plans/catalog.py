"""Registered queries: one Spark plan per operator plus its plain-SQL oracle text.

``QUERIES[name](spark, sf_dir) -> DataFrame`` builds the plan over the whole driver tables;
``ORACLE[name]`` states the same result in SQL over views named after the tables. Every computed
column carries the same alias on both sides and doubles are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooccurrence as co
from ..operators import graph_state as gs
from ..operators import windows as win
from ..sources import adapters
from ..sources.tables import table
from . import sqltext as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _fold(spark: SparkSession, sf_dir: str, *read: str) -> gs.GraphFold:
    """``read``: the names of the fold's tables that the query reads, all without any; the others are deleted."""
    fold = gs.fold_graph(adapters.mentions(spark, sf_dir), adapters.MENTION_ORDER)
    if read and fold.scratch:
        fold.scratch.keep(*read)
    return fold


# --------------------------------------------------------------------------- co-occurrence

@register("cooccurrence_pairs", f"""
WITH {S.MENTIONS_CTE}, {S.PAIRS_CTE}
SELECT article_id, entity_1, entity_2, count FROM pairs""")
def q_cooccurrence_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)[0]


def _pairs(spark, sf_dir):
    n = adapters.mention_partitions(spark, sf_dir)
    return co.cooccurrence_pairs(adapters.mentions(spark, sf_dir, n), partitions=n), n


@register("top_pairs", f"""
WITH {S.MENTIONS_CTE}, {S.PAIRS_CTE}
SELECT entity_1, entity_2, CAST(sum(count) AS BIGINT) AS total_count, count(*) AS n_articles
FROM pairs GROUP BY entity_1, entity_2
ORDER BY total_count DESC, n_articles DESC, entity_1, entity_2 LIMIT 10""")
def q_top_pairs(spark, sf_dir):
    pairs, n = _pairs(spark, sf_dir)
    return co.top_pairs(pairs, 10, n)


# --------------------------------------------------------------------------- graph state

@register("node_state", f"""
WITH {S.GRAPH_CTES},
last AS (
  SELECT entity, max(k_last) AS mention_count, arg_max(x_last, k_last) AS sentiment,
         min(ts) AS first_seen, max(ts) AS last_seen, arg_max(article_id, p) AS last_article
  FROM ea2 GROUP BY entity),
typ AS (SELECT entity, arg_max(etype, k) AS type FROM mk WHERE etype <> '' GROUP BY entity),
rate AS (SELECT m.entity, count(*) AS hourly_rate FROM m JOIN last l ON l.entity = m.entity
         WHERE m.ts >= l.last_seen - INTERVAL 1 HOUR GROUP BY m.entity)
SELECT l.entity AS id, coalesce(t.type, '') AS type, CAST(l.mention_count AS BIGINT) AS mention_count,
       CAST(round(CAST(l.sentiment AS DECIMAL(38,12)), 6) AS DOUBLE) AS sentiment, CAST(round(CAST(coalesce(c.centrality, 0.0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS centrality,
       CAST(r.hourly_rate AS DOUBLE) AS hourly_rate, l.first_seen, l.last_seen
FROM last l LEFT JOIN typ t ON t.entity = l.entity
LEFT JOIN cent2 c ON c.entity = l.entity AND c.article_id = l.last_article
LEFT JOIN rate r ON r.entity = l.entity""")
def q_node_state(spark, sf_dir):
    return gs.node_state(_fold(spark, sf_dir, "fold-articles", "fold-centrality"), adapters.mentions(spark, sf_dir))


@register("edge_state", f"""
WITH {S.GRAPH_CTES}
SELECT entity_1 AS source, entity_2 AS target, CAST(round(CAST(arg_max(strength, kk) AS DECIMAL(38,12)), 6) AS DOUBLE) AS strength,
       CAST(round(CAST(arg_max(joint_sentiment, kk) AS DECIMAL(38,12)), 6) AS DOUBLE) AS joint_sentiment, min(ts) AS first_seen,
       max(ts) AS last_strengthened, CAST(max(kk) AS BIGINT) AS updates
FROM py GROUP BY entity_1, entity_2""")
def q_edge_state(spark, sf_dir):
    return gs.edge_state(_fold(spark, sf_dir, "fold-edges"))


@register("top_nodes", f"SELECT * FROM ({ORACLE['node_state']}) ORDER BY mention_count DESC, id LIMIT 10")
def q_top_nodes(spark, sf_dir):
    return gs.top_nodes(q_node_state(spark, sf_dir))


@register("top_edges", f"SELECT * FROM ({ORACLE['edge_state']}) ORDER BY strength DESC, source, target LIMIT 10")
def q_top_edges(spark, sf_dir):
    return gs.top_edges(q_edge_state(spark, sf_dir))


@register("degree_centrality", f"""
WITH {S.GRAPH_CTES}
SELECT entity AS id, CAST(arg_max(degree, p) AS BIGINT) AS degree, CAST(round(CAST(arg_max(centrality, p) AS DECIMAL(38,12)), 6) AS DOUBLE) AS centrality
FROM cent2 GROUP BY entity""")
def q_degree_centrality(spark, sf_dir):
    return gs.degree_centrality(_fold(spark, sf_dir, "fold-centrality"))


ENTITY_DELTAS_SQL = f"""
WITH {S.GRAPH_CTES},
ed AS (
  SELECT c.article_id, c.ts, c.entity, c.k_first, c.k_last, c.x_last, coalesce(px.x, 0.0) AS old_s,
         c.centrality, coalesce(pc.centrality, 0.0) AS old_c
  FROM cent2 c LEFT JOIN mx px ON px.entity = c.entity AND px.k = c.k_first - 1
  LEFT JOIN cent2 pc ON pc.entity = c.entity AND pc.p = c.p - 1)
SELECT article_id, ts, entity AS entity_id, k_first - 1 AS old_mentions, k_last AS new_mentions,
       k_last - k_first + 1 AS delta_mentions,
       CAST(round(CAST(old_s AS DECIMAL(38,12)), 6) AS DOUBLE) AS old_sentiment, CAST(round(CAST(x_last AS DECIMAL(38,12)), 6) AS DOUBLE) AS new_sentiment, CAST(round(CAST(x_last - old_s AS DECIMAL(38,12)), 6) AS DOUBLE) AS delta_sentiment,
       CAST(round(CAST(old_c AS DECIMAL(38,12)), 6) AS DOUBLE) AS old_centrality, CAST(round(CAST(centrality AS DECIMAL(38,12)), 6) AS DOUBLE) AS new_centrality,
       CAST(round(CAST(centrality - old_c AS DECIMAL(38,12)), 6) AS DOUBLE) AS delta_centrality
FROM ed"""


@register("entity_deltas", ENTITY_DELTAS_SQL)
def q_entity_deltas(spark, sf_dir):
    return gs.entity_changes(_fold(spark, sf_dir, "fold-articles", "fold-centrality"))


EDGE_DELTAS_SQL = f"""
WITH {S.GRAPH_CTES}
SELECT a.article_id, a.ts, a.entity_1 AS source, a.entity_2 AS target,
       CAST(round(CAST(coalesce(b.strength, 0.0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS old_strength, CAST(round(CAST(a.strength AS DECIMAL(38,12)), 6) AS DOUBLE) AS new_strength,
       CAST(round(CAST(a.strength - coalesce(b.strength, 0.0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS delta_strength,
       CAST(round(CAST(coalesce(b.joint_sentiment, 0.0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS old_joint_sentiment,
       CAST(round(CAST(a.joint_sentiment AS DECIMAL(38,12)), 6) AS DOUBLE) AS new_joint_sentiment,
       CAST(round(CAST(a.joint_sentiment - coalesce(b.joint_sentiment, 0.0) AS DECIMAL(38,12)), 6) AS DOUBLE) AS delta_joint_sentiment
FROM py a LEFT JOIN py b ON b.entity_1 = a.entity_1 AND b.entity_2 = a.entity_2 AND b.kk = a.kk - 1
WHERE abs(round(a.strength - coalesce(b.strength, 0.0), 9)) >= 0.0001
   OR abs(round(a.joint_sentiment - coalesce(b.joint_sentiment, 0.0), 9)) >= 0.01"""


@register("edge_deltas", EDGE_DELTAS_SQL)
def q_edge_deltas(spark, sf_dir):
    return gs.edge_changes(_fold(spark, sf_dir, "fold-edges"))


@register("graph_totals_by_article", f"""
WITH {S.GRAPH_CTES}
SELECT n.article_id, ao.ts, CAST(n.node_count AS BIGINT) AS node_count, CAST(e.edge_count AS BIGINT) AS edge_count
FROM node_totals n JOIN edge_totals e USING (article_id) JOIN art_ord ao USING (article_id)""")
def q_graph_totals_by_article(spark, sf_dir):
    return _fold(spark, sf_dir, "fold-totals").totals.select("article_id", "ts", "node_count", "edge_count")


@register("delta_validation", f"""
WITH {S.GRAPH_CTES}
SELECT 'entity' AS kind, count(*) AS checked, CAST(0 AS BIGINT) AS failed FROM cent2
UNION ALL
SELECT 'edge' AS kind, count(*) AS checked, CAST(0 AS BIGINT) AS failed
FROM py a LEFT JOIN py b ON b.entity_1 = a.entity_1 AND b.entity_2 = a.entity_2 AND b.kk = a.kk - 1
WHERE abs(round(a.strength - coalesce(b.strength, 0.0), 9)) >= 0.0001
   OR abs(round(a.joint_sentiment - coalesce(b.joint_sentiment, 0.0), 9)) >= 0.01""")
def q_delta_validation(spark, sf_dir):
    fold = _fold(spark, sf_dir)
    v = gs.validate_changes(fold).groupBy("kind").agg(F.count(F.lit(1)).alias("checked"),
                                                      F.count(F.when(F.size("errors") > 0, 1)).alias("failed"))
    # one kind after the other, so that their shuffle files do not lie side by side
    entities, edges = (fold.scratch.write(f"validated-{kind}", v.filter(F.col("kind") == kind)) for kind in ("entity", "edge"))
    return entities.unionByName(edges)


@register("hourly_rate", """
SELECT a.event_id, a.user_id, a.ts, count(*) AS hourly_rate
FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL 1 HOUR
 AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id))
GROUP BY a.event_id, a.user_id, a.ts""")
def q_hourly_rate(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return win.rolling_hour_count(ev, "user_id", "ts", "event_id", "hourly_rate")


# --------------------------------------------------------------------------- history

from ..operators import history as hs  # noqa: E402

STATE_AT = "1998-07-01 00:00:00"
SEARCH_ENTITY = "part-42"


def _history(spark, sf_dir) -> hs.History:
    return hs.build_history(_fold(spark, sf_dir), written=True)


@register("snapshot_schedule", f"""
WITH RECURSIVE {S.HISTORY_CTES}{S.SNAPSHOT_CTES}
SELECT snapshot_event_id, snapshot_time FROM snaps""")
def q_snapshot_schedule(spark, sf_dir):
    return hs.snapshot_schedule(_history(spark, sf_dir).events)


@register("state_at", f"""
WITH RECURSIVE {S.HISTORY_CTES}{S.SNAPSHOT_CTES}{S.state_sel_cte(STATE_AT)},
chosen AS (SELECT h.* FROM hist_e h, sel
           WHERE h.event_id <= sel.s_id OR (h.event_time > sel.s_time AND h.event_time <= TIMESTAMP '{STATE_AT}'))
SELECT entity_id AS id, arg_max(new_mentions, event_id) AS mention_count, arg_max(new_sentiment, event_id) AS sentiment,
       arg_max(coalesce(new_centrality, 0.0), event_id) AS centrality
FROM chosen GROUP BY entity_id""")
def q_state_at(spark, sf_dir):
    h = _history(spark, sf_dir)
    return hs.state_at(h, hs.snapshot_schedule(h.events), STATE_AT)


@register("state_at_edges", f"""
WITH RECURSIVE {S.HISTORY_CTES}{S.SNAPSHOT_CTES}{S.state_sel_cte(STATE_AT)},
chosen AS (SELECT h.* FROM hist_r h, sel
           WHERE h.event_id <= sel.s_id OR (h.event_time > sel.s_time AND h.event_time <= TIMESTAMP '{STATE_AT}'))
SELECT source, target, arg_max(new_strength, event_id) AS strength,
       arg_max(new_joint_sentiment, event_id) AS joint_sentiment
FROM chosen GROUP BY source, target""")
def q_state_at_edges(spark, sf_dir):
    h = _history(spark, sf_dir)
    return hs.state_at(h, hs.snapshot_schedule(h.events), STATE_AT, kind="edge")


CURRENT_AT = "2100-01-01 00:00:00"
CURRENT_TOPIC = "Part-1!"


@register("current_state_topic", f"""
WITH RECURSIVE {S.HISTORY_CTES}{S.SNAPSHOT_CTES}{S.state_sel_cte(CURRENT_AT)},
chosen AS (SELECT h.* FROM hist_e h JOIN hist_hay hh USING (event_id), sel
           WHERE h.event_id <= sel.s_id
              OR (h.event_time > sel.s_time AND h.event_time <= TIMESTAMP '{CURRENT_AT}' AND contains(hh.hay, 'part-1')))
SELECT entity_id AS id, arg_max(new_mentions, event_id) AS mention_count, arg_max(new_sentiment, event_id) AS sentiment,
       arg_max(coalesce(new_centrality, 0.0), event_id) AS centrality
FROM chosen GROUP BY entity_id""")
def q_current_state_topic(spark, sf_dir):
    h = _history(spark, sf_dir)
    return hs.state_at(h, hs.snapshot_schedule(h.events), CURRENT_AT, topic=CURRENT_TOPIC)


@register("changes_between", f"""
WITH {S.HISTORY_CTES}
SELECT h.event_id, h.event_time, h.article_id FROM hist_ev h JOIN hist_hay hh USING (event_id)
WHERE h.event_time >= TIMESTAMP '1997-01-01 00:00:00' AND h.event_time <= TIMESTAMP '1997-12-31 23:59:59'
  AND contains(hh.hay, '{SEARCH_ENTITY}')""")
def q_changes_between(spark, sf_dir):
    nested = hs.nested_events(_history(spark, sf_dir))
    return hs.changes_between(nested, "1997-01-01 00:00:00", "1997-12-31 23:59:59", SEARCH_ENTITY.upper()) \
        .select("event_id", "event_time", "article_id")


@register("entity_history", f"""
WITH {S.HISTORY_CTES}
SELECT event_id, event_time AS time, new_mentions AS mentions, new_sentiment AS sentiment,
       new_centrality AS centrality, article_id
FROM hist_e WHERE entity_id = '{SEARCH_ENTITY}'
  AND event_time >= TIMESTAMP '2001-12-31 00:00:00' - INTERVAL 3650 DAY
  AND event_time <= TIMESTAMP '2001-12-31 00:00:00'""")
def q_entity_history(spark, sf_dir):
    return hs.entity_history(_history(spark, sf_dir), SEARCH_ENTITY, "2001-12-31 00:00:00", "3650d")


@register("sentiment_trend", f"""
WITH {S.HISTORY_CTES}
SELECT CAST(floor(epoch(event_time) / 2592000) * 2592000 AS BIGINT) AS bucket_start,
       {S.r6("avg(new_sentiment)")} AS avg_sentiment, count(*) AS samples
FROM hist_e WHERE event_time >= TIMESTAMP '1995-01-01 00:00:00' AND event_time <= TIMESTAMP '2002-01-01 00:00:00'
GROUP BY 1""")
def q_sentiment_trend(spark, sf_dir):
    t = hs.sentiment_trend(_history(spark, sf_dir).entity_rows, "1995-01-01 00:00:00", "2002-01-01 00:00:00", "30d")
    return t.select(F.unix_seconds("bucket_start").alias("bucket_start"),
                    gs._r6(F.col("avg_sentiment")).alias("avg_sentiment"), "samples")


@register("recent_articles", f"""
WITH {S.HISTORY_CTES}
SELECT h.event_id, h.event_time, h.article_id, CAST(h.article_id AS VARCHAR) AS headline,
       CAST(len(string_split(hh.hay, ' ')) - 1 AS INTEGER) AS n_entities
FROM hist_ev h JOIN hist_hay hh USING (event_id)
WHERE contains(hh.hay, 'part-42') OR contains(hh.hay, 'part-7')
ORDER BY h.event_id DESC LIMIT 50""")
def q_recent_articles(spark, sf_dir):
    r = hs.recent_articles(hs.nested_events(_history(spark, sf_dir)), "PART-42 part-7 xy", 50)
    return r.select("event_id", "event_time", "article_id", "headline", F.size("entities").alias("n_entities"))


@register("replay_after", f"""
WITH {S.HISTORY_CTES},
page AS (SELECT * FROM hist_ev WHERE event_id > 5000 ORDER BY event_id LIMIT 1000)
SELECT p.event_id, p.article_id FROM page p JOIN hist_hay hh USING (event_id) WHERE contains(hh.hay, 'part-42')""")
def q_replay_after(spark, sf_dir):
    return hs.replay_after(hs.nested_events(_history(spark, sf_dir)), 5000, 1000, "part-42").select("event_id", "article_id")


# --------------------------------------------------------------------------- state carried between batches (G14 ST2 S9 S10 T9 T2)

from ..operators.held_graph import HeldGraph  # noqa: E402
from ..operators.stored_history import StoredHistory  # noqa: E402
from ..session import Scratch, materialize, scratch_path  # noqa: E402

# the whole table is applied in two batches, cut here
BATCH_CUT = "1995-06-17 00:00:00"


def _halves(rows, ts):
    cut = F.lit(BATCH_CUT).cast("timestamp_ntz")
    return rows.filter(F.col(ts) < cut), rows.filter(F.col(ts) >= cut)


def _held(spark, sf_dir) -> HeldGraph:
    graph = HeldGraph(spark, scratch_path(spark, "held-graph"))
    for batch_id, part in enumerate(_halves(adapters.mentions(spark, sf_dir), "ts")):
        graph.apply(batch_id, part, adapters.MENTION_ORDER)
    return graph


@register("held_nodes", ORACLE["node_state"])
def q_held_nodes(spark, sf_dir):
    return _held(spark, sf_dir).state()[0]


@register("held_edges", ORACLE["edge_state"])
def q_held_edges(spark, sf_dir):
    return _held(spark, sf_dir).state()[1]


@register("held_entity_deltas", ENTITY_DELTAS_SQL)
def q_held_entity_deltas(spark, sf_dir):
    return _held(spark, sf_dir).changes("entities").drop("version")


def _stored(spark, sf_dir) -> StoredHistory:
    """The change history stored in two batches, snapshots with it."""
    h = _history(spark, sf_dir)
    stored = StoredHistory(spark, scratch_path(spark, "history"), dates="year")  # a few events a day
    events, entities, relations = (_halves(x, "event_time") for x in (h.events, h.entity_rows, h.edge_rows))
    for batch_id in (0, 1):
        stored.append(batch_id, events[batch_id], entities[batch_id].drop("event_id"), relations[batch_id].drop("event_id"))
    return stored


STORED_STATE_AT = f"""
WITH RECURSIVE {S.HISTORY_CTES}{S.SNAPSHOT_CTES}{S.state_sel_cte(STATE_AT)},
num AS (SELECT count(*) AS base_snapshot_id FROM snaps, sel WHERE snapshot_event_id <= sel.s_id),
app AS (SELECT count(*) AS applied_changes FROM hist_ev h, sel WHERE h.event_time > sel.s_time AND h.event_time <= TIMESTAMP '{STATE_AT}')"""


@register("stored_state_at", STORED_STATE_AT + f""",
chosen AS (SELECT h.* FROM hist_e h, sel
           WHERE h.event_id <= sel.s_id OR (h.event_time > sel.s_time AND h.event_time <= TIMESTAMP '{STATE_AT}'))
SELECT entity_id AS id, arg_max(new_mentions, event_id) AS mention_count, arg_max(new_sentiment, event_id) AS sentiment,
       arg_max(coalesce(new_centrality, 0.0), event_id) AS centrality, any_value(base_snapshot_id) AS base_snapshot_id,
       any_value(applied_changes) AS applied_changes
FROM chosen, num, app GROUP BY entity_id""")
def q_stored_state_at(spark, sf_dir):
    return _stored(spark, sf_dir).state_at(STATE_AT)


@register("stored_snapshots", f"""
WITH RECURSIVE {S.HISTORY_CTES}{S.SNAPSHOT_CTES}
SELECT row_number() OVER (ORDER BY snapshot_event_id) AS snapshot_id, snapshot_time, snapshot_event_id AS last_event_id FROM snaps""")
def q_stored_snapshots(spark, sf_dir):
    return _stored(spark, sf_dir).snapshots().drop("adopted")


@register("stored_events", f"WITH {S.HISTORY_CTES} SELECT event_id, event_time, CAST(article_id AS VARCHAR) AS article_id FROM hist_ev")
def q_stored_events(spark, sf_dir):
    return _stored(spark, sf_dir).events().drop("event_date")


# --------------------------------------------------------------------------- graph algorithms

from ..operators import graph_algo as ga  # noqa: E402


def _algo_inputs(spark, sf_dir):
    m = adapters.mentions(spark, sf_dir)
    fold = gs.fold_graph(m, adapters.MENTION_ORDER)
    edges = fold.edge_steps.select(F.col("entity_1").alias("source"), F.col("entity_2").alias("target")).distinct()
    adj = materialize(ga.adjacency(edges), "adjacency")
    last = m.select("article_id", "ts").orderBy(F.desc("ts"), F.desc("article_id")).limit(1)
    seeds = (m.join(last.select("article_id"), "article_id", "left_semi")
             .select(F.trim("entity").alias("node")).distinct())
    return m, fold, edges, adj, seeds


@register("relationship_strength", f"""
WITH {S.GRAPH_CTES},
rs AS (
  SELECT a.entity_1, a.entity_2, a.kk, a.ts,
         lag(a.ts) OVER (PARTITION BY a.entity_1, a.entity_2 ORDER BY a.kk) AS pts,
         x1.x_last AS s1, x2.x_last AS s2
  FROM pk a JOIN ea x1 ON x1.entity = a.entity_1 AND x1.article_id = a.article_id
  JOIN ea x2 ON x2.entity = a.entity_2 AND x2.article_id = a.article_id)
SELECT entity_1 AS source, entity_2 AS target,
       {S.r6("sum(1.0 * CASE WHEN pts IS NULL THEN 1.0 ELSE exp(-greatest(0.0, (epoch_us(ts) - epoch_us(pts)) / 3.6e9) / 24.0) END * greatest(0.0, 1.0 - abs(s1 - s2) / 2.0))")} AS strength,
       count(*) AS updates
FROM rs GROUP BY entity_1, entity_2""")
def q_relationship_strength(spark, sf_dir):
    return ga.relationship_strength(_fold(spark, sf_dir))


@register("pagerank_full", f"WITH {S.GRAPH_CTES}{S.ALGO_CTES}" + S.pagerank_sql("g_nodes", "g_adj"))
def q_pagerank_full(spark, sf_dir):
    _m, fold, _e, adj, _s = _algo_inputs(spark, sf_dir)
    nodes = fold.entity_articles.select(F.col("entity").alias("node")).distinct()
    pr = ga.pagerank(adj, nodes)
    return pr.select("node", gs._r6(F.col("pagerank")).alias("pagerank"))


@register("pagerank_touched", f"WITH {S.GRAPH_CTES}{S.ALGO_CTES}" + S.pagerank_sql("khop", "g_adj"))
def q_pagerank_touched(spark, sf_dir):
    _m, _f, _e, adj, seeds = _algo_inputs(spark, sf_dir)
    pr = ga.pagerank(adj, ga.khop(adj, seeds, 2))
    return pr.select("node", gs._r6(F.col("pagerank")).alias("pagerank"))


@register("khop_subgraph", f"WITH {S.GRAPH_CTES}{S.ALGO_CTES}\nSELECT node, CAST(dist AS INTEGER) AS dist FROM khop")
def q_khop_subgraph(spark, sf_dir):
    _m, _f, _e, adj, seeds = _algo_inputs(spark, sf_dir)
    return ga.khop(adj, seeds, 2).select("node", F.col("dist").cast("int").alias("dist"))


@register("bfs_distances", f"WITH {S.GRAPH_CTES}{S.ALGO_CTES}" + S.bfs_sql("khop", "g_adj") +
          "\nSELECT source, node, CAST(dist AS INTEGER) AS dist FROM bfs")
def q_bfs_distances(spark, sf_dir):
    _m, _f, _e, adj, seeds = _algo_inputs(spark, sf_dir)
    sub = ga.khop(adj, seeds, 2)
    return ga.bfs(adj, ga.sample_sources(sub), sub).select("source", "node", F.col("dist").cast("int").alias("dist"))


@register("bridge_score", f"WITH {S.GRAPH_CTES}{S.ALGO_CTES}" + S.bfs_sql("khop", "g_adj") + f""",
sc AS (SELECT node, CAST(sum(dist) AS DOUBLE) AS s FROM bfs WHERE node <> source GROUP BY node)
SELECT b.node, {S.r6("coalesce(sc.s, 0.0) / (SELECT CASE WHEN max(s) > 0 THEN max(s) ELSE 1.0 END FROM sc)")} AS betweenness
FROM b_nodes b LEFT JOIN sc USING (node)
WHERE (SELECT count(*) FROM b_nodes) >= 3""")
def q_bridge_score(spark, sf_dir):
    _m, _f, _e, adj, seeds = _algo_inputs(spark, sf_dir)
    b = ga.bridge_score(adj, ga.khop(adj, seeds, 2))
    return b.select("node", gs._r6(F.col("betweenness")).alias("betweenness"))


@register("communities")
def q_communities(spark, sf_dir):
    """G9/G10 (no SQL oracle: an iterative local-moving loop; invariants are tested instead)."""
    fold = _fold(spark, sf_dir)
    strength = ga.relationship_strength(fold)
    nodes = fold.entity_articles.select(F.col("entity").alias("node")).distinct()
    return ga.dense_community_ids(ga.communities(nodes, strength))


# --------------------------------------------------------------------------- intake

from ..operators import intake as it  # noqa: E402
from ..operators import text as tx  # noqa: E402

WSQ = r"[ \t\n\r\f]+"
STRIP_SQL = "regexp_replace({x}, '^" + WSQ + "|" + WSQ + "$', '', 'g')"
BASE_S = 1704067200  # 2024-01-01 00:00:00 UTC


def _strip(x: str) -> str:
    return STRIP_SQL.format(x=x)


def _rss(spark, sf_dir):
    a = adapters.articles(spark, sf_dir)
    raw = a.select("id", "title", "content", "link", "feed_id", "feed_title",
                   F.unix_seconds(F.col("published_at")).alias("updated"), F.lit(None).cast("string").alias("author"))
    return it.normalise_rss(raw)


@register("rss_normalise", f"""
SELECT doc_id AS id, trim(split_part(text, chr(10), 1)) AS title,
       'https://news.example/' || source || '/' || CAST(doc_id AS VARCHAR) AS link, doc_id AS feed_id,
       source AS feed_title, CAST({BASE_S} + doc_id * 60 AS BIGINT) AS published_at_s, 'rss feed' AS tags,
       'ttrss' AS source, coalesce(nullif({_strip('source')}, ''), 'ttrss') AS partition_key,
       CAST(length(text) AS BIGINT) AS content_chars
FROM documents""")
def q_rss_normalise(spark, sf_dir):
    r = _rss(spark, sf_dir)
    return r.select("id", "title", "link", "feed_id", "feed_title",
                    F.unix_seconds("published_at").alias("published_at_s"), F.concat_ws(",", "tags").alias("tags"),
                    "source", it.partition_key(F.col("feed_title"), F.col("source")).alias("partition_key"),
                    F.length("content").cast("long").alias("content_chars"))


POSTS_SQL = f"""
p0 AS (
  SELECT conv_id, turn, role, text,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn), '%Y-%m-%dT%H:%M:%SZ') AS created_at,
         CASE WHEN turn % 2 = 0 THEN 'at://' || role || '.example/app.post/' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS uri,
         role || '.example' AS handle,
         CASE WHEN role = 'assistant' THEN NULL ELSE upper(left(role, 1)) || lower(substr(role, 2)) END AS display_name,
         'q' || CAST(conv_id % 3 AS VARCHAR) AS query
  FROM conversations),
p1 AS (
  SELECT *, {_strip('coalesce(text, \'\')')} AS content,
         {_strip("regexp_replace(" + _strip("coalesce(text, '')") + ", '" + WSQ + "', ' ', 'g')")} AS clean
  FROM p0),
posts_n AS (
  SELECT coalesce(nullif(uri, ''), sha1(coalesce(handle, '') || ':' || coalesce(text, '') || ':' || coalesce(created_at, ''))) AS id,
         CASE WHEN clean = '' THEN 'Bluesky post' WHEN length(clean) <= 120 THEN clean ELSE left(clean, 117) || '...' END AS title,
         CASE WHEN handle IS NOT NULL AND handle <> '' AND uri IS NOT NULL AND uri <> ''
              THEN 'https://bsky.app/profile/' || handle || '/post/' || string_split(rtrim(uri, '/'), '/')[-1] ELSE '' END AS link,
         coalesce(nullif(display_name, ''), handle) AS author,
         'social media,' || query AS tags, CAST({BASE_S} + conv_id * 60 + turn AS BIGINT) AS published_at_s,
         'bluesky' AS source, CAST(length(content) AS BIGINT) AS content_chars, query
  FROM p1)"""


@register("post_normalise", f"WITH {POSTS_SQL}\nSELECT id, title, link, author, tags, published_at_s, source, content_chars FROM posts_n")
def q_post_normalise(spark, sf_dir):
    p = it.normalise_posts(adapters.posts(spark, sf_dir))
    return p.select("id", "title", "link", "author", F.concat_ws(",", "tags").alias("tags"),
                    F.unix_seconds("published_at").alias("published_at_s"), "source",
                    F.length("content").cast("long").alias("content_chars"))


@register("keyword_since_filter", f"""
SELECT doc_id AS id FROM documents
WHERE {BASE_S} + doc_id * 60 >= {BASE_S + 6 * 3600}
  AND (contains(lower(trim(split_part(text, chr(10), 1))), 'the') OR contains(lower(text), 'the'))""")
def q_keyword_since_filter(spark, sf_dir):
    return it.since_keyword_filter(_rss(spark, sf_dir), "2024-01-01 06:00:00", "THE").select("id")


@register("headline_filter", """
SELECT doc_id AS id, trim(split_part(text, chr(10), 1)) AS title FROM documents
WHERE contains(lower(trim(split_part(text, chr(10), 1))), 'en')
   OR contains(lower(trim(split_part(text, chr(10), 1))), 'ou')
   OR contains(lower(trim(split_part(text, chr(10), 1))), 'thè')""")
def q_headline_filter(spark, sf_dir):
    return it.headline_filter(_rss(spark, sf_dir), it.term_list(F.lit("EN, Ou ,,thè"))).select("id", "title")


@register("topic_match", f"""
SELECT doc_id AS id, contains(lower({_strip("trim(split_part(text, chr(10), 1))")}), 'the') AS accepted,
       {_strip("trim(split_part(text, chr(10), 1))")} AS title, source,
       'https://news.example/' || source || '/' || CAST(doc_id AS VARCHAR) AS link,
       left(replace({_strip('text')}, '\\n', ' '), 400) AS article_preview
FROM documents""")
def q_topic_match(spark, sf_dir):
    return it.accepted_preview(_rss(spark, sf_dir), "The")


@register("term_dedupe", f"""
WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, ','), 1) - 1 AS pos,
                  unnest(string_split(text, ',')) AS raw FROM documents),
t AS (SELECT doc_id, pos, {_strip('raw')} AS term FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY pos) AS rn FROM t WHERE term <> '')
SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM r WHERE rn = 1""")
def q_term_dedupe(spark, sf_dir):
    return it.dedupe_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@register("bounded_seen_ids", f"""
WITH {POSTS_SQL},
r AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY published_at_s DESC, id DESC) AS rank
      FROM (SELECT DISTINCT query, id, published_at_s FROM posts_n))
SELECT query, id, rank FROM r WHERE rank <= 500""")
def q_bounded_seen_ids(spark, sf_dir):
    p = it.normalise_posts(adapters.posts(spark, sf_dir)).withColumn("published_at_s", F.unix_seconds("published_at"))
    seen = p.filter(F.col("published_at") < F.to_timestamp(F.lit("2024-01-01 04:00:00")))
    fresh = it.new_posts(p, seen)
    return it.retain_seen(seen, fresh, "published_at_s").select("query", "id", F.col("rank").cast("long").alias("rank"))


PRIORITY_TTL = 86400  # a few requests a key and day at the smallest size
PRIORITY_SQL = f"""
WITH q AS (SELECT CAST(user_id % 40 AS VARCHAR) AS key, event_type || ' ' || CAST(user_id AS VARCHAR) AS topic, ts FROM events WHERE event_type <> 'error'),
l AS (SELECT key, topic, max(ts) AS requested_at FROM q GROUP BY key, topic),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY requested_at DESC, topic) - 1 AS rank, max(requested_at) OVER (PARTITION BY key) AS newest FROM l),
p AS (SELECT key, rank, topic, requested_at FROM r WHERE rank < 10 AND requested_at >= newest - INTERVAL {PRIORITY_TTL} SECOND)"""


def _priority(spark, sf_dir):
    """The requests of events, registered in two batches."""
    from ..operators.priority import PriorityTopics

    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    asked = ev.select((F.col("user_id") % 40).cast("string").alias("key"), F.col("ts").alias("requested_at"), F.col("event_type"),
                      F.when(F.col("event_type") == "error", F.lit(" \t")).otherwise(
                          F.format_string(" %s \t%d ", F.initcap("event_type"), "user_id")).alias("topic"))
    topics = PriorityTopics(spark, scratch_path(spark, "priority"), ttl_seconds=PRIORITY_TTL)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    topics.register(0, asked.filter(F.col("requested_at") < cut))
    topics.register(1, asked.filter(F.col("requested_at") >= cut))
    return topics, asked


@register("priority_topics", PRIORITY_SQL + "\nSELECT key, rank, topic, requested_at FROM p")
def q_priority_topics(spark, sf_dir):
    return _priority(spark, sf_dir)[0].topics().select(
        "key", F.col("rank").cast("long").alias("rank"), "topic", F.col("requested_at").cast("timestamp_ntz").alias("requested_at"))


@register("active_queries", PRIORITY_SQL + """,
d AS (SELECT key, arg_max(event_type || ' ' || CAST(user_id AS VARCHAR), (ts, user_id)) AS term
      FROM (SELECT CAST(user_id % 40 AS VARCHAR) AS key, * FROM events WHERE event_type <> 'error') GROUP BY key),
u AS (SELECT key, 0 AS src, rank AS pos, topic AS term FROM p
      UNION ALL SELECT key, 1, 0, upper(term) FROM d UNION ALL SELECT key, 1, 1, 'News' FROM d UNION ALL SELECT key, 1, 2, 'NEWS' FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY key, lower(term) ORDER BY src, pos) AS rn FROM u)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY src, pos) - 1 AS rank, term FROM f WHERE rn = 1""")
def q_active_queries(spark, sf_dir):
    topics, asked = _priority(spark, sf_dir)
    own = asked.filter("event_type <> 'error'").groupBy("key").agg(F.max_by(
        F.upper(it.collapse_ws(F.col("topic"))), F.struct("requested_at", F.substring_index(it.strip_ws(F.col("topic")), "\t", -1).cast("long"))).alias("term"))
    defaults = own.select("key", F.posexplode(F.array("term", F.lit("News"), F.lit("NEWS"))).alias("pos", "term"))
    return topics.queries(defaults).select("key", F.col("rank").cast("long").alias("rank"), "term")


@register("high_water", """
SELECT count(*) AS n_new, CAST(coalesce(max(doc_id), 100) AS BIGINT) AS high_water FROM documents WHERE doc_id > 100""")
def q_high_water(spark, sf_dir):
    return it.high_water(_rss(spark, sf_dir), 100)


@register("latest_payload", """
SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
       arg_max(value, event_id) AS value
FROM events GROUP BY user_id""")
def q_latest_payload(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    lp = it.latest_payload(ev, "user_id", "event_id")
    return lp.select("user_id", "latest.event_id", "latest.event_type", "latest.value")


@register("first_seen", """
SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY user_id""")
def q_first_seen(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    fs = it.first_sight(ev.withColumn("_o", F.struct("ts", "event_id")), "user_id", "_o")
    return fs.select("user_id", "first.event_id", "first.ts")


# --------------------------------------------------------------------------- text

SENT_SQL = f"""
sp AS (SELECT doc_id, generate_subscripts(regexp_extract_all(text, '{tx.PIECE_PATTERN}'), 1) AS pos,
              unnest(regexp_extract_all(text, '{tx.PIECE_PATTERN}')) AS piece, text FROM documents),
so AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sp),
ss AS (SELECT doc_id, pos, off + length(piece) - length(regexp_replace(piece, '^{WSQ}', '')) AS char_start,
              off + length(piece) AS char_end, regexp_replace(piece, '^{WSQ}', '') AS sentence
       FROM so WHERE {_strip('piece')} <> ''),
sents AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS sent_idx,
                 CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, sentence FROM ss)"""


def _sents(spark, sf_dir):
    return tx.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("sentences", f"WITH {SENT_SQL}\nSELECT doc_id, sent_idx, char_start, char_end FROM sents")
def q_sentences(spark, sf_dir):
    return _sents(spark, sf_dir).select("doc_id", "sent_idx", "char_start", "char_end")


@register("chunks", f"""WITH {SENT_SQL},
n AS (SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id),
c0 AS (SELECT doc_id, n, generate_subscripts(range(0, n, 6), 1) - 1 AS chunk_idx, unnest(range(0, n, 6)) AS start_sentence FROM n),
c AS (SELECT doc_id, chunk_idx, start_sentence, least(n - 1, start_sentence + 7) AS end_sentence FROM c0
      WHERE chunk_idx = 0 OR start_sentence - 6 + 7 < n - 1)
SELECT c.doc_id, CAST(c.chunk_idx AS INTEGER) AS chunk_idx, CAST(c.start_sentence AS INTEGER) AS start_sentence,
       CAST(c.end_sentence AS INTEGER) AS end_sentence, s1.char_start, s2.char_end
FROM c JOIN sents s1 ON s1.doc_id = c.doc_id AND s1.sent_idx = c.start_sentence
JOIN sents s2 ON s2.doc_id = c.doc_id AND s2.sent_idx = c.end_sentence""")
def q_chunks(spark, sf_dir):
    ch = tx.chunks(_sents(spark, sf_dir))
    return ch.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("chunk_idx", "start_sentence", "end_sentence")],
                     "char_start", "char_end")


MENT_SQL = f"""
ments AS (SELECT doc_id, sent_idx, unnest(regexp_extract_all(sentence, '{tx.CAPITALISED_TOKEN}')) AS entity FROM sents)"""


@register("mentions_text", f"WITH {SENT_SQL}, {MENT_SQL}\nSELECT doc_id, sent_idx, entity, count(*) AS n FROM ments GROUP BY ALL")
def q_mentions_text(spark, sf_dir):
    return tx.mentions(_sents(spark, sf_dir)).groupBy("doc_id", "sent_idx", "entity").agg(F.count(F.lit(1)).alias("n"))


SPANS_SQL = f"""
gp AS (SELECT doc_id, sent_idx, char_start,
              unnest(regexp_extract_all(sentence, '(?s)(.*?)({tx.CAPITALISED_TOKEN})', 1)) AS gap,
              unnest(regexp_extract_all(sentence, '(?s)(.*?)({tx.CAPITALISED_TOKEN})', 2)) AS entity,
              generate_subscripts(regexp_extract_all(sentence, '{tx.CAPITALISED_TOKEN}'), 1) AS pos FROM sents),
spans AS (SELECT doc_id, sent_idx, entity, char_start + sum(length(gap) + length(entity)) OVER (
                 PARTITION BY doc_id, sent_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS char_end FROM gp)"""


@register("mention_sentence", f"""WITH {SENT_SQL}, {SPANS_SQL}
SELECT doc_id, sent_idx, entity, CAST(char_end - length(entity) AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end FROM spans""")
def q_mention_sentence(spark, sf_dir):
    found = tx.mention_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "sent_idx", "entity", "char_start", "char_end")


@register("mention_dedupe", f"""WITH {SENT_SQL}, {SPANS_SQL},
n AS (SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id),
c0 AS (SELECT doc_id, n, unnest(range(0, n, 6)) AS a FROM n),
c AS (SELECT doc_id, a, a + 7 AS b FROM c0 WHERE a = 0 OR a + 1 < n - 1)
SELECT s.doc_id, count(*) AS found, count(DISTINCT (s.sent_idx, s.char_end)) AS kept
FROM spans s JOIN c ON c.doc_id = s.doc_id AND s.sent_idx BETWEEN c.a AND c.b GROUP BY s.doc_id""")
def q_mention_dedupe(spark, sf_dir):
    found = tx.chunk_mentions(tx.chunk_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
    kept = tx.dedupe_mentions(found).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found")).join(kept, "doc_id")


def _lex(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@register("sentence_sentiment", f"""WITH {SENT_SQL}, {MENT_SQL},
sc AS (SELECT s.doc_id, s.sent_idx, regexp_extract_all(lower(left(s.sentence, 512)), '\\p{{L}}+') AS toks
       FROM sents s WHERE (s.doc_id, s.sent_idx) IN (SELECT doc_id, sent_idx FROM ments)),
pn AS (SELECT doc_id, sent_idx, len(list_filter(toks, lambda t: list_contains({_lex(tx.POSITIVE_WORDS)}, t))) AS p,
              len(list_filter(toks, lambda t: list_contains({_lex(tx.NEGATIVE_WORDS)}, t))) AS n FROM sc),
lb AS (SELECT doc_id, sent_idx, CASE WHEN p > n THEN 'POSITIVE' WHEN n > p THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
              (abs(p - n) + 1.0) / (p + n + 2.0) AS confidence FROM pn)
SELECT doc_id, sent_idx, label, {S.r6('confidence')} AS confidence,
       {S.r6("CASE WHEN label LIKE '%POS%' THEN confidence WHEN label LIKE '%NEG%' THEN -confidence ELSE 0.0 END")} AS signed_score
FROM lb""")
def q_sentence_sentiment(spark, sf_dir):
    s = _sents(spark, sf_dir)
    sc = tx.sentence_scores(tx.mentions(s), s)
    return sc.select("doc_id", "sent_idx", "label", gs._r6(F.col("confidence")).alias("confidence"),
                     gs._r6(F.col("signed_score")).alias("signed_score"))


def _html_sql(x: str) -> str:
    t = x
    for tag in ("script", "style", "nav", "table", "head"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<[^>]*>', ' ', 'g')"
    for ent, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{ent}', '{ch}')"
    return _strip(f"regexp_replace({t}, '{WSQ}', ' ', 'g')")


@register("page_text", f"""
SELECT page_id, CASE WHEN length(t) >= 50 THEN t ELSE '' END AS text
FROM (SELECT page_id, {_html_sql('html')} AS t FROM pages)""")
def q_page_text(spark, sf_dir):
    p = adapters.pages_raw(spark, sf_dir)
    return p.select("page_id", tx.html_text(F.col("html"), F.lit("")).alias("text"))


@register("article_mean_sentiment", f"""
WITH {S.MENTIONS_CTE}
SELECT o.o_orderkey AS article_id, {S.r6('coalesce(avg(m.score), 0.0)')} AS mean_sentiment, count(m.entity) AS n_mentions
FROM orders o LEFT JOIN m ON m.article_id = o.o_orderkey GROUP BY o.o_orderkey""")
def q_article_mean_sentiment(spark, sf_dir):
    m = adapters.mentions(spark, sf_dir)
    per = m.groupBy("article_id").agg(F.avg("score").alias("_a"), F.count("entity").alias("n_mentions"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"))
    return (o.join(per, "article_id", "left")
            .select("article_id", gs._r6(F.coalesce(F.col("_a"), F.lit(0.0))).alias("mean_sentiment"),
                    F.coalesce(F.col("n_mentions"), F.lit(0)).alias("n_mentions")))


PROCESSED_AT = "2024-01-31 00:00:00"  # the time of processing that the lag is measured at; later records have none
SKIPPED = "signup"


@register("processing_metrics", f"""
SELECT window_start,
       count(*) FILTER (WHERE event_type NOT IN ('error', '{SKIPPED}')) AS processed_ok,
       count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = '{SKIPPED}') AS skipped,
       {S.r6(f"count(*) FILTER (WHERE event_type NOT IN ('error', '{SKIPPED}')) / 3600.0")} AS articles_per_second,
       {S.r6(f"coalesce(avg(value) FILTER (WHERE event_type NOT IN ('error', '{SKIPPED}')), 0.0)")} AS avg_latency_ms,
       {S.r6(f"greatest(0.0, epoch_us(TIMESTAMP '{PROCESSED_AT}') / 1e6 - max(t))")} AS lag_seconds
FROM (SELECT *, epoch_us(ts) / 1e6 AS t, CAST(floor(epoch_us(ts) / 1e6 / 3600) * 3600 AS BIGINT) AS window_start FROM events)
GROUP BY window_start""")
def q_processing_metrics(spark, sf_dir):
    from ..operators import metrics as mt
    return mt.processing_metrics(table(spark, sf_dir, "events"), now=F.to_timestamp(F.lit(PROCESSED_AT)), skipped=SKIPPED)


# --------------------------------------------------------------------------- routing

from ..operators import metrics as mt  # noqa: E402
from ..operators import routing as rt  # noqa: E402


def _subscribers(spark, sf_dir):
    h = _history(spark, sf_dir)
    ev_ent = h.entity_rows.select("event_id", "article_id", "entity_id")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    clients = sup.select(F.col("s_name").alias("client_id"),
                         F.concat(F.lit("Part-"), F.col("s_suppkey").cast("string"), F.lit("!")).alias("topic_filter"))
    terms = clients.select("client_id", F.explode(hs.topic_terms_col(F.col("topic_filter"))).alias("term"))
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    subs = (li.join(sup, li.l_suppkey == sup.s_suppkey)
            .select(F.col("s_name").alias("client_id"),
                    F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("entity")).distinct())
    return ev_ent, terms, subs, clients.select("client_id")


@register("route_events", f"WITH RECURSIVE {S.HISTORY_CTES}{S.ROUTING_CTES}\nSELECT client_id, event_id FROM routed")
def q_route_events(spark, sf_dir):
    return rt.route(*_subscribers(spark, sf_dir), scratch=Scratch(spark, free_shuffles=True, codec="zstd"))


@register("client_deliveries", f"""WITH RECURSIVE {S.HISTORY_CTES}{S.ROUTING_CTES}
SELECT client_id, count(*) AS delivered FROM routed GROUP BY client_id
UNION ALL SELECT 'everything' AS client_id, count(*) AS delivered FROM hist_ev""")
def q_client_deliveries(spark, sf_dir):
    events, terms, subs, clients = _subscribers(spark, sf_dir)
    clients = clients.unionByName(spark.range(1).select(F.lit("everything").alias("client_id")))
    return rt.deliveries(rt.route(events, terms, subs, clients, Scratch(spark, free_shuffles=True, codec="zstd")), rt.open_clients(terms, subs, clients), events)


# --------------------------------------------------------------------------- correlation

from ..operators import correlate as cr  # noqa: E402


# events as progress messages: an article is a user, a blank one and status messages are among them
_PROGRESS_TYPES = {"view": "step1", "click": "step2", "purchase": "step3", "signup": "step4", "error": "timeout"}


@register("article_progress", """
WITH e AS (SELECT event_id, value, props AS title,
                  CASE WHEN user_id % 29 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS article_id,
                  CASE WHEN event_id % 11 = 0 THEN 'status' WHEN event_id % 7 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'other'
                       WHEN event_type = 'view' THEN 'step1' WHEN event_type = 'click' THEN 'step2' WHEN event_type = 'purchase' THEN 'step3'
                       WHEN event_type = 'signup' THEN 'step4' WHEN event_type = 'error' THEN 'timeout' END AS type FROM events)
SELECT article_id, min(event_id) AS first_event,
       max(event_id) FILTER (WHERE type = 'step1') AS step1, max(event_id) FILTER (WHERE type = 'step2') AS step2,
       max(event_id) FILTER (WHERE type = 'step3') AS step3, max(event_id) FILTER (WHERE type = 'step4') AS step4,
       max(event_id) FILTER (WHERE type = 'timeout') AS timeout, max(event_id) FILTER (WHERE type = 'error') AS error,
       arg_max(value, event_id) FILTER (WHERE type = 'step4') AS state,
       arg_max(title, event_id) FILTER (WHERE type = 'step1' AND title <> '') AS title
FROM e WHERE article_id <> '' AND type IS DISTINCT FROM 'status' GROUP BY article_id""")
def q_article_progress(spark, sf_dir):
    stage = F.when(F.col("event_id") % 11 == 0, F.lit(cr.STATUS)).when(F.col("event_id") % 7 == 0, F.lit("error")) \
        .when(F.col("event_id") % 5 == 0, F.lit("other"))
    for event_type, name in _PROGRESS_TYPES.items():
        stage = stage.when(F.col("event_type") == event_type, F.lit(name))
    article = F.when(F.col("user_id") % 29 == 0, F.lit("")).otherwise(F.col("user_id").cast("string"))
    ev = table(spark, sf_dir, "events").select(article.alias("article_id"), stage.alias("type"), "event_id", "value", F.col("props").alias("title"))
    p = cr.article_progress(ev, "event_id", "title")
    return p.select("article_id", F.col("first_order").alias("first_event"), *[F.col(f"{s}.event_id").alias(s) for s in cr.STAGES],
                    F.col("step4.value").alias("state"), "title")


@register("correlate_stages", f"""
WITH {S.GRAPH_CTES},
enr AS (SELECT article_id, min(ts) AS t_enriched, avg(score) AS mean_s FROM m GROUP BY article_id),
ch AS (SELECT n.article_id, ao.ts AS t_change, n.node_count, e.edge_count
       FROM node_totals n JOIN edge_totals e USING (article_id) JOIN art_ord ao USING (article_id))
SELECT o.o_orderkey AS article_id, en.t_enriched IS NOT NULL AS step2, c.t_change IS NOT NULL AS step3,
       CASE WHEN en.t_enriched IS NULL THEN 'step2' WHEN c.t_change IS NULL THEN 'step3' END AS timeout_step,
       {S.r6('coalesce(en.mean_s, 0.0)')} AS mean_sentiment,
       CAST(c.node_count AS BIGINT) AS node_count, CAST(c.edge_count AS BIGINT) AS edge_count
FROM orders o
LEFT JOIN enr en ON en.article_id = o.o_orderkey
 AND en.t_enriched BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 45 SECOND
LEFT JOIN ch c ON c.article_id = o.o_orderkey AND en.t_enriched IS NOT NULL
 AND c.t_change BETWEEN en.t_enriched AND en.t_enriched + INTERVAL 45 SECOND""")
def q_correlate_stages(spark, sf_dir):
    m = adapters.mentions(spark, sf_dir)
    fold = gs.fold_graph(m, adapters.MENTION_ORDER)
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_orderdate").alias("t_raw"))
    enr = m.groupBy("article_id").agg(F.min("ts").alias("t_enriched"), F.avg("score").alias("mean_sentiment"))
    ch = fold.totals.select("article_id", F.col("ts").alias("t_change"), "node_count", "edge_count")
    return cr.correlate_stages(raw, enr, ch)
