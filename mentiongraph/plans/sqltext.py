"""Shared SQL text for the DuckDB oracle queries (views named after the driver's tables).

These strings are the independent, plain-SQL statement of each operator's result; they are
written for clarity (windows over whole keys, quadratic self-joins for EWMA) rather than speed.
"""

MENTIONS_CTE = """
m AS (
  SELECT l.l_orderkey AS article_id, o.o_orderdate AS ts,
         'part-' || CAST(l.l_partkey AS VARCHAR) AS entity,
         coalesce(p.p_brand, '') AS etype,
         CAST(l.l_linenumber AS INTEGER) AS sent_idx,
         round((l.l_discount - 0.05) * 20.0, 6) AS score,
         abs(round((l.l_discount - 0.05) * 20.0, 6)) AS confidence,
         l.l_partkey AS t_part, l.l_suppkey AS t_supp, l.l_quantity AS t_qty, l.l_extendedprice AS t_price,
         l.l_discount AS t_disc, l.l_tax AS t_tax, l.l_returnflag AS t_rf, l.l_linestatus AS t_ls,
         l.l_shipdate AS t_ship
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  WHERE trim('part-' || CAST(l.l_partkey AS VARCHAR)) <> ''
)"""

MENTION_ORDER_SQL = "ts, article_id, sent_idx, t_part, t_supp, t_qty, t_price, t_disc, t_tax, t_rf, t_ls, t_ship"

PAIRS_CTE = """
e AS (SELECT DISTINCT article_id, sent_idx, trim(entity) AS entity FROM m WHERE trim(entity) <> ''),
pr AS (
  SELECT a.article_id, least(a.entity, b.entity) AS entity_1, greatest(a.entity, b.entity) AS entity_2
  FROM e a JOIN e b ON a.article_id = b.article_id
   AND ((b.sent_idx = a.sent_idx AND a.entity < b.entity)
     OR (b.sent_idx = a.sent_idx + 1 AND a.entity <> b.entity))
),
pairs AS (SELECT article_id, entity_1, entity_2, count(*) AS count FROM pr GROUP BY article_id, entity_1, entity_2)"""

# Per-mention graph-fold state: position k per entity, EWMA sentiment after each mention
# (x_k = sum_j c_j s_j 0.95^(k-j), c_1 = 1, else 0.05), per-article entity rows (ea), node
# totals after each article, per-article pair rows with edge position and EWMA strength/joint.
GRAPH_CTES = MENTIONS_CTE + "," + PAIRS_CTE + """,
mk AS (
  SELECT entity, article_id, ts, etype, score,
         row_number() OVER (PARTITION BY entity ORDER BY """ + MENTION_ORDER_SQL + """) AS k
  FROM m
),
mx AS (
  SELECT a.entity, a.article_id, a.ts, a.etype, a.k,
         sum(CASE WHEN b.k = 1 THEN 1.0 ELSE 0.05 END * b.score * pow(0.95, a.k - b.k)) AS x
  FROM mk a JOIN mk b ON a.entity = b.entity AND b.k <= a.k
  GROUP BY a.entity, a.article_id, a.ts, a.etype, a.k
),
arts AS (SELECT DISTINCT article_id, ts FROM m),
art_ord AS (SELECT article_id, ts, row_number() OVER (ORDER BY ts, article_id) AS aseq FROM arts),
ea AS (
  SELECT entity, article_id, min(ts) AS ts, min(k) AS k_first, max(k) AS k_last,
         arg_max(x, k) AS x_last
  FROM mx GROUP BY entity, article_id
),
ea2 AS (
  SELECT ea.*, ao.aseq,
         row_number() OVER (PARTITION BY entity ORDER BY ao.aseq) AS p
  FROM ea JOIN art_ord ao USING (article_id)
),
node_first AS (SELECT entity, min(aseq) AS first_aseq FROM ea2 GROUP BY entity),
node_totals AS (
  SELECT ao.article_id, ao.aseq,
         sum(coalesce(nf.n, 0)) OVER (ORDER BY ao.aseq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS node_count
  FROM art_ord ao LEFT JOIN (SELECT first_aseq, count(*) AS n FROM node_first GROUP BY first_aseq) nf
    ON nf.first_aseq = ao.aseq
),
pk AS (
  SELECT p.article_id, ao.ts, ao.aseq, p.entity_1, p.entity_2, p.count,
         row_number() OVER (PARTITION BY p.entity_1, p.entity_2 ORDER BY ao.aseq) AS kk,
         (x1.x_last + x2.x_last) / 2.0 AS joint
  FROM pairs p JOIN art_ord ao USING (article_id)
  JOIN ea x1 ON x1.entity = p.entity_1 AND x1.article_id = p.article_id
  JOIN ea x2 ON x2.entity = p.entity_2 AND x2.article_id = p.article_id
),
py AS (
  SELECT a.article_id, a.ts, a.aseq, a.entity_1, a.entity_2, a.kk,
         sum(CASE WHEN b.kk = 1 THEN 1.0 ELSE 0.05 END * b.count * pow(0.95, a.kk - b.kk)) AS strength,
         sum(CASE WHEN b.kk = 1 THEN 1.0 ELSE 0.05 END * b.joint * pow(0.95, a.kk - b.kk)) AS joint_sentiment
  FROM pk a JOIN pk b ON a.entity_1 = b.entity_1 AND a.entity_2 = b.entity_2 AND b.kk <= a.kk
  GROUP BY a.article_id, a.ts, a.aseq, a.entity_1, a.entity_2, a.kk
),
edge_totals AS (
  SELECT ao.article_id, ao.aseq,
         sum(coalesce(ef.n, 0)) OVER (ORDER BY ao.aseq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS edge_count
  FROM art_ord ao LEFT JOIN (SELECT aseq, count(*) AS n FROM py WHERE kk = 1 GROUP BY aseq) ef ON ef.aseq = ao.aseq
),
nb_new AS (
  SELECT entity, aseq, count(*) AS n FROM (
    SELECT entity_1 AS entity, aseq FROM py WHERE kk = 1
    UNION ALL SELECT entity_2 AS entity, aseq FROM py WHERE kk = 1) t
  GROUP BY entity, aseq
),
cent AS (
  SELECT e.entity, e.article_id, e.ts, e.aseq, e.p, e.k_first, e.k_last, e.x_last,
         sum(coalesce(nb.n, 0)) OVER (PARTITION BY e.entity ORDER BY e.aseq
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS degree,
         nt.node_count
  FROM ea2 e LEFT JOIN nb_new nb ON nb.entity = e.entity AND nb.aseq = e.aseq
  JOIN node_totals nt ON nt.aseq = e.aseq
),
cent2 AS (
  SELECT *, CAST(degree AS DOUBLE) / greatest(1, node_count - 1) AS centrality FROM cent
)"""


def r6(expr: str) -> str:
    """SQL for rounding to 6 places through DECIMAL(38,12) (same rule as the Spark side)."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,12)), 6) AS DOUBLE)"


# Change history: events numbered in article order, flattened entity / relationship change rows,
# the snapshot chain (first event, then min(i + 100, first event 10 minutes or more later)).
HISTORY_CTES = GRAPH_CTES + """,
hist_ev AS (SELECT aseq AS event_id, ts AS event_time, article_id FROM art_ord),
hist_e AS (
  SELECT c.aseq AS event_id, c.ts AS event_time, c.article_id, c.entity AS entity_id,
         c.k_last AS new_mentions, """ + r6("c.x_last") + """ AS new_sentiment,
         """ + r6("c.centrality") + """ AS new_centrality
  FROM cent2 c),
hist_r AS (
  SELECT a.aseq AS event_id, a.ts AS event_time, a.article_id, a.entity_1 AS source, a.entity_2 AS target,
         """ + r6("a.strength") + """ AS new_strength, """ + r6("a.joint_sentiment") + """ AS new_joint_sentiment
  FROM py a LEFT JOIN py b ON b.entity_1 = a.entity_1 AND b.entity_2 = a.entity_2 AND b.kk = a.kk - 1
  WHERE abs(round(a.strength - coalesce(b.strength, 0.0), 9)) >= 0.0001
     OR abs(round(a.joint_sentiment - coalesce(b.joint_sentiment, 0.0), 9)) >= 0.01),
hist_hay AS (
  SELECT event_id, lower(CAST(any_value(article_id) AS VARCHAR) || ' ' || string_agg(entity_id, ' ')) AS hay
  FROM hist_e GROUP BY event_id)"""

SNAPSHOT_CTES = """,
nx AS MATERIALIZED (
  SELECT e.event_id,
         least(CASE WHEN e.event_id + 100 <= (SELECT max(event_id) FROM hist_ev) THEN e.event_id + 100 END,
               (SELECT min(f.event_id) FROM hist_ev f WHERE f.event_time >= e.event_time + INTERVAL 10 MINUTE)) AS nxt
  FROM hist_ev e),
chain AS (
  SELECT CAST(1 AS BIGINT) AS event_id
  UNION ALL
  SELECT nx.nxt FROM chain JOIN nx ON nx.event_id = chain.event_id WHERE nx.nxt IS NOT NULL),
snaps AS (SELECT c.event_id AS snapshot_event_id, h.event_time AS snapshot_time FROM chain c JOIN hist_ev h USING (event_id))"""


def state_sel_cte(at: str) -> str:
    return f""",
sel AS (
  SELECT coalesce((SELECT max(snapshot_event_id) FROM snaps
                   WHERE snapshot_time = (SELECT max(snapshot_time) FROM snaps WHERE snapshot_time <= TIMESTAMP '{at}')), 0) AS s_id,
         coalesce((SELECT max(snapshot_time) FROM snaps WHERE snapshot_time <= TIMESTAMP '{at}'),
                  TIMESTAMP '1970-01-01 00:00:00') AS s_time)"""


ALGO_CTES = """,
g_nodes AS (SELECT DISTINCT entity AS node FROM ea),
g_edges AS (SELECT DISTINCT entity_1 AS source, entity_2 AS target FROM py),
g_adj AS (SELECT source AS src, target AS dst FROM g_edges UNION SELECT target AS src, source AS dst FROM g_edges),
last_art AS (SELECT article_id FROM arts ORDER BY ts DESC, article_id DESC LIMIT 1),
seeds AS (SELECT DISTINCT trim(entity) AS node FROM m WHERE article_id = (SELECT article_id FROM last_art)),
hop1 AS (SELECT DISTINCT a.dst AS node FROM seeds s JOIN g_adj a ON a.src = s.node
         WHERE a.dst NOT IN (SELECT node FROM seeds)),
hop2 AS (SELECT DISTINCT a.dst AS node FROM hop1 s JOIN g_adj a ON a.src = s.node
         WHERE a.dst NOT IN (SELECT node FROM seeds) AND a.dst NOT IN (SELECT node FROM hop1)),
khop AS (SELECT node, 0 AS dist FROM seeds UNION ALL SELECT node, 1 FROM hop1 UNION ALL SELECT node, 2 FROM hop2)"""


def pagerank_sql(nodes: str, adj: str, iters: int = 20, d: float = 0.85) -> str:
    """Unrolled power iteration over CTEs ``nodes``(node) and ``adj``(src, dst), both in the subset."""
    parts = [f"pr_nodes AS MATERIALIZED (SELECT DISTINCT node FROM {nodes})",
             f"pr_adj AS MATERIALIZED (SELECT a.src, a.dst FROM {adj} a WHERE a.src IN (SELECT node FROM pr_nodes)"
             f" AND a.dst IN (SELECT node FROM pr_nodes))",
             "pr_n AS (SELECT count(*) AS n FROM pr_nodes)",
             "pr_deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM pr_adj GROUP BY src)",
             "r0 AS MATERIALIZED (SELECT node, 1.0 / (SELECT n FROM pr_n) AS pr FROM pr_nodes)"]
    for i in range(1, iters + 1):
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT nd.node, (1.0 - {d}) / (SELECT n FROM pr_n) + coalesce(c.c, 0.0) AS pr "
            f"FROM pr_nodes nd LEFT JOIN (SELECT a.dst AS node, sum({d} * r.pr / dg.deg) AS c FROM pr_adj a "
            f"JOIN r{i - 1} r ON r.node = a.src JOIN pr_deg dg ON dg.src = a.src GROUP BY a.dst) c ON c.node = nd.node)")
    return ",\n" + ",\n".join(parts) + (
        f"\nSELECT node, {r6(f'pr / (SELECT sum(pr) FROM r{iters})')} AS pagerank FROM r{iters}")


def bfs_sql(subset: str, adj: str, levels: int = 25) -> str:
    """Unrolled BFS from the 16 sampled sources inside ``subset``(node) -> CTE bfs(source, node, dist)."""
    parts = [f"b_nodes AS MATERIALIZED (SELECT DISTINCT node FROM {subset})",
             f"b_adj AS MATERIALIZED (SELECT a.src, a.dst FROM {adj} a WHERE a.src IN (SELECT node FROM b_nodes)"
             f" AND a.dst IN (SELECT node FROM b_nodes))",
             "b_src AS MATERIALIZED (SELECT node AS source FROM b_nodes ORDER BY md5('42:' || node), node LIMIT 16)",
             "l0 AS MATERIALIZED (SELECT source, source AS node FROM b_src)",
             "v0 AS MATERIALIZED (SELECT source, node, 0 AS dist FROM l0)"]
    for i in range(1, levels + 1):
        parts.append(f"l{i} AS MATERIALIZED (SELECT DISTINCT l.source, a.dst AS node FROM l{i - 1} l "
                     f"JOIN b_adj a ON a.src = l.node WHERE NOT EXISTS (SELECT 1 FROM v{i - 1} v "
                     f"WHERE v.source = l.source AND v.node = a.dst))")
        parts.append(f"v{i} AS MATERIALIZED (SELECT * FROM v{i - 1} UNION ALL SELECT source, node, {i} FROM l{i})")
    parts.append(f"bfs AS (SELECT * FROM v{levels})")
    return ",\n" + ",\n".join(parts)


ROUTING_CTES = """,
clients AS (SELECT s_name AS client_id, 'part-' || CAST(s_suppkey AS VARCHAR) AS term FROM supplier),
subs AS (SELECT DISTINCT s.s_name AS client_id, 'part-' || CAST(l.l_partkey AS VARCHAR) AS entity
         FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey),
tm AS (SELECT DISTINCT c.client_id, h.event_id FROM clients c JOIN hist_hay h ON contains(h.hay, c.term)),
sm AS (SELECT DISTINCT s.client_id, e.event_id FROM subs s JOIN hist_e e ON e.entity_id = s.entity),
routed AS (SELECT client_id, event_id FROM tm INTERSECT SELECT client_id, event_id FROM sm)"""
