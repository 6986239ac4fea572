"""Graph measures carried from batch to batch (ST3, G5, G6, G8, G11) beside a held graph.

``HeldMetrics.apply`` takes a batch that the held graph has applied: the nodes it touches (mentioned,
or an end of a pair both of whose ends are known), their neighbourhood of ``hops`` steps, PageRank in it started
from the ranks held, and its bridge scores. New ranks of the neighbourhood are merged into the rank table
as a version's delta; other nodes keep theirs. Links are held by both their ends in hash parts, so
a step reads the parts and rows of its frontier and the work follows the neighbourhood. The top lists scan the rank table.

A batch is one update: with one article a batch, ranks and rows are those of article-wise
processing. Touched nodes are a table of their own, so a metrics row is bounded. Communities are not kept
here: ``graph_algo.communities`` computes them for the whole graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.versions import Commit, VersionedTables
from . import graph_algo as ga
from .held_graph import HeldGraph

PARTS = 64
COMPACT_EVERY = 16
LINK = "src string, dst string, part int"
RANK = "node string, pagerank double, betweenness double, part int"
TOP = 10


class HeldMetrics:
    def __init__(self, graph: HeldGraph, path: str, hops: int = ga.PAGERANK_HOPS, iterations: int = ga.PAGERANK_ITERATIONS,
                 samples: int = ga.BETWEENNESS_SAMPLES, parts: int = PARTS, compact_every: int = COMPACT_EVERY):
        self.graph, self.spark, self.hops, self.iterations, self.samples = graph, graph.spark, hops, iterations, samples
        self.parts, self.compact_every = parts, compact_every
        self.tables = VersionedTables(self.spark, path)

    def _part(self, col: str):
        return F.pmod(F.xxhash64(col), F.lit(self.parts)).cast("int").alias("part")

    # ------------------------------------------------------------------ reading

    def ranks(self, commit: Commit | None = None) -> DataFrame:
        """(node, pagerank, betweenness) of every node seen so far."""
        rows = self.tables.read("ranks", RANK, commit or self.tables.newest())
        return rows.groupBy("node").agg(F.max_by(F.struct("pagerank", "betweenness"), "version").alias("r")).select("node", "r.*")

    def rows(self) -> DataFrame:
        """One metrics row for each version."""
        return self.spark.read.parquet(f"{self.tables.path}/metrics").filter(F.col("version") <= self.tables.newest().version)

    def touched(self) -> DataFrame:
        """(node, version): the nodes that each version touched."""
        return self.spark.read.parquet(f"{self.tables.path}/touched").filter(F.col("version") <= self.tables.newest().version)

    def _of(self, table: str, schema: str, commit: Commit | None, nodes: DataFrame, on: str) -> DataFrame:
        """The stored rows of these nodes: their parts pruned, their names semi-joined."""
        keys = nodes.select(F.col("node").alias(on), self._part("node")).distinct()
        wanted = [r.part for r in keys.select("part").distinct().collect()]  # at most self.parts numbers
        return self.tables.read(table, schema, commit).filter(F.col("part").isin(wanted)).join(keys, [on, "part"], "left_semi")

    # ------------------------------------------------------------------ applying

    def _known_pairs(self, pairs: DataFrame) -> DataFrame:
        """(source, target) of the pairs of two different names, both nodes of the graph."""
        one, two = F.trim("entity_1"), F.trim("entity_2")
        named = pairs.select(F.least(one, two).alias("source"), F.greatest(one, two).alias("target")).filter("source <> '' and source <> target").distinct()
        ends = named.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        known = self.graph.known(ends)
        return named.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")

    def _near(self, now: Commit | None, fresh: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The nodes within ``hops`` of the touched ones, and the links among them."""
        visited = frontier = touched
        found = []
        for hop in range(max(0, self.hops) + 1):  # the last step only adds the links of the outermost nodes
            links = self._of("links", LINK, now, frontier, "src").select("src", "dst")
            links = links.unionByName(fresh.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))
            found.append(materialize(links.distinct(), "metrics-links"))
            if hop == self.hops:
                break
            frontier = materialize(found[-1].select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti"), "metrics-frontier")
            if frontier.isEmpty():
                break
            visited = materialize(visited.unionByName(frontier), "metrics-near")
        whole = found[0]
        for links in found[1:]:
            whole = whole.unionByName(links)
        return visited, materialize(ga.subset_adjacency(whole, visited), "metrics-adjacency")

    def apply(self, batch_id: int, mentions: DataFrame, pairs: DataFrame) -> None:
        """Measures of a batch (``mentions`` and ``pairs`` of ``HeldGraph.apply``, which came first)."""
        if self.tables.of_batch(batch_id) is not None:
            return
        now = self.tables.newest()
        version = now.version + 1 if now else 1
        known = materialize(self._known_pairs(pairs), "metrics-pairs")
        fresh = known.select(F.explode(F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")),
                                               F.struct(F.col("target").alias("src"), F.col("source").alias("dst")))).alias("l")).select("l.*")
        touched = materialize(mentions.select(F.trim("entity").alias("node")).filter("node <> ''")
                              .unionByName(fresh.select(F.col("src").alias("node"))).distinct(), "metrics-touched")
        near, adj = self._near(now, fresh, touched)
        old = self._of("ranks", RANK, now, near, "node").groupBy("node").agg(F.max_by(F.struct("pagerank", "betweenness"), "version").alias("r"))
        old = materialize(old.select("node", "r.*"), "metrics-old")
        if near.isEmpty():
            ranks = near.select("node", F.lit(0.0).alias("pagerank"), F.lit(0.0).alias("betweenness"))
        else:
            pr = ga.pagerank(adj, near, old, iterations=self.iterations)
            bridges = ga.bridge_score(adj, near, self.samples).withColumnRenamed("betweenness", "_b")
            ranks = pr.join(bridges, "node", "left").join(old.select("node", F.col("betweenness").alias("_o")), "node", "left") \
                .select("node", "pagerank", F.coalesce("_b", "_o", F.lit(0.0)).alias("betweenness"))
        ranks = materialize(ranks, "metrics-ranks")
        links = fresh.select("src", "dst")
        whole = now is not None and version % self.compact_every == 0
        table = ranks.unionByName(self.ranks(now).join(ranks, "node", "left_anti")) if now else ranks
        if whole:
            links = links.unionByName(self.tables.read("links", LINK, now).select("src", "dst")).distinct()
        self.tables.write("links", version, links.select("src", "dst", self._part("src")), ("part",))
        self.tables.write("ranks", version, (table if whole else ranks).select("node", "pagerank", "betweenness", self._part("node")), ("part",))
        self.tables.write("touched", version, touched)
        counts = mentions.agg(F.count_distinct("article_id"), F.max("ts")).first()
        updates = (now.totals["updates"] if now else 0) + counts[0]
        self.tables.write("metrics", version, self._row(table, touched, updates, counts[1]))
        self.tables.commit(version, batch_id, version if whole or now is None else now.base, {"updates": updates})

    def _row(self, ranks: DataFrame, touched: DataFrame, updates: int, at) -> DataFrame:
        totals = self.graph.totals()

        def top(score: str) -> DataFrame:
            best = ga.top_k(ranks.select("node", score), score, TOP).agg(F.collect_list(F.struct((-F.col(score)).alias("o"), "node", score)).alias("l"))
            return best.select(F.transform(F.array_sort("l"), lambda e: F.struct(e["node"].alias("node"), e[score].alias(score))).alias(f"top_{score}"))

        row = touched.agg(F.count("*").alias("n_touched")).join(top("pagerank")).join(top("betweenness"))  # one row each
        return row.select(F.lit(at).cast("timestamp_ntz").alias("timestamp"), F.lit(updates).cast("long").alias("updates_processed"),
                          F.lit(totals["node_count"]).cast("long").alias("node_count"), F.lit(totals["edge_count"]).cast("long").alias("edge_count"),
                          "n_touched", "top_pagerank", F.col("top_betweenness").alias("top_bridge_nodes"))
