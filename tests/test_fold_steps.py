"""The graph fold's steps: keys of few and of many rows give the same, and nothing is left on the local disks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from mentiongraph.functions import scan
from mentiongraph.operators import graph_algo as ga
from mentiongraph.operators import graph_state as gs

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _mentions(spark, articles=120):
    rnd, rows = random.Random(5), []
    for a in range(articles):
        for s in range(4):
            rows.append((a, T0 + dt.timedelta(hours=a // 2), "hot" if s == 0 else f"e{rnd.randrange(12)}", "T", s, rnd.choice([-1.0, -0.4, 0.2, 0.8]), s))
            rows.append((a, T0 + dt.timedelta(hours=a // 2), "warm" if s < 2 else f"e{rnd.randrange(3)}", "T", s, rnd.choice([-1.0, 0.2]), 9 + s))
    return spark.createDataFrame(rows, "article_id long, ts timestamp_ntz, entity string, etype string, sent_idx int, score double, char_start int")


def _outputs(fold):
    frames = [gs.entity_changes(fold), gs.edge_changes(fold), gs.edge_state(fold), gs.degree_centrality(fold), fold.totals,
              ga.relationship_strength(fold), fold.mention_steps.select("entity", "article_id", "k", F.round("x", 9).alias("x"))]
    return [sorted(map(tuple, f.collect())) for f in frames]


def test_keys_of_few_and_many_rows_fold_alike(spark, monkeypatch):
    """One window per key, buckets and blocks for all keys, and both mixed."""
    m = _mentions(spark)
    want = _outputs(gs.fold_graph(m, ["sent_idx", "char_start"]))
    for most in (0, 100):
        monkeypatch.setattr(gs, "short_rows", lambda _alpha: most)
        assert _outputs(gs.fold_graph(m, ["sent_idx", "char_start"])) == want


def test_fold_frees_its_shuffle_files_and_changes_need_no_self_join(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum(".data" in str(f) for f in disk.getAllFiles().toList().mkString(" ").split())

    before = shuffled()
    fold = gs.fold_graph(_mentions(spark, 20), ["sent_idx", "char_start"])
    assert shuffled() <= before
    assert "Exchange" not in gs.edge_changes(fold)._jdf.queryExecution().executedPlan().toString()


def test_only_full_blocks_carry(spark):
    """A key of one block sends nothing into later blocks; sums over several blocks stay exact."""
    blocks = spark.createDataFrame([(f"k{i}", 0, 1.0, False) for i in range(50)] + [("long", 0, 2.0, True), ("long", 1, 3.0, False)],
                                   "key string, _ew_blk long, _ew_B0 double, _ew_full boolean")
    got = scan._carry(blocks, ["key"], 1, -3.0)
    assert {r.key for r in got.collect()} == {"long"} and got.where("_ew_blk = 1").first()["_ew_C0"] == 2.0


def test_short_scan_equals_the_blocked_scan(spark):
    """With nulls and with a prior value."""
    rnd, rows = random.Random(3), []
    for key in range(6):
        for n in range(1, 3 + 40 * key):
            rows.append((key, n, None if n < 3 and key % 2 or 60 < n < 70 else rnd.choice([-1.0, 0.4]), None if key % 3 else 0.5))
    df = spark.createDataFrame(rows, "key int, n long, v double, old double")
    few = scan.short_scan(df, ["key"], ["n"], "k", [("v", "x"), ("v", "y", "old")])
    many = scan.ewma_scan(scan.positions(df.withColumn("b", F.lit(0)), ["key"], ["n"], ["b"], "k"), ["key"], "k", [("v", "x"), ("v", "y", "old")])

    def values(d):
        return sorted((r.key, r.n, r.k, *(None if z is None else round(z, 9) for z in (r.x, r.y))) for r in d.collect())

    assert values(few) == values(many)
