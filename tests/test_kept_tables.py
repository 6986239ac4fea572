"""What the queries on the fold and on routed events leave on disk while they run."""

import datetime as dt
import random

import pytest

from mentiongraph.operators import routing as rt
from mentiongraph.plans import catalog
from mentiongraph.session import Scratch


@pytest.fixture
def tables(spark, tmp_path):
    rnd, lines = random.Random(3), []
    for order in range(20):
        for line in range(rnd.randint(1, 5)):
            lines.append((order, rnd.randrange(6), rnd.randrange(3), line, 1.0, 10.0, rnd.randrange(11) / 100, 0.0, "N", "O", dt.date(1995, 1, 1)))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, dt.datetime(1995, 1, 1 + o // 2)) for o in range(20)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p, f"Brand#{p}") for p in range(6)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, read", [
    ("entity_deltas", {"fold-articles", "fold-centrality"}), ("node_state", {"fold-articles", "fold-centrality"}), ("edge_state", {"fold-edges"}),
    ("edge_deltas", {"fold-edges"}), ("degree_centrality", {"fold-centrality"}), ("graph_totals_by_article", {"fold-totals"})])
def test_only_the_tables_that_a_query_reads_are_kept(spark, tables, monkeypatch, name, read):
    made = []
    init = Scratch.__init__
    monkeypatch.setattr(Scratch, "__init__", lambda self, *a, **k: (init(self, *a, **k), made.append(self))[0])
    rows = catalog.QUERIES[name](spark, tables)
    assert rows.count() > 0 and [set(s.paths) for s in made] == [read]


def test_routing_by_written_tables_equals_the_lazy_one(spark):
    rnd = random.Random(12)
    events = spark.createDataFrame([(e, f"art-{e % 7}", f"part-{rnd.randrange(30)}") for e in range(40) for _ in range(2)],
                                   "event_id long, article_id string, entity_id string")
    clients = spark.createDataFrame([(f"c{i}",) for i in range(6)], "client_id string")
    terms = spark.createDataFrame([(f"c{i}", f"part-{i}") for i in range(4)], "client_id string, term string")
    subs = spark.createDataFrame([(f"c{i}", f"part-{rnd.randrange(30)}") for i in range(6) for _ in range(9)], "client_id string, entity string")
    scratch = Scratch(spark, free_shuffles=True)
    written = rt.route(events, terms, subs, clients, scratch)
    got = sorted(map(tuple, written.collect()))
    assert got and got == sorted(map(tuple, rt.route(events, terms, subs, clients).collect()))
    assert set(scratch.paths) == {"route-tokens", "route-found"}
