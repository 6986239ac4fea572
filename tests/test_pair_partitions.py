"""Co-occurrence pairs with a given number of partitions equal those without, in that many tasks."""

import random

from mentiongraph.operators import cooccurrence as co
from mentiongraph.sources import adapters


def test_pairs_by_given_partitions(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(30), rnd.randrange(5), rnd.choice([" a", "b", "c ", "d", "", None])) for _ in range(600)] + [(None, 1, "a"), (None, 1, "b"), (3, None, "a")]
    m = spark.createDataFrame(rows, "article_id long, sent_idx int, entity string")
    plain, dealt = co.cooccurrence_pairs(m, 2), co.cooccurrence_pairs(m, 2, partitions=7)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    assert dealt.rdd.getNumPartitions() == 7
    a, b = co.pair_totals(plain), co.pair_totals(dealt, 7)
    assert a.dtypes == b.dtypes and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert co.top_pairs(plain, 3).collect() == co.top_pairs(dealt, 3, 7).collect()


def test_tasks_grow_with_the_lines(spark, tmp_path, monkeypatch):
    spark.range(100).withColumnRenamed("id", "l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert adapters.mention_partitions(spark, str(tmp_path)) is None
    monkeypatch.setattr(adapters, "MENTIONS_PER_TASK", 10)
    assert adapters.mention_partitions(spark, str(tmp_path)) == 10
