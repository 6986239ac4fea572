"""Order-dependent folds expressed as distributed DataFrame plans.

Two building blocks:

``keyed_running_sum``  running sum of a value per key in a total order, computed in two levels:
    totals per (key, bucket) are prefix-summed over the buckets of a key (a small table), and a
    window partitioned by (key, bucket) finishes the sum inside each bucket. A bucket is a coarse,
    order-preserving prefix of the order (e.g. the day plus a range of the article key), so a hot
    key is spread over many window partitions instead of one task. With no key, this gives a
    global running sum without a single-partition window over all rows.

``ewma_scan``  every-step value of x <- a*x + (1-a)*v with x <- v on the first step, i.e.
    x_k = sum_j c_j v_j a^(k-j) with c_1 = 1 and c_j = 1-a otherwise. Positions are cut into
    blocks of at most ``BLOCK`` rows; the in-block part is a running sum with the exponent trick
    (the block is shortened where a^-(rows-1) would overflow). The carry into a block sums all
    earlier block summaries that count at double precision: while those are at most ``NEAR`` blocks,
    by an exploded equi-join on (key, block); for slower decay, groups of ``NEAR`` blocks are folded
    in an array and the groups carry into each other the same way. How far back that reaches
    follows from alpha alone, so no alpha loses history and no window runs over all blocks of a key.

``short_scan``  positions and the same EWMA for keys of at most ``short_rows`` rows: one window over
    the key, one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
NEAR = 64
NEGLIGIBLE = 1e-18  # below the last bit of a double
LARGEST_POWER = 1e100
SHORT_ROWS = 4096


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def keyed_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | str,
                      bucket: Sequence[str], out: str) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` ordered by ``order``; see ``keyed_running_sums``."""
    val = F.col(value) if isinstance(value, str) else value.cast("double")
    return keyed_running_sums(df, keys, order, {out: val}, bucket)


def keyed_running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                       bucket: Sequence[str]) -> DataFrame:
    """Inclusive running sums per ``keys`` ordered by ``order``: output name -> value, all from one set of shuffles.

    ``bucket`` names columns of ``df`` that are a monotone coarsening of ``order`` (rows in a
    lower bucket come first). ``order`` must make rows unique inside a key for a deterministic
    result.
    """
    keys, bucket = list(keys), list(bucket)
    # one struct for key and bucket: null fields compare as equal (nulls first), and the join and the window share its exchange
    group = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(bucket)]).alias("b"))
    n = range(len(values))
    tmp = df.withColumns({f"_rs_v{i}": v for i, v in enumerate(values.values())}).withColumn("_rs_g", group)
    per_bucket = tmp.groupBy("_rs_g").agg(*[F.sum(f"_rs_v{i}").alias(f"_rs_bt{i}") for i in n])
    wb = Window.partitionBy(*[F.col(f"_rs_g.k{i}") for i in range(len(keys))]).orderBy("_rs_g.b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("_rs_g", *[F.coalesce(F.sum(f"_rs_bt{i}").over(wb), F.lit(0)).alias(f"_rs_off{i}") for i in n])
    wi = Window.partitionBy("_rs_g").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    return (tmp.join(offsets, "_rs_g").withColumns({out: F.col(f"_rs_off{i}") + F.sum(f"_rs_v{i}").over(wi) for i, out in enumerate(values)})
            .drop("_rs_g", *[f"_rs_{c}{i}" for c in ("v", "off") for i in n]))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Sequence[str], out: str) -> DataFrame:
    """1-based position of each row inside its key (a running count)."""
    res = keyed_running_sum(df, keys, order, F.lit(1).cast("long"), bucket, out)
    return res.withColumn(out, F.col(out).cast("long"))


def _reach(q: float) -> int:
    """How many blocks back a carry still counts when one block weakens it by ``q``."""
    return 1 if q < NEGLIGIBLE else math.ceil(math.log(NEGLIGIBLE) / math.log(q))


def _carry(blocks: DataFrame, keys: list[str], n: int, log_q: float) -> DataFrame:
    """(keys, _ew_blk, _ew_C0..): C_t = sum over d >= 1 of B_(t-d) q^(d-1), for dense block numbers; a block that is not
    full (_ew_full) is its key's last and carries into none."""
    q = math.exp(log_q)
    if _reach(q) <= NEAR:
        near = blocks.where("_ew_full").select(*keys, "_ew_blk", *[f"_ew_B{i}" for i in range(n)],
                             F.explode(F.sequence(F.lit(1), F.lit(_reach(q)))).alias("_ew_d"))
        weight = F.pow(F.lit(q), F.col("_ew_d") - 1)
        return (near.select(*keys, (F.col("_ew_blk") + F.col("_ew_d")).alias("_ew_blk"),
                            *[(F.col(f"_ew_B{i}") * weight).alias(f"_ew_c{i}") for i in range(n)])
                .groupBy(*keys, "_ew_blk").agg(*[F.sum(f"_ew_c{i}").alias(f"_ew_C{i}") for i in range(n)]))
    row = F.struct((F.col("_ew_blk") % NEAR).cast("int").alias("i"), *[F.col(f"_ew_B{i}").alias(f"b{i}") for i in range(n)])
    groups = (blocks.withColumn("_ew_grp", F.floor(F.col("_ew_blk") / NEAR).cast("long"))
              .groupBy(*keys, "_ew_grp").agg(F.array_sort(F.collect_list(row)).alias("_ew_rows"))  # at most NEAR rows
              .withColumn("_ew_full", F.size("_ew_rows") == NEAR))

    def folded(rows: Column, upto: Column | int, i: int) -> Column:
        return F.aggregate(F.filter(rows, lambda x: x["i"] < upto), F.lit(0.0),
                           lambda acc, x: acc + x[f"b{i}"] * F.pow(F.lit(q), upto - 1 - x["i"]))

    whole = groups.select(*keys, F.col("_ew_grp").alias("_ew_blk"), "_ew_full",
                          *[folded(F.col("_ew_rows"), F.lit(NEAR), i).alias(f"_ew_B{i}") for i in range(n)])
    far = _carry(whole, keys, n, log_q * NEAR).withColumnRenamed("_ew_blk", "_ew_grp")
    own = groups.select(*keys, "_ew_grp", "_ew_rows", F.explode("_ew_rows").alias("_ew_row")).select(
        *keys, "_ew_grp", F.col("_ew_row.i").alias("_ew_i"),
        *[folded(F.col("_ew_rows"), F.col("_ew_row.i"), i).alias(f"_ew_P{i}") for i in range(n)])
    return own.join(far, keys + ["_ew_grp"], "left").select(
        *keys, (F.col("_ew_grp") * NEAR + F.col("_ew_i")).alias("_ew_blk"),
        *[(F.col(f"_ew_P{i}") + F.pow(F.lit(q), F.col("_ew_i")) * F.coalesce(f"_ew_C{i}", F.lit(0.0))).alias(f"_ew_C{i}")
          for i in range(n)])


def ewma_scan(df: DataFrame, keys: Sequence[str], pos: str, values: Sequence[tuple], alpha: float = 0.05) -> DataFrame:
    """Every-step EWMA values per key given a dense 1-based position column ``pos``.

    ``values`` is a list of ``(value_col, out_col)`` or ``(value_col, out_col, prior_col)``.
    Without a prior: x_1 = v_1, x_k = (1 - alpha) * x_{k-1} + alpha * v_k. With a non-null prior
    p (state carried from an earlier batch): x_0 = p, so x_k = p * a^k + sum_j alpha * v_j a^(k-j).
    Several values of the same key order share one set of shuffles.
    """
    keys = list(keys)
    if not 0 < alpha <= 1:
        raise ValueError("alpha lies above 0 and is at most 1")
    a = 1.0 - alpha
    log_a = math.log1p(-alpha) if alpha < 1 else -math.inf
    block = max(1, min(BLOCK, 1 + int(math.log(LARGEST_POWER) / -log_a)))
    k0 = F.col(pos) - 1
    specs = [(v[0], v[1], v[2] if len(v) > 2 else None) for v in values]
    base = df.withColumn("_ew_blk", F.floor(k0 / block).cast("long")).withColumn("_ew_off", (k0 % block).cast("int"))
    for i, (val, _out, prior) in enumerate(specs):
        first = F.lit(1.0) if prior is None else F.when(F.col(prior).isNull(), F.lit(1.0)).otherwise(F.lit(alpha))
        base = base.withColumn(f"_ew_b{i}", F.when(F.col(pos) == 1, first).otherwise(F.lit(alpha)) * F.col(val))
    # in-block running part: a^off * sum_{j<=k in block} b_j a^-off_j
    w = Window.partitionBy(*keys, "_ew_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    for i in range(len(specs)):
        base = base.withColumn(
            f"_ew_l{i}",
            F.pow(F.lit(a), F.col("_ew_off")) * F.sum(F.col(f"_ew_b{i}") * F.pow(F.lit(a), -F.col("_ew_off"))).over(w))
    # block summaries as if each block were full: value at the block end from in-block terms only
    summaries = base.groupBy(*keys, "_ew_blk").agg(*[
        F.sum(F.col(f"_ew_b{i}") * F.pow(F.lit(a), F.lit(block - 1) - F.col("_ew_off"))).alias(f"_ew_B{i}")
        for i in range(len(specs))], (F.max("_ew_off") == block - 1).alias("_ew_full"))
    carry = _carry(summaries, keys, len(specs), log_a * block)
    res = base.join(carry, keys + ["_ew_blk"], "left")
    drop = ["_ew_blk", "_ew_off"]
    for i, (_val, out, prior) in enumerate(specs):
        col = F.coalesce(F.col(f"_ew_C{i}"), F.lit(0.0)) * F.pow(F.lit(a), F.col("_ew_off") + 1) + F.col(f"_ew_l{i}")
        if prior is not None:
            col = col + F.coalesce(F.col(prior), F.lit(0.0)) * F.pow(F.lit(a), F.col(pos))
        res = res.withColumn(out, col)
        drop += [f"_ew_b{i}", f"_ew_l{i}", f"_ew_C{i}"]
    return res.drop(*drop)


def short_rows(alpha: float) -> int:
    """How many rows of a key ``short_scan`` may take at this alpha."""
    return max(1, min(SHORT_ROWS, 1 + int(math.log(LARGEST_POWER) / -math.log1p(-alpha)))) if alpha < 1 else 1


def short_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], pos: str, values: Sequence[tuple],
               alpha: float = 0.05) -> DataFrame:
    """``positions`` and ``ewma_scan`` for keys of at most ``short_rows(alpha)`` rows, in one window over the key.

    A step without a value in its block so far is null, as in the blocked scan.
    """
    a = 1.0 - alpha
    block = max(1, min(BLOCK, short_rows(alpha)))
    w = Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    res = df.withColumn(pos, F.count(F.lit(1)).over(w))
    k0 = F.col(pos) - 1
    for val, out, *prior in values:
        first = F.when(F.col(prior[0]).isNull(), F.lit(1.0)).otherwise(F.lit(alpha)) if prior else F.lit(1.0)
        weighed = F.when(F.col(pos) == 1, first).otherwise(F.lit(alpha)) * F.col(val) * F.pow(F.lit(a), -k0)
        col = F.pow(F.lit(a), k0) * F.sum(weighed).over(w)
        if prior:
            col = col + F.coalesce(F.col(prior[0]), F.lit(0.0)) * F.pow(F.lit(a), F.col(pos))
        last = F.max(F.when(F.col(val).isNotNull(), F.col(pos))).over(w)
        res = res.withColumn(out, F.when(F.floor((last - 1) / block) == F.floor(k0 / block), col))
    return res
