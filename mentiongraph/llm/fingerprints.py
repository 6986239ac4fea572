"""SimHash fingerprints of documents, with DataFrame functions only.

Terms are the words of a text: of a near copy by five-word shingles at 0.75 or more, nearly all words stay the same, while
each changed word changes five shingles. A word found n times in the text has the weight 1 + floor(log2(n)), so that words
that fill every text do not outvote the others: of its occurrences the first, second, fourth, eighth and so on have one vote
each. The 64 signed votes are summed as 16 longs of four 16-bit lanes: a vote adds ``(hash >> k) & 0x0001000100010001`` to
the k-th long, at most 32,767 votes to one sum.

Neighbours within a Hamming radius come from permuted block tables: 64 bits in radius + 2 blocks; two
fingerprints that differ in at most radius bits agree on two whole blocks, so one of the tables, each
keyed by two blocks (for five bits 21 tables with keys of 18 bits), holds both under one key. Equal fingerprints are one class.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, partitions
from .quality_rules import words_of
from .tables import Scratch

LANES = 0x0001000100010001
CHUNK = 32767
KEY_BLOCKS = 2
DOUBLINGS = 31  # a word has fewer than 2 ** 31 occurrences in a text


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def block_masks(radius: int) -> list[int]:
    """A mask for each choice of two of the radius + 2 blocks, whose widths differ by one bit at most."""
    blocks = radius + KEY_BLOCKS
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(c)) for c in combinations(masks, KEY_BLOCKS)]


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of bits that differ."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def _has_vote(hashes: Column, x: Column, i: Column) -> Column:
    """Whether the i-th of sorted hashes is the first, second, fourth, eighth ... of those equal to it."""
    def at_least(n: int) -> Column:  # whether n equal ones end here
        return F.get(hashes, i - (n - 1)).eqNullSafe(x)

    vote = F.when(~at_least(2), True)
    for k in range(1, DOUBLINGS):
        vote = vote.when(~at_least(2**k), False).when(~at_least(2**k + 1), True)
    return vote.otherwise(False)


def simhash(texts: DataFrame, keys: list[str], weighted: bool = True) -> DataFrame:
    """(keys..., fp): the fingerprint of ``text`` per row, 0 without words; keys must be unique and fixed-width columns.
    Without ``weighted`` every word has the weight one, however often it occurs."""
    hashes = F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x))
    if weighted:
        texts = texts.select(*keys, F.sort_array(hashes).alias("hashes"))
        terms = F.filter("hashes", lambda x, i: _has_vote(F.col("hashes"), x, i))
    else:
        terms = F.array_distinct(hashes)
    votes = texts.select(*keys, F.posexplode_outer(terms).alias("i", "t"))
    votes = votes.select(*keys, F.coalesce(F.floor(F.col("i") / CHUNK), F.lit(0)).cast("int").alias("chunk"), "t")
    sums = votes.groupBy(*keys, "chunk").agg(
        F.count("t").alias("n"), *(F.sum(F.shiftrightunsigned("t", k).bitwiseAND(F.lit(LANES))).alias(f"s{k}") for k in range(16)))
    lane = {k + 16 * j: F.coalesce(F.shiftrightunsigned(f"s{k}", 16 * j).bitwiseAND(F.lit(0xFFFF)), F.lit(0)) for k in range(16) for j in range(4)}
    total = sums.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(lane[b]).alias(f"b{b}") for b in range(64)))
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(_signed(1 << b))).otherwise(F.lit(0).cast("long")))
    return total.select(*keys, fp.alias("fp"))


def _ordered(docs: DataFrame) -> DataFrame:
    """(bucket, at, doc_id, text, following, ghost): documents by descending id within ranges of ids, each
    with the text of the next one. A range's last row is a ghost: the next range's first document."""
    spark = docs.sparkSession
    parts = partitions(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10000)).first()[0] or []
    # doc_ids as literals: as many as there are partitions
    bucket = F.size(F.filter(F.array(*(F.lit(int(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>"),
                             lambda c: c < F.col("doc_id")))
    placed = docs.withColumn("bucket", bucket)
    heads = sorted((r.bucket, r.hi) for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("hi")).collect())  # a row per range
    ghosts = [(hi, heads[(i + 1) % len(heads)][0]) for i, (_, hi) in enumerate(heads)]
    ghost_ids = spark.createDataFrame(ghosts, "doc_id long, bucket int")
    copies = docs.join(F.broadcast(ghost_ids), "doc_id").groupBy("doc_id", "bucket").agg(F.min("text").alias("text"))
    every = placed.select("bucket", "doc_id", "text", F.lit(0).alias("ghost")).unionByName(copies.select("bucket", "doc_id", "text", F.lit(1).alias("ghost")))
    w = Window.partitionBy("bucket").orderBy("ghost", F.desc("doc_id"), "text")
    return every.select("bucket", F.row_number().over(w).alias("at"), "doc_id", "text", "ghost", F.lead("text").over(w).alias("following"))


def near_fingerprints(classes: DataFrame, queries: DataFrame, radius: int = 5) -> DataFrame:
    """(q, fp, members) for every query fingerprint q and every other class within the radius.

    classes: (fp, members), one row per fingerprint; queries: (q), distinct fingerprints.
    """
    def dealt(df: DataFrame, fp: str) -> DataFrame:
        keys = F.array(*(F.xxhash64(F.lit(t), F.col(fp).bitwiseAND(F.lit(mask))) for t, mask in enumerate(block_masks(radius))))
        return df.select(fp, F.explode(keys).alias("key"))  # two longs a row and table: the table is in the key

    met = dealt(classes, "fp").join(dealt(queries, "q"), "key")
    pairs = met.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("q"))) <= radius) & (F.col("fp") != F.col("q"))).select("q", "fp").distinct()
    return pairs.join(classes, "fp").select("q", "fp", "members")


def fingerprints(docs: DataFrame, query_step: int = 50, radius: int = 5, weighted: bool = False) -> DataFrame:
    """Per input row with an id: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, near_docs, near_classes, nearest.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as
    many of the next document by descending doc_id (after the last: the first). near_docs: for ids
    divisible by ``query_step``, how many other documents have a fingerprint within ``radius`` bits
    (null for others); near_classes: how many other fingerprints these have, nearest: of them the one with the fewest bits apart
    (ties: the smallest as a signed number). ``near_pairs`` gives all of them. ``weighted``: see :func:`simhash`. Null text is empty, with fingerprint 0; rows with null doc_id are left out;
    repeated ids follow each other by text; an empty table gives an empty result; further columns are
    not read.
    """
    docs = id_text(docs).where("doc_id is not null")
    ordered = _ordered(docs)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.coalesce("following", F.lit("")), F.lit(1), half))
    facts = ordered.select("bucket", "at", "doc_id", "ghost", F.char_length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    both = ordered.select("bucket", "at", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.when(F.col("ghost") == 0, edited).alias("text")))).alias("v"))
    marks = simhash(both.select("bucket", "at", "v.side", F.coalesce("v.text", F.lit("")).alias("text")), ["bucket", "at", "side"], weighted)
    pair = marks.groupBy("bucket", "at").agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"))
    w = Window.partitionBy("bucket").orderBy("at")
    rows = facts.join(pair, ["bucket", "at"]).withColumn("next_fp", F.lead("fp").over(w)).where("ghost = 0")
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", F.coalesce("next_fp", "fp").alias("next_fp"))
    rows = Scratch(docs.sparkSession, free_shuffles=True).write("fingerprints", rows)  # the texts were shuffled, no later step needs them
    classes = rows.groupBy("fp").agg(F.count("*").alias("members"))
    queries = rows.where(F.col("doc_id") % query_step == 0).select(F.col("fp").alias("q")).distinct()

    def text(c: str) -> Column:
        return F.lpad(F.lower(F.hex(c)), 16, "0")

    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("q")))
    others = near_fingerprints(classes, queries, radius).groupBy("q").agg(
        F.sum("members").alias("others"), F.count("*").alias("near_classes"), F.min(F.struct(apart.alias("bits"), "fp"))["fp"].alias("nearest"))
    found = queries.join(classes.withColumnRenamed("fp", "q"), "q").join(others, "q", "left") \
        .select(F.col("q").alias("fp"), (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("near_docs"),
                F.coalesce("near_classes", F.lit(0)).cast("long").alias("near_classes"), "nearest")
    # only the rows of queries look for what was found, so a group of equal texts does not gather at one key
    asked, rest = F.col("doc_id") % query_step == 0, rows.where(F.col("doc_id") % query_step != 0)
    answers = rows.where(asked).join(found, "fp").unionByName(rest, allowMissingColumns=True)
    return answers.select(
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "near_docs", "near_classes", text("nearest").alias("nearest"))


def near_pairs(marks: DataFrame, query_step: int = 50, radius: int = 5) -> DataFrame:
    """(doc_id, fingerprint): for ids divisible by ``query_step`` each fingerprint of the table within ``radius`` bits,
    the document's own included.

    ``marks``: the rows of :func:`fingerprints`; those with a pair's fingerprint are the documents met, so a
    large group of equal texts is one pair and not one for each member.
    """
    rows = marks.select("doc_id", F.conv("fingerprint", 16, -10).cast("long").alias("fp"))
    wanted = rows.where(F.col("doc_id") % query_step == 0).withColumnRenamed("fp", "q").distinct()
    queries = wanted.select("q").distinct()
    met = near_fingerprints(rows.groupBy("fp").agg(F.count("*").alias("members")), queries, radius).select("q", "fp")
    met = met.unionByName(queries.select("q", F.col("q").alias("fp")))
    return wanted.join(met, "q").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"))
