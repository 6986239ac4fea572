"""N-gram Jaccard join by vertical partitioning.

The global order of the n-grams is that of their 64-bit hashes. It is cut into fragments; every
document's set is cut with it, each fragment counts the partial overlap of a pair on its own, and the
sum over the fragments decides the link. Equal sets form one class first and are represented once.

1. Screen. Two sets with Jaccard >= t share at least ceil(t * size) n-grams, so their first n-grams
   in the order overlap: of the first ``size - ceil(t size) + extra`` at least ``extra`` are common.
   Only these are counted (:mod:`postings`, by fragment), and a class stays only if enough of its
   prefix occurs in another class. Most documents end here.
2. Candidates. Of each remaining class, the n-grams of its whole set that others of these classes hold
   are put in order of how many hold them. A link may do without all but ceil(t * size), so its
   partners meet in one of the rarest ``shared - ceil(t * size) + 1``. Buckets (one per n-gram) with
   the same members are one bucket.
3. Rounds. A bucket's pivot, its member with most in common with others, meets the other members; a
   pair already in one component is not formed again, nor one that cannot link because too few of its
   shared n-grams are left from the bucket's own on, or too many bits of one set's 2,048-bit signature are missing
   in the other's (each stands for an n-gram that is missing too). Pivots then leave the bucket and their number grows eightfold,
   until every bucket is used up or lies within one component. A group of m near copies so costs
   about m pairs, and no link between components is missed.
4. Pairs are joined with both members' fragments, partial overlaps are summed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import postings
from .common import carried, gram_hashes, id_text, map_arrow, mix, partitions, squeezed, text_groups, uncarried, word_hashes
from .components import components
from .tables import Scratch

ALONE = 0


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; the whole sequence as one gram if it has fewer words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return mix(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(gram_hashes(words, n))


def set_class(grams: np.ndarray) -> int:
    """A 64-bit name of the set (as signed); equal sets have equal names. 0 is kept for empty sets."""
    if not len(grams):
        return ALONE
    total = np.add.reduce(mix(grams), keepdims=True) + np.bitwise_xor.reduce(grams, keepdims=True) * np.uint64(0x9E3779B97F4A7C15)
    name = int(mix(total + np.uint64(len(grams))).view(np.int64)[0])
    return name or 1


def signature(grams: np.ndarray) -> np.ndarray:
    """2,048 bits, one for each n-gram's lowest bits, as signed longs."""
    bits = np.zeros(2048, dtype=np.uint8)
    bits[(grams & np.uint64(2047)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _bits(a: str, b: str):
    """Column: how many bits two signatures have in common (one expression, so it is compiled)."""
    total = F.bit_count(F.get(a, F.lit(0)).bitwiseAND(F.get(b, F.lit(0))))
    for i in range(1, 32):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.get(b, F.lit(i))))
    return total


def extra(n):
    """How many common n-grams the screen asks of the prefix of a set of n."""
    return n // 8 if n >= 16 else 1


def shared_at_least(n: int, percent: int) -> int:
    """ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def _screen(n: int, percent: int, parts: int):
    def run(batches):
        out = postings.Writer(parts, distinct=True)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for first, _, texts in text_groups(batch):
                words, off = word_hashes([t.lower() for t in texts])
                sizes, names, seen, grams, classes = [], [], set(), [], []
                for i in range(len(texts)):
                    g = shingle_set(words[off[i]:off[i + 1]], n)
                    name = set_class(g)
                    sizes.append(len(g))
                    names.append(name)
                    if len(g) and name not in seen:
                        seen.add(name)
                        p = g[: min(len(g), len(g) - shared_at_least(len(g), percent) + extra(len(g)))]
                        grams.append(p)
                        classes.append(np.full(len(p), name, np.int64))
                k = np.array(names, dtype=np.int64)
                # documents pass through to the same table: (hash: doc_id, key: class, place: set size)
                out.add_rows(ids[first:first + len(texts)].view(np.uint64), k, np.array(sizes, dtype=np.int32))
                if grams:
                    g = np.concatenate(grams)
                    out.add(g, np.concatenate(classes), np.zeros(len(g), np.int32))
                if out.full():
                    yield from out.flush()
        yield from out.flush()

    return run


def _screened(batches):
    """Documents, and each (n-gram, class) once whose n-gram another class has, too: all of an n-gram lies in one partition."""
    found = []
    for kind, h, k, p in postings.repeated_postings(batches, distinct=True):
        if kind == postings.ROWS:
            yield _screen_rows(1, h, k, p)
        else:
            found.append((h, k, p))
    if found:
        yield _screen_rows(0, *postings.sort_postings(*(np.concatenate(x) for x in zip(*found)), True))


def _screen_rows(doc: int, h, k, p) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), doc, np.int32)), pa.array(h.view(np.int64)), pa.array(k), pa.array(p.astype(np.int64))],
                                      ["doc", "h", "c", "n"])


def _fragments(n: int, cuts: int):
    """Each text's set cut at the fragment bounds, if it is the set of the class it stands for."""
    def run(batches):
        for batch in batches:
            wanted = batch.column("c").to_pylist()
            for first, _, texts in text_groups(batch, "z"):
                words, off = word_hashes([t.lower() for t in texts])
                cs, fs, arrays, ns, signs = [], [], [], [], []
                for i in range(len(texts)):
                    g = shingle_set(words[off[i]:off[i + 1]], n)
                    c = wanted[first + i]
                    if set_class(g) != c:
                        continue
                    edges = np.searchsorted((g >> np.uint64(32)) * np.uint64(cuts) >> np.uint64(32), np.arange(cuts + 1))
                    sign = signature(g)
                    for f in range(cuts):
                        if edges[f + 1] > edges[f]:
                            signs.append(sign)
                            sign = None  # with the first fragment only
                            cs.append(c)
                            fs.append(f)
                            ns.append(len(g))
                            arrays.append(g[edges[f]:edges[f + 1]].view(np.int64))
                if cs:
                    off2 = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
                    grams = pa.ListArray.from_arrays(pa.array(off2), pa.array(np.concatenate(arrays)))
                    yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(fs, pa.int32()), pa.array(ns, pa.int64()), grams,
                                                      pa.array(signs, pa.list_(pa.int64()))], ["c", "f", "n", "grams", "sign"])

    return run


def _needed(size: str, percent: int):
    """Column: the shared prefix n-grams that a link asks of a set of this size (that of the smallest partner)."""
    smallest = F.ceil(F.col(size) * percent / 100).cast("long")
    return F.when(smallest >= 16, F.floor(smallest / 8)).otherwise(F.lit(1)).cast("long")


def _survivors(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(c, doc_id): classes with as many shared prefix n-grams as a link asks, first in all, then with the classes that are left."""
    enough = F.col("held") >= _needed("n", percent)
    held = shared.groupBy("c").agg(F.count("*").alias("held")).join(classes.select("c", "n"), "c").where(enough)
    live = shared.join(held.select("c", "n"), "c")
    often = live.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h")
    left = live.join(often, "h").groupBy("c").agg(F.count("*").alias("held"), F.max("n").alias("n")).where(enough).select("c")
    return left.join(classes.select("c", F.col("first").alias("doc_id")), "c")


def _set_postings(parts: int):
    """Every n-gram of every set, and one row for each set with its size as a negative place."""
    def run(batches):
        out = postings.Writer(parts, distinct=True)
        for batch in batches:
            off = batch.column("grams").offsets.to_numpy()
            h, c = batch.column("grams").values.to_numpy().view(np.uint64), batch.column("c").to_numpy()
            once = batch.column("first").to_numpy(zero_copy_only=False)
            out.add_rows(h[off[:-1][once]], c[once], -batch.column("n").to_numpy()[once].astype(np.int32))
            out.add(h[off[0]:off[-1]], np.repeat(c, np.diff(off)), np.zeros(off[-1] - off[0], np.int32))
            if out.full():
                yield from out.flush()
        yield from out.flush()

    return run


def _prefixes(percent: int):
    """The rarest shared n-grams of each set: all but those that a link may do without, and one more."""
    def run(batches):
        h, k, p = postings.gathered(batches)
        h = h.view(np.int64)  # ties in the order that the tables have
        order = np.lexsort((h, p, k))
        h, k, p = h[order], k[order], p[order].astype(np.int64)
        first = np.flatnonzero(postings.starts(k))  # the set's size, then its shared n-grams, the rarest first
        held = np.diff(np.append(first, len(k)))
        n, common = -p[first], held - 1
        keep = common + 1 + (-percent * n // 100)
        weight = (np.add.reduceat(p, first) + n) / n if len(first) else np.zeros(0)
        at = np.arange(len(k)) - np.repeat(first, held)
        take = (at > 0) & (at <= np.repeat(keep, held))
        cols = [np.repeat(x, held)[take] for x in (n, common, weight)] + [at[take], p[take]]
        for i in range(0, int(take.sum()), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (h[take], k[take], *cols)], ["h", "c", "n", "common", "weight", "at", "df"])

    return run


def _buckets(fragments: DataFrame, percent: int, parts: int, scratch: Scratch) -> DataFrame:
    """(h, c, n, common, weight, at): for each n-gram that must be looked at, the sets that hold it.

    common: how many of the set's n-grams occur in another of the sets left. weight: how common they are
    there, so that the text that near copies were made from comes first. at: the n-gram's place among the
    set's shared ones.
    """
    sets = map_arrow(fragments.select("c", "n", "grams", F.col("sign").isNotNull().alias("first")), _set_postings(parts), postings.SCHEMA)
    kept = scratch.write("kept", map_arrow(postings.frequencies_by_key(sets, parts), _prefixes(percent), "h long, c long, n long, common long, weight double, at long, df long"))
    # buckets with the same members are one, the first in the order
    names = kept.groupBy("h").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("c")).alias("x"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("df").alias("df")).where("m > 1")
    once = names.groupBy("m", "x", "lo", "hi").agg(F.min(F.struct("df", "h")).alias("first")).select("first.h")
    out = scratch.write("buckets", kept.drop("df").join(once, "h"))
    scratch.drop("kept")
    return out


def _may_link(common, percent: int):
    """Column: whether sets of n and pn n-grams with that many in common (at most) can link."""
    return common * 100 >= (F.col("n") + F.col("pn") - common) * percent


def _alike(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures leave enough n-grams in common."""
    a = signs.select(F.col("c").alias("a"), "n", "sign", "bits")
    b = signs.select(F.col("c").alias("b"), F.col("n").alias("pn"), F.col("sign").alias("psign"), F.col("bits").alias("pbits"))
    both = _bits("sign", "psign")
    most = F.least(F.col("n") - F.col("bits") + both, F.col("pn") - F.col("pbits") + both)
    return pairs.join(a, "a").join(b, "b").where(_may_link(most, percent)).select("a", "b")


def _pairs(buckets: DataFrame, round_no: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of this round's pivots with the other members of another component, and the buckets without the pivots."""
    order = F.xxhash64("c")
    top = buckets.groupBy("h").agg(F.max(F.struct("weight", order.alias("o"), "c", "n", "common", "comp", "at")).alias("first"),
                                   F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("m > 1 and x <> y")
    live = buckets.join(top.select("h", "first", "m"), "h")
    # if this n-gram is the first that the two have in common, so many can follow; it is that in one of their buckets
    most = F.least(F.col("common") - F.col("at"), F.col("pcommon") - F.col("pat")) + 1
    possible = (F.col("c") != F.col("p")) & (F.col("comp") != F.col("pcomp")) & _may_link(most, percent)
    own = ["h", "c", "n", "common", "comp", "at"]
    if round_no < 2:
        met = live.select(*own, *(F.col(f"first.{x}").alias(f"p{x}" if x != "c" else "p") for x in own[1:]))
        rest = live.where("c <> first.c")
    else:
        share = F.least(F.lit(1.0), F.lit(8.0 ** (round_no - 1)) / F.col("m"))
        chosen = ((order.cast("double") / 2.0**64 + 0.5) <= share) | (F.col("c") == F.col("first.c"))
        pivots = live.where(chosen).select("h", *(F.col(x).alias(f"p{x}" if x != "c" else "p") for x in own[1:]))
        met = live.select(*own).join(pivots, "h")
        rest = live.where(~chosen)
    pairs = met.where(possible).select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct()
    return pairs, rest.select("h", "c", "n", "common", "weight", "at")


def _ends(table: DataFrame, pairs: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """The rows of ``table`` for the classes in ``pairs``, as a table of its own: what a round reads follows its pairs."""
    ends = scratch.write(f"{name}-ends", pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    return scratch.write(name, table.join(ends, "c", "left_semi"))


def _linked(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Pairs whose overlaps, counted fragment by fragment and summed, reach the threshold."""
    left = pairs.join(fragments.select(F.col("c").alias("a"), "f", F.col("n").alias("na"), F.col("grams").alias("ga")), "a")
    both = left.join(fragments.select(F.col("c").alias("b"), "f", F.col("n").alias("nb"), F.col("grams").alias("gb")), ["b", "f"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part"))
    whole = partial.groupBy("a", "b").agg(F.sum("part").alias("common"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return whole.where(F.col("common") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("common")))


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 75, all_pairs: bool = False, cuts: int = 6) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: one row per input row with an id: doc_id, n_shingles (size of its set of word n-grams),
    c (name of the class of documents with that very set), component_id (smallest doc_id reachable by
    links). links: (a, b, common, na, nb), links between classes that were formed: enough to connect
    every component, or every one of them with ``all_pairs`` (then quadratic in a group of near copies).

    A-Z are lower-cased; a text of fewer than n words is one n-gram, one without words has an empty set
    and no link. Rows with null doc_id are left out; repeated rows are members of one class; an empty
    table gives empty results; further columns are not read.
    """
    spark, parts, scratch = docs.sparkSession, partitions(docs.sparkSession), Scratch(docs.sparkSession, free_shuffles=True)
    docs = id_text(docs).where("doc_id is not null")
    screen = postings.exchange(map_arrow(docs, _screen(n, percent, parts), postings.SCHEMA), parts)
    table = scratch.write("screen", map_arrow(screen, _screened, "doc int, h long, c long, n long"))
    members = table.where("doc = 1").select(F.col("h").alias("doc_id"), "n", "c")
    classes = scratch.write("classes", members.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("first"), F.max("n").alias("n")))
    shared = table.where("doc = 0").select("h", "c")
    texts = squeezed(docs).join(scratch.write("left", _survivors(shared, classes, percent)), "doc_id").select("c", "z")
    cut = map_arrow(texts, _fragments(n, cuts), "c long, f int, n long, grams array<bigint>, sign array<bigint>").dropDuplicates(["c", "f"])
    fragments = scratch.write("fragments", cut)
    buckets = _buckets(fragments, percent, parts, scratch)

    signs = fragments.where("sign is not null").select("c", "n", "sign", _bits("sign", "sign").alias("bits"))
    links = spark.createDataFrame([], T.StructType([T.StructField(x, T.LongType()) for x in ("a", "b", "common", "na", "nb")]))
    labels, round_no, sets = None, 0, signs.count()
    while not buckets.isEmpty():
        comp = F.col("c") if labels is None or all_pairs else F.coalesce("label", "c")
        marked = buckets if labels is None or all_pairs else buckets.join(labels.withColumnRenamed("node", "c"), "c", "left")
        pairs, rest = _pairs(marked.select("h", "c", "n", "common", "weight", "at", comp.alias("comp")), round_no, percent)
        pairs, rest = scratch.write("pairs", pairs), scratch.write(f"buckets-{round_no % 2}", rest)
        if round_no >= 2:
            pairs = scratch.write("pairs", _alike(pairs, _ends(signs, pairs, "near-signs", scratch), percent))
        few = 4 * pairs.count() < sets  # the first rounds pair most sets, and all fragments are read as they are
        new = scratch.write("new", _linked(pairs, _ends(fragments, pairs, "near", scratch) if few else fragments, percent))
        if not new.isEmpty():
            links = scratch.write("links", links.unionByName(new))
            if not all_pairs:
                labels = components(links, scratch)
        buckets, round_no = rest, round_no + 1
    if all_pairs:
        links = scratch.write("links", links.dropDuplicates(["a", "b"]))
        labels = components(links, scratch)
    named = classes.select("c", "first", F.col("c").alias("label"))
    if labels is not None:
        named = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").select("c", "first", F.coalesce("label", "c").alias("label"))
        lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
        named = named.join(lowest, "label").select("c", F.col("component_id").alias("first"), "label")
    result = scratch.write("members", members.join(named, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "c", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first")).alias("component_id"), "label"))
    scratch.keep("members", "links")
    return result, links


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of :func:`jaccard_join`."""
    return jaccard_join(docs, n, percent)[0].select("doc_id", "n_shingles", "component_id")


def _classed(n: int):
    """Rows whose text has the set that is wanted of their doc_id."""
    def run(batches):
        for batch in batches:
            wanted, keep = batch.column("wanted").to_pylist(), []
            for first, _, texts in text_groups(batch):
                words, off = word_hashes([t.lower() for t in texts])
                keep += [set_class(shingle_set(words[off[i]:off[i + 1]], n)) == wanted[first + i] for i in range(len(texts))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_one(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The documents with one of each component, that of the smallest doc_id; rows without an id stay.

    Texts without words are linked with nothing. Rows of one doc_id are judged by their own texts: those of
    other components stay, repeated rows and rows of the same set are copies, of which the smallest text stays.
    Null texts are texts without words; an empty table stays empty; columns of any name stay.
    """
    members = jaccard_join(docs, n, percent)[0]
    firsts = members.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "c")).alias("first")).select("first.*")
    kept = firsts.unionByName(members.where("label is null").select("doc_id", "c").distinct())
    rows = carried(docs).join(kept.withColumnRenamed("c", "wanted"), "doc_id").select("doc_id", "text", "rest", "wanted")
    rows = map_arrow(rows, _classed(n), rows.schema)
    nth = F.row_number().over(Window.partitionBy("doc_id", "wanted").orderBy("text"))
    one = rows.withColumn("nth", nth).where("nth = 1").select("doc_id", "text", "rest")
    return uncarried(one.unionByName(carried(docs).where("doc_id is null")), docs, counted=False)
