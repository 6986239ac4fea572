"""Substring de-duplication by level-wise doubling of repeated word windows.

Level 0 counts windows of ``ceil(window / 2)`` words; only windows that repeat there are extended to
twice that length (cut to ``window``), counted again, and so on until no candidate survives or, by
default, the wanted length is reached. At level 0 it is enough to count one window inside each
window of the wanted length: the one of smallest hash (leftmost on ties). Which one that is follows
from the words alone, so equal windows choose equal ones, and about a tenth of the places is counted.

A window of 2L words at i is the pair of L-windows at i and i + L, so a later level needs only the
hashes of the level before. Counting is :mod:`postings`: packed rows, map-side combining.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import postings
from .common import carried, gram_hashes, id_text, map_arrow, materialize, mix, partitions, squeezed, text_groups, uncarried, unsqueezed, word_hashes, word_spans

_FIRST, _SECOND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xE7037ED1A0B428DB)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a window from the hashes of the two shorter windows that cover it."""
    return mix(a * _FIRST + b * _SECOND)


def smallest_in(g: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost place of the smallest value among ``g[i:i + width]``."""
    idx, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        a, b = idx[: len(idx) - step], idx[step:]
        idx = np.where(g[b] < g[a], b, a)
        have += step
    return idx


def chosen(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """For each window of a document, the place of the base window that stands for it."""
    return smallest_in(gram_hashes(words, base), window - base + 1)


def _level0(window: int, base: int, parts: int):
    def run(batches):
        out = postings.Writer(parts, distinct=False)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, _, texts in text_groups(batch):
                words, off = word_hashes(texts)
                if len(words) < window:
                    continue
                g = gram_hashes(words, base)
                stand = smallest_in(g, window - base + 1)
                # windows that lie within one text
                doc = np.repeat(np.arange(len(texts)), np.diff(off))[: len(stand)]
                inside = np.arange(len(stand)) + window <= off[1:][doc]
                at, which = stand[inside], doc[inside]
                if not len(at):
                    continue
                new = np.ones(len(at), dtype=bool)
                new[1:] = (at[1:] != at[:-1])
                at, which = at[new], which[new]
                out.add(g[at], ids[first + which].astype(np.int64), (at - off[which]).astype(np.int32))
                if out.full():
                    yield from out.flush()
        yield from out.flush()

    return run


def _unpack(places: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in order with their hashes."""
    return np.frombuffer(places, np.int32), np.frombuffer(hashes, np.uint64)


def _candidates_from_text(window: int, base: int, parts: int):
    """Windows whose standing base window repeats, with their own hashes made from two base windows."""
    def run(batches):
        out = postings.Writer(parts, distinct=False)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = list(zip(batch.column("p").to_pylist(), batch.column("h").to_pylist()))
            for first, _, texts in text_groups(batch, "z"):
                words, off = word_hashes(texts)
                for i in range(len(texts)):
                    w = words[off[i]:off[i + 1]]
                    if len(w) < window:
                        continue
                    g = gram_hashes(w, base)
                    p, h = _unpack(*found[first + i])
                    ok = p < len(g)
                    p, h = p[ok], h[ok]
                    hit = np.zeros(len(g), dtype=bool)
                    hit[p[g[p] == h]] = True
                    at = np.flatnonzero(hit[smallest_in(g, window - base + 1)])
                    length = min(2 * base, window)
                    if length < window:  # more levels follow: every window of this length inside a candidate
                        spread = np.zeros(len(g) + 1, dtype=np.int64)
                        np.add.at(spread, at, 1)
                        np.add.at(spread, np.minimum(at + window - length + 1, len(g)), -1)
                        at = np.flatnonzero(np.cumsum(spread)[: len(w) - length + 1] > 0)
                    out.add(pair_hash(g[at], g[at + length - base]), np.full(len(at), ids[first + i], np.int64), at.astype(np.int32))
                    if out.full():
                        yield from out.flush()
        yield from out.flush()

    return run


def _extend(length: int, wanted: int, parts: int):
    """Windows of ``wanted`` words whose two windows of ``length`` words both repeat."""
    def run(batches):
        out = postings.Writer(parts, distinct=False)
        for batch in batches:
            for key, ps, hs in zip(*(batch.column(c).to_pylist() for c in ("key", "p", "h"))):
                p, h = _unpack(ps, hs)
                keep = np.ones(len(p), dtype=bool)
                keep[1:] = p[1:] != p[:-1]
                p, h = p[keep], h[keep]
                j = np.searchsorted(p, p + (wanted - length))
                ok = j < len(p)
                ok[ok] = p[j[ok]] == p[ok] + (wanted - length)
                out.add(pair_hash(h[ok], h[j[ok]]), np.full(int(ok.sum()), key, np.int64), p[ok])
                if out.full():
                    yield from out.flush()
        yield from out.flush()

    return run


def repeated_windows(docs: DataFrame, window: int = 35, base: int | None = None, hashes: bool = False) -> DataFrame:
    """(doc_id, p, h): packed places (word numbers) and, if asked for, hashes of the windows of ``window`` words that repeat."""
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    base = base or -(-window // 2)
    docs = id_text(docs).where("doc_id is not null")
    first = postings.repeated_by_key(map_arrow(docs, _level0(window, base, parts), postings.SCHEMA), parts)
    held = squeezed(docs).join(first.withColumnRenamed("key", "doc_id"), "doc_id").select("doc_id", "z", "p", "h")
    length = min(2 * base, window)
    found = postings.repeated_by_key(map_arrow(held, _candidates_from_text(window, base, parts), postings.SCHEMA), parts,
                                     hashes=hashes or length < window)
    while length < window:
        wanted = min(2 * length, window)
        found = postings.repeated_by_key(map_arrow(found, _extend(length, wanted, parts), postings.SCHEMA), parts,
                                         hashes=hashes or wanted < window)
        length = wanted
    return found.withColumnRenamed("key", "doc_id")


def longest_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, longest): the longest level (window, 2 window, 4 window ...) at which the document still has a repeated window.

    Documents without one, null ids and null texts give no row; of rows of one doc_id the longest level counts, and a
    repeated row repeats all of its windows; an empty table gives an empty result; further columns are not read.
    """
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    rows = _keyed(id_text(docs))
    found, length, levels = materialize(repeated_windows(rows, window, hashes=True), "repeats"), window, None
    while not found.isEmpty():
        level = found.select("doc_id", F.lit(length).cast("long").alias("longest"))
        levels = level if levels is None else levels.unionByName(level)
        grown = postings.repeated_by_key(
            map_arrow(found.withColumnRenamed("doc_id", "key"), _extend(length, 2 * length, parts), postings.SCHEMA), parts)
        found, length = materialize(grown.withColumnRenamed("key", "doc_id"), "repeats"), 2 * length
    if levels is None:
        return found.select("doc_id", F.lit(0).cast("long").alias("longest")).limit(0)
    ids = rows.select("doc_id", F.col("own.doc_id").alias("id")).where("doc_id is not null").distinct()
    return levels.join(ids, "doc_id").groupBy("id").agg(F.max("longest").alias("longest")).withColumnRenamed("id", "doc_id")


def covered(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    edge = np.zeros(n + 1, dtype=np.int32)
    edge[places] = 1
    ends = places + window
    np.subtract.at(edge, ends[ends <= n], 1)
    return np.cumsum(edge[:n]) > 0


def _remove(window: int, digest: bool):
    def run(batches):
        for batch in batches:
            counts, gone, out = [], [], []
            for raw, ps in zip(unsqueezed(batch), batch.column("p").to_pylist()):
                if not ps:
                    words = raw.split()
                    counts.append(len(words))
                    gone.append(0)
                    out.append(hashlib.sha256(b" ".join(words)).hexdigest() if digest else raw.decode())
                    continue
                s, e = word_spans(raw)
                p = np.unique(np.frombuffer(ps, np.int32))
                drop = covered(len(s), p[p + window <= len(s)].astype(np.int64), window)
                counts.append(len(s))
                gone.append(int(drop.sum()))
                if digest:
                    kept = np.flatnonzero(~drop)
                    out.append(hashlib.sha256(b" ".join(raw[a:b] for a, b in zip(s[kept], e[kept]))).hexdigest())
                else:
                    out.append(_cut(raw, s, e, drop))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())]
                + ([] if digest else [batch.column("rest")]),
                ["doc_id", "n_words", "n_removed"] + (["kept"] if digest else ["text", "rest"]))

    return run


def _cut(raw: bytes, s: np.ndarray, e: np.ndarray, drop: np.ndarray) -> str:
    """The text without each run of dropped words and the white space after it."""
    edge = np.diff(np.concatenate([[0], drop.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        out.append(raw[at:s[a]])
        at = int(s[b]) if b < len(s) else len(raw)
    return b"".join([*out, raw[at:]]).decode()


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, own): a row's key by its id and text in place of doc_id (null without an id), its id and other columns in own.

    Rows of one id with other texts so keep their places apart; repeated rows share them.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return carried(docs).select(key.alias("doc_id"), "text", F.struct("doc_id", "rest").alias("own"))


def _joined(docs: DataFrame, window: int, rest: bool) -> DataFrame:
    rows = _keyed(docs) if rest else _keyed(id_text(docs))
    found = repeated_windows(rows, window).select("doc_id", "p")
    return squeezed(rows, True).join(found, "doc_id", "left").select(F.col("rest.own.doc_id").alias("doc_id"), "z", "p", F.col("rest.own.rest").alias("rest"))


def removal_digest(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per input row; kept words are joined by one space.

    A word goes when it is covered by a window of ``window`` words whose words also start anywhere
    else in the table, in the same text included. Null text has no words; a row with null doc_id takes
    no part in the search and loses nothing; a repeated row repeats all of its windows; an empty table
    gives an empty result; further columns are not read.
    """
    return map_arrow(_joined(docs, window, False), _remove(window, True), "doc_id long, n_words long, n_removed long, kept string") \
        .withColumnRenamed("kept", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """The rows and columns of ``docs``, texts without their repeated passages (null becomes empty), n_chars
    following; the rules of :func:`removal_digest`."""
    rows = _joined(docs, window, True)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("text", T.StringType()), rows.schema["rest"]])
    return uncarried(map_arrow(rows, _remove(window, False), schema), docs)
