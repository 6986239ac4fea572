"""Packing into optimal length buckets.

The global histogram of sequence lengths (at most ``max_len`` counts, whatever the table's size) goes
to the driver, where dynamic programming picks the bucket bounds with the least padding in all.
Inside a bucket, batches hold as many sequences as the token budget allows at the bucket's bound.
Texts of more than ``max_len`` tokens become several sequences. Tokens are counted by merge rounds over all new pieces of a
group of texts, without identifiers.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_files
from .common import id_text, map_arrow, partitions, text_groups
from .merge_rounds import PairTable
from .tables import Scratch

CACHE_PIECES = 250_000
LEARN_PIECES = 16_000
SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space for str.split only
_lengths: dict[int, "PieceLengths"] = {}


class PieceLengths(dict):
    """White-space-free piece -> number of its tokens; all new pieces of a group of texts are merged together, in rounds."""

    def __init__(self, v: bpe_files.Vocabulary):
        super().__init__()
        if not v.lower:
            raise ValueError("lengths are defined for word-level vocabularies")
        self.v = v
        low = (1 << 20) - 1
        self.table = PairTable({(key >> 20, key & low): (rank, v.merged[rank]) for key, rank in v.ranks.items()})
        self.inner, self.final = np.array(v.byte_ids), np.array(v.final_ids)

    def learn(self, pieces: list[str]) -> None:
        parts = [self.v.split.findall(p) for p in pieces]
        of = np.repeat(np.arange(len(pieces)), [len(x) for x in parts])
        raw = [x.encode() for found in parts for x in found]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        sym = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.final[np.frombuffer(b"".join(x[-1:] for x in raw), np.uint8)]
        _, word = self.table.merge(sym, np.repeat(np.arange(len(raw)), sizes))
        self.update(zip(pieces, np.bincount(of[word], minlength=len(pieces)).tolist()))

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts as the vocabulary's library counts them, without added begin or end tokens."""
        if len(self) > CACHE_PIECES:  # what came first holds the frequent pieces
            for p in list(self)[CACHE_PIECES // 2:]:
                del self[p]
        split, fixed = [], []
        for t in texts:
            stretches = self.v.splitter.split(t) if self.v.splitter else [t]
            fixed.append(len(stretches) - 1)  # added tokens
            split.append([p for s in stretches for p in self._pieces(s)])
        new = list(set().union(*split).difference(self))
        for k in range(0, len(new), LEARN_PIECES):
            self.learn(new[k:k + LEARN_PIECES])
        return [n + sum(map(self.__getitem__, s)) for n, s in zip(fixed, split)]

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case is per character
        text = text.lower()
        return self.v.split.findall(text) if any(c in text for c in SEPARATORS) else text.split()


def token_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens) per input row; null text is empty, null ids pass through, further columns are not read."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        v = bpe_files.shared(shared)
        if id(v) not in _lengths:
            _lengths[id(v)] = PieceLengths(v)
        lengths = _lengths[id(v)]
        for batch in batches:
            for first, end, texts in text_groups(batch):
                n = lengths.count_all([t.decode() for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return map_arrow(id_text(docs), run, "doc_id long, n_tokens long")


def optimal_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Bounds (largest is the longest length in use) of at most ``buckets`` buckets with the least padding.

    ``counts[l]`` sequences have length l; length 0 is not batched. A bucket (a, b] costs the sum of
    (b - l) * counts[l] for its lengths; best[k][b] is the least cost of lengths up to b in k buckets.
    """
    used = np.flatnonzero(counts[1:]) + 1
    if not len(used):
        return []
    c = counts[used].astype(np.float64)
    n = np.concatenate([[0], np.cumsum(c)])
    s = np.concatenate([[0], np.cumsum(c * used)])
    size = len(used)
    best = used * n[1:] - s[1:]  # one bucket up to each used length
    back = []
    for _ in range(1, min(buckets, size)):
        new, frm = best.copy(), np.full(size, -1)
        for b in range(1, size):
            # the bucket before ends at a < b; lengths a+1 .. b are padded to used[b]
            cost = best[:b] + used[b] * (n[b + 1] - n[1:b + 1]) - (s[b + 1] - s[1:b + 1])
            a = int(np.argmin(cost))
            if cost[a] < new[b]:
                new[b], frm[b] = cost[a], a
        back.append(frm)
        best = new
    bounds, b = [], size - 1
    for frm in reversed(back):
        bounds.append(int(used[b]))
        if frm[b] < 0:
            return sorted(set(bounds))
        b = int(frm[b])
    return sorted({*bounds, int(used[b])})


def pack(lengths: DataFrame, budget: int = 16384, max_len: int = 2048, buckets: int = 16) -> DataFrame:
    """(doc_id, piece, start, length, padded_length, batch, slot) for each sequence of (doc_id, n_tokens) rows.

    padded_length is the bucket's bound; batch numbers count from 0 within a bucket, slot is the place in
    the batch. A document without tokens (or with a null count) has one row of length 0 with
    padded_length 0 and no batch. Null doc_ids and repeated rows are sequences like any other; an empty
    table gives an empty result.
    """
    spark = lengths.sparkSession
    n = F.coalesce("n_tokens", F.lit(0)).cast("long")
    last = F.greatest(F.floor((n - 1) / max_len), F.lit(0))
    scratch = Scratch(spark)
    pieces = scratch.write("pieces", lengths.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
                           .select("doc_id", "piece", (F.col("piece") * max_len).alias("start"),
                                   F.least(F.col("n") - F.col("piece") * max_len, F.lit(max_len)).cast("long").alias("length")))
    histogram = np.zeros(max_len + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most max_len + 1 rows
        histogram[row["length"]] = row["count"]
    bounds = optimal_bounds(histogram, buckets)
    bound = F.lit(0)
    for b in reversed(bounds):
        bound = F.when(F.col("length") <= b, F.lit(b)).otherwise(bound)
    placed = pieces.withColumn("padded_length", F.when(F.col("length") == 0, F.lit(0)).otherwise(bound).cast("long"))
    # a bucket may hold a third of all rows: ranks come from many shares of it and the shares' totals
    shares = partitions(spark)
    placed = placed.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)))
    totals = placed.groupBy("padded_length", "share").agg(F.count("*").alias("held"))
    before = totals.select("padded_length", "share", F.expr(
        "sum(held) over (partition by padded_length order by share) - held").alias("before"))
    ranked = placed.withColumn("own", F.expr("row_number() over (partition by padded_length, share order by doc_id, piece) - 1"))
    rank = F.col("before") + F.col("own")
    fits = F.greatest(F.floor(F.lit(budget) / F.col("padded_length")), F.lit(1))
    some = F.col("padded_length") > 0
    return ranked.join(before, ["padded_length", "share"]).select(
        "doc_id", "piece", "start", "length", "padded_length",
        F.when(some, F.floor(rank / fits)).cast("long").alias("batch"), F.when(some, rank % fits).cast("long").alias("slot"))


def pack_documents(docs: DataFrame, vocabulary: str, budget: int = 16384, max_len: int = 2048, buckets: int = 16) -> DataFrame:
    """:func:`pack` over the token counts of whole texts (null text: none)."""
    return pack(token_lengths(docs, vocabulary), budget, max_len, buckets)
