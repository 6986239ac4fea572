"""Document scores by cross-entropy difference of two matched n-gram models.

Both models are bigram models over one vocabulary (every word of the whole table, and one class for
words not seen) with the same smoothing: ``weight`` of the bigram estimate plus the rest of the
add-``alpha`` unigram estimate. The target model counts the target documents, the background model all
others: counts of all documents less those of the target.

Both models are as large as the corpus asks for, so no worker and no driver holds them. Documents are
put into batches; a batch sends each of its distinct words and bigrams once, with its own counts, to the
range of hashes that the key lies in. A range's task sums what all batches sent and replies the sums to
each batch in the order of its keys; a batch then scores its documents from the replies. A key that is
everywhere is sent once by each batch. Five numbers (distinct words, tokens and texts) reach the driver.
A document's score is the mean over its tokens of the target's loss minus the background's loss (nats);
low means like the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, mix, partitions, squeezed, text_groups, word_hashes
from .tables import Scratch

FLUSH_WORDS = 3_000_000
BATCH_BYTES = 8 << 20
OTHER, START = np.uint64(0), np.uint64(1)  # the class of words outside a limited vocabulary; the context of a text's first token
BATCH = "batch long, ids array<long>, wanted binary, lengths binary, z binary"
SENT = "batch long, part int, words binary, word_counts binary, pairs binary, pair_counts binary"
REPLY = "batch long, part int, word_counts binary, pair_counts binary, totals array<long>"
SCORES = "doc_id long, n_tokens long, ce_target double, ce_background double, ce_difference double"


def _packed(x: np.ndarray) -> bytes:
    """Numbers as zstd, the first bytes of all before the second ones: leading zeros cost nothing."""
    planes = np.ascontiguousarray(x.astype(np.int64).reshape(-1).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(z: bytes, rows: int = 1) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(rows, -1)


def _word_counts(batches):
    def flush(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    held, size = [], 0
    for batch in batches:
        for _, _, texts in text_groups(batch):
            words, _ = word_hashes([t.lower() for t in texts])
            held.append(words)
            size += len(words)
            if size >= FLUSH_WORDS:
                yield flush(held)
                held, size = [], 0
    if size:
        yield flush(held)


def most_frequent(docs: DataFrame, vocabulary: int) -> np.ndarray:
    """Sorted hashes of the most frequent words of the whole table; ties by hash. For a caller's own limit only."""
    counts = map_arrow(docs.select("text"), _word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(vocabulary).select("h").collect()
    return np.sort(np.array([r.h for r in top], dtype=np.int64).view(np.uint64))


def _batched(batches):
    """Rows of (doc_id, z, wanted) as batches of about ``BATCH_BYTES`` of text."""
    first, k = TaskContext.get().partitionId() << 32, 0

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([first + k]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(wanted, np.uint8).tobytes()], pa.binary()),
             pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()),
             pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(texts))], pa.binary())], ["batch", "ids", "wanted", "lengths", "z"])

    ids, wanted, texts, held = [], [], [], 0
    for batch in batches:
        columns = batch.column("doc_id").to_pylist(), batch.column("wanted").to_pylist()
        for lo, hi, group in text_groups(batch, "z"):
            ids += columns[0][lo:hi]
            wanted += columns[1][lo:hi]
            texts += group
            held += sum(map(len, group))
            if held >= BATCH_BYTES:
                yield flush()
                ids, wanted, texts, held, k = [], [], [], 0, k + 1
    if ids:
        yield flush()


class Tokens:
    """The tokens of a batch by their distinct words and bigrams, both in hash order."""

    def __init__(self, wanted: bytes, lengths: bytes, z: bytes, vocabulary: np.ndarray | None, slot_bits: int):
        data, at = zstandard.ZstdDecompressor().decompress(z), np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64))])
        words, off = word_hashes([data[a:b].lower() for a, b in zip(at[:-1], at[1:])])
        if vocabulary is not None:
            words = np.where(np.isin(words, vocabulary), words, OTHER)
        self.n = np.diff(off)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.wanted = np.frombuffer(wanted, np.uint8)[self.doc].astype(bool)
        self.firsts, self.lasts = off[:-1][self.n > 0], off[1:][self.n > 0] - 1
        context = np.empty_like(words)
        context[1:] = words[:-1]
        context[self.firsts] = START
        pairs = mix(context * np.uint64(0x9E3779B97F4A7C15) + words * np.uint64(0xC2B2AE3D27D4EB4F))
        if slot_bits < 64:
            pairs &= ~np.uint64((1 << (64 - slot_bits)) - 1)
        self.words, self.word = np.unique(words, return_inverse=True)
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """By word: tokens, of those in the target, texts that it ends, of those in the target. By bigram: the first two."""
        def of(x, size, kept):
            return np.bincount(x, minlength=size), np.bincount(x[kept], minlength=size)

        ends = of(self.word[self.lasts], len(self.words), self.wanted[self.lasts])
        return np.stack([*of(self.word, len(self.words), self.wanted), *ends]), np.stack(of(self.pair, len(self.pairs), self.wanted))


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of hashes begins in sorted keys, and the end of the last."""
    edges = np.array([(i << 64) // parts for i in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _sent(rows, vocabulary, slot_bits: int, parts: int):
    for batch in rows:
        for i, number in enumerate(batch.column("batch").to_pylist()):
            t = Tokens(*(batch.column(c)[i].as_py() for c in ("wanted", "lengths", "z")), vocabulary, slot_bits)
            word_counts, pair_counts = t.counts()
            w, p = _cuts(t.words, parts), _cuts(t.pairs, parts)
            held = [k for k in range(parts) if w[k] < w[k + 1] or p[k] < p[k + 1]]
            cols = [[_packed(np.diff(keys[c[k]:c[k + 1]], prepend=np.uint64(0)).view(np.int64)) if j == 0 else _packed(n[:, c[k]:c[k + 1]]) for k in held]
                    for keys, n, c in ((t.words, word_counts, w), (t.pairs, pair_counts, p)) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(held), pa.int64()), pa.array(held, pa.int32())] + [pa.array(c, pa.binary()) for c in cols],
                                             ["batch", "part", "words", "word_counts", "pairs", "pair_counts"])


def _summed(keys: list[bytes], counts: list[bytes], rows: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct keys, their sums, and the sums in the order of each sender's keys."""
    keys = [np.cumsum(_unpacked(z)[0].view(np.uint64), dtype=np.uint64) for z in keys]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_unpacked(z, rows) for z in counts], axis=1)
    sums = np.stack([np.bincount(at, weights=c, minlength=len(found)) for c in counts]).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    return found, sums, [_packed(sums[:, at[e - len(k):e]]) for k, e in zip(keys, ends)]


def _replies(rows):
    held: dict[int, list[tuple]] = {}
    for batch in rows:
        for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "batch", "words", "word_counts", "pairs", "pair_counts"))):
            held.setdefault(part, []).append(row)
    while held:
        part, sent = held.popitem()
        batches, words, word_counts, pairs, pair_counts = map(list, zip(*sent))
        found, sums, to_words = _summed(words, word_counts, 4)
        _, _, to_pairs = _summed(pairs, pair_counts, 2)
        totals = [int((found != OTHER).sum()), *map(int, sums.sum(axis=1))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*batches, None], pa.int64()), pa.array([part] * (len(sent) + 1), pa.int32()), pa.array([*to_words, None], pa.binary()),
             pa.array([*to_pairs, None], pa.binary()), pa.array([None] * len(sent) + [totals], pa.list_(pa.int64()))],
            ["batch", "part", "word_counts", "pair_counts", "totals"])


def _scored(rows, totals: list[int], vocabulary, slot_bits: int, weight: float, alpha: float):
    """Scores of a batch's documents from its texts and the replies to it, least range first."""
    size, (n_all, n_target, texts_all, texts_target) = totals[0] + 1, totals[1:]
    for batch in rows:
        for i, ids in enumerate(batch.column("ids").to_pylist()):
            t = Tokens(*(batch.column(c)[i].as_py() for c in ("wanted", "lengths", "z")), vocabulary, slot_bits)
            sums = [np.zeros((4, 0), np.int64)], [np.zeros((2, 0), np.int64)]
            for r in batch.column("replies")[i].as_py() or []:
                sums[0].append(_unpacked(r["word_counts"], 4))
                sums[1].append(_unpacked(r["pair_counts"], 2))
            word, pair = (np.concatenate(s, axis=1) for s in sums)
            out = []
            for c, p, e, tokens, texts in ((word[1], pair[1], word[3], n_target, texts_target),
                                           (word[0] - word[1], pair[0] - pair[1], word[2] - word[3], n_all - n_target, texts_all - texts_target)):
                seen = np.empty(len(t.word))
                seen[1:] = (c - e)[t.word[:-1]]
                seen[t.firsts] = texts
                w = np.where(seen > 0, weight, 0.0)
                share = np.minimum(p[t.pair] / np.maximum(seen, 1), 1.0)  # over 1 only where a caller's slot_bits let bigrams meet
                loss = -np.log(w * share + (1 - w) * ((c + alpha) / (tokens + alpha * size))[t.word])
                out.append(np.bincount(t.doc, weights=loss, minlength=len(ids)) / np.maximum(t.n, 1))
            none = t.n == 0
            cols = [pa.array(np.round(x, 6), mask=none) for x in (out[0], out[1], out[0] - out[1])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(t.n.astype(np.int64)), *cols],
                                             ["doc_id", "n_tokens", "ce_target", "ce_background", "ce_difference"])


def cross_entropy_difference(docs: DataFrame, target: DataFrame, vocabulary: int | None = None, slot_bits: int = 64, weight: float = 0.6,
                             alpha: float = 0.5) -> DataFrame:
    """Per input row: doc_id, n_tokens, ce_target, ce_background, ce_difference (rounded to 6 places).

    ``target``: (doc_id) of the target documents; repeated and null ids in it count once and not at all.
    Null or empty text has 0 tokens and null scores; null doc_id passes through (background); repeated
    rows count and score each; with an empty target its model is uniform; an empty table gives an empty
    result; further columns are not read. ``vocabulary`` (all words unless given) limits the words that
    are told apart, ``slot_bits`` the bits of a bigram's hash.
    """
    spark = docs.sparkSession
    scratch, docs = Scratch(spark), id_text(docs)
    limit = None if vocabulary is None else most_frequent(docs, vocabulary)
    chosen = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("chosen", F.lit(True))
    # shuffled at every size: texts are streamed past the ids of their partition, unsorted
    marked = squeezed(docs).join(chosen.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "z", F.col("chosen").isNotNull().alias("wanted"))
    batches = scratch.write("batches", map_arrow(marked, _batched, BATCH))
    parts = 2 * partitions(spark)
    sent = map_arrow(batches.select("batch", "wanted", "lengths", "z"), lambda rows: _sent(rows, limit, slot_bits, parts), SENT)
    replies = scratch.write("replies", map_arrow(sent.repartition(partitions(spark), "part"), _replies, REPLY))
    sums = replies.where("batch is null").agg(*(F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(5))).first()
    totals = list(sums)
    grouped = replies.where("batch is not null").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("part", "word_counts", "pair_counts"))).alias("replies"))
    return map_arrow(batches.join(grouped, "batch", "left").drop("batch"), lambda rows: _scored(rows, totals, limit, slot_bits, weight, alpha), SCORES)
