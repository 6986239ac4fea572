"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

A piece of text starts as its byte symbols in a doubly linked list. A heap holds the merge rank of
every adjacent pair; the lowest rank (leftmost on ties) is popped and merged until none is left.
The piece's token count is its initial symbols minus the merges done. Pieces repeat, so each worker
keeps a bounded table of counts. The scan is narrow: no shuffle, no state across tasks.
"""

from __future__ import annotations

import heapq
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe_files
from .common import id_text, map_arrow

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
CACHE_PIECES = 600_000
_counters: dict[int, "PieceCounts"] = {}


def count_symbols(v: bpe_files.Vocabulary, piece: str) -> int:
    """Tokens of one piece: initial symbols minus merges."""
    raw = piece.encode()
    n = len(raw)
    symbols = [v.byte_ids[b] for b in raw[:-1]] + [v.final_ids[raw[-1]]]
    if n == 1:
        return 1
    ranks, merged = v.ranks, v.merged
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(symbols[i] << 20 | symbols[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    heapq.heapify(heap)
    merges = 0
    while heap:
        entry = heapq.heappop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        left, j = symbols[i], after[i]
        if left < 0 or j >= n or ranks.get(left << 20 | symbols[j]) != rank:
            continue  # one of the two symbols has been merged since
        merges += 1
        symbols[i], symbols[j] = merged[rank], -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = ranks.get(symbols[i] << 20 | symbols[k])
            if r is not None:
                heapq.heappush(heap, r << 32 | i)
        p = before[i]
        if p >= 0:
            r = ranks.get(symbols[p] << 20 | symbols[i])
            if r is not None:
                heapq.heappush(heap, r << 32 | p)
    return n - merges


class PieceCounts(dict):
    """White-space-free piece -> token count, computed on first sight."""

    def __init__(self, v: bpe_files.Vocabulary):
        super().__init__()
        self.v = v

    def __missing__(self, piece: str) -> int:
        parts = self.v.split.findall(piece)
        if len(parts) == 1:
            n = count_symbols(self.v, parts[0])
        else:
            n = sum(self[p] if p != piece else count_symbols(self.v, p) for p in parts)
        self[piece] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case is per character
        pieces = text.lower().split()
        if len(self) > CACHE_PIECES:
            self.clear()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split only
            return sum(map(self.__getitem__, self.v.split.findall(text.lower())))
        return sum(map(self.__getitem__, pieces))

    def count(self, text: str) -> int:
        v = self.v
        if not v.lower:
            raise ValueError("token counts are defined for word-level vocabularies")
        if v.splitter is None or not v.splitter.search(text):
            return self.plain(text)
        parts = v.splitter.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def counter(v: bpe_files.Vocabulary) -> PieceCounts:
    return _counters.setdefault(id(v), PieceCounts(v))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``vocabulary``: path of a word-level BPE file. Null or empty text counts 0 tokens; null ids pass
    through; repeated rows each give a row; an empty table gives an empty result; further columns are
    not read. A text of any length is one heap per piece, so memory follows the longest piece.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counts = counter(bpe_files.shared(shared))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [counts.count(t) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(id_text(docs), run, SCHEMA)
