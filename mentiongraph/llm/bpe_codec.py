"""BPE encoding and decoding of whole texts with a byte-level vocabulary.

Encoding: the symbols of a piece form a doubly linked list, a priority queue holds merge ranks with
the left symbol's place, and entries whose symbols changed since are skipped when popped. Decoding
concatenates vocabulary strings. Encoded pieces repeat, so each worker keeps a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe_files
from .common import id_text, map_arrow

CACHE_PIECES = 600_000
OTHER_SPACE = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_codecs: dict[int, "Codec"] = {}


def single_separators(text: str) -> bool:
    """Whether all white space is single spaces or single newlines between other characters."""
    return bool(text) and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text
                               or text[0] in " \n" or text[-1] in " \n" or OTHER_SPACE.search(text))


class Codec(dict):
    """Piece -> ids as little-endian unsigned 32-bit integers.

    A key without a leading newline stands for the piece after one space; ``\\n`` + piece for the
    piece after one newline; ``\\0`` + piece for a bare pre-token.
    """

    def __init__(self, v: bpe_files.Vocabulary):
        super().__init__()
        if v.lower:
            raise ValueError("only vocabularies that keep the text can be decoded")
        self.v = v
        back = {c: b for b, c in enumerate(bpe_files.byte_characters())}
        self.strings = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for i, s in v.strings.items()}

    def encode_symbols(self, piece: str) -> list[int]:
        v = self.v
        ids = list(map(v.byte_ids.__getitem__, piece.encode()))
        n = len(ids)
        if n < 2:
            return ids
        ranks, merged = v.ranks, v.merged
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for at in range(n - 1):
            rank = ranks.get(ids[at] << 20 | ids[at + 1])
            if rank is not None:
                queue.append((rank, at))
        heapify(queue)
        while queue:
            rank, at = heappop(queue)
            right = nxt[at]
            if ids[at] < 0 or right >= n or ranks.get(ids[at] << 20 | ids[right]) != rank:
                continue  # stale: a symbol of the pair is gone or changed
            ids[at], ids[right] = merged[rank], -1
            follow, lead = nxt[right], prv[at]
            nxt[at] = follow
            if follow < n:
                prv[follow] = at
                r = ranks.get(ids[at] << 20 | ids[follow])
                if r is not None:
                    heappush(queue, (r, at))
            if lead >= 0:
                r = ranks.get(ids[lead] << 20 | ids[at])
                if r is not None:
                    heappush(queue, (r, lead))
        return [i for i in ids if i >= 0]

    def packed(self, piece: str) -> bytes:
        return np.array(self.encode_symbols(piece), dtype="<u4").tobytes()

    def __missing__(self, key: str) -> bytes:
        if key[0] == "\0":
            out = self.packed(key[1:])
        else:
            parts = self.v.split.findall(key if key[0] == "\n" else " " + key)
            out = self.packed(parts[0]) if len(parts) == 1 else b"".join(map(self.part, parts))
        self[key] = out
        return out

    def part(self, p: str) -> bytes:
        """One pre-token."""
        if p[0] == " " and len(p) > 1 and p[1] not in " \n\0":
            return self[p[1:]]
        return self["\0" + p]

    def plain(self, text: str) -> bytes:
        if len(self) > CACHE_PIECES:
            self.clear()
        if single_separators(text):  # pieces are then split independently
            pieces = text.replace("\n", " \n").split(" ")
            first = b"".join(map(self.part, self.v.split.findall(pieces[0])))
            return first + b"".join(map(self.__getitem__, pieces[1:]))
        return b"".join(map(self.part, self.v.split.findall(text)))

    def encode(self, text: str) -> bytes:
        v = self.v
        if v.splitter is None or not v.splitter.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in v.splitter.finditer(text):
            out += [self.plain(text[at:m.start()]), np.array([v.added[m.group()]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def codec(v: bpe_files.Vocabulary) -> Codec:
    return _codecs.setdefault(id(v), Codec(v))


def _broadcast(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) per input row, ids being little-endian unsigned 32-bit integers.

    Null or empty text has no ids, null doc_id passes through, repeated rows each give a row, an empty
    table an empty result; further columns are not read.
    """
    shared = _broadcast(docs, vocabulary)

    def run(batches):
        c = codec(bpe_files.shared(shared))
        for batch in batches:
            ids = [c.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_arrow(id_text(docs), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from the rows of ``encode``; null ids decode to the empty text."""
    shared = _broadcast(encoded, vocabulary)

    def run(batches):
        c = codec(bpe_files.shared(shared))
        for batch in batches:
            texts = [c.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per input row: n_tokens, sha256 of the ids and of the text decoded from them, in one scan."""
    shared = _broadcast(docs, vocabulary)

    def run(batches):
        c = codec(bpe_files.shared(shared))
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column("text").to_pylist():
                ids = c.encode(t)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
