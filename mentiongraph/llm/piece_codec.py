"""SentencePiece (BPE) encoding and decoding of whole texts by vectorised merge rounds.

A text's normalised form (a dummy space first, spaces written as U+2581) falls apart into words that
no piece of the vocabulary spans. The words of a batch that were not met before become one flat numpy array
of symbols and are merged in rounds (:mod:`merge_rounds`). Pieces that share one last rank (runs of
spaces) merge from the left one at a time, as a stack.

Characters outside the vocabulary become byte pieces. Decoding joins vocabulary strings.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_arrow, text_groups
from .merge_rounds import NONE, PairTable

SPACE = "▁"
CACHE_BYTES = 48 << 20
ENTRY_BYTES = 150          # Python's own cost of a table entry, about
LEARN_SYMBOLS = 1 << 18
_models: dict[int, "Pieces"] = {}


class Pieces(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers, for one vocabulary file."""

    def __init__(self, data: bytes):
        super().__init__()
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        proto = sentencepiece_model_pb2.ModelProto.FromString(data)
        kinds = proto.SentencePiece
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if (train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix or norm.precompiled_charsmap
                or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix):
            raise ValueError("only BPE files with byte fallback and without normalisation rules are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.size = len(proto.pieces)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.controls = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.byte_ids = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype="<u4")
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces that span words are not supported")
        self.strings = [p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        for i in self.controls:
            self.strings[i] = b""
        for b, i in enumerate(self.byte_ids):
            self.strings[i] = bytes([b])
        self.strings[self.library.unk_id()] = train.unk_surface.encode()
        self._ranks(ids, [p.score for p in proto.pieces])
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size  # a character without a piece stands for itself
        chars = {c for p in ids for c in p}
        for c in chars:
            if c in ids:
                self.symbol[ord(c)] = ids[c]
        cut = "" if "\n" in chars else "\n"
        self.words = re.compile(f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" + (f"|{cut}+" if cut else "")).findall
        self.held = 0

    def _ranks(self, ids: dict[str, int], score: list[float]) -> None:
        """Ranks by falling score; the pieces of the last one may share it, others may not."""
        made = {p: [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids] for p in ids if len(p) > 1}
        order = sorted({score[ids[p]] for p, ways in made.items() if ways}, reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        of = {p: rank[score[ids[p]]] for p, ways in made.items() if ways}
        last = [p for p, r in of.items() if r == len(order) - 1]
        self.shared = len(order) - 1 if len(last) > 1 else NONE
        if len(of) - len(last) != len(order) - 1:
            raise ValueError("pieces share a rank that is not the last")
        if any(of[p] != self.shared and any(of.get(x) == self.shared for x in parts) for p, ways in made.items() for parts in ways):
            raise ValueError("a piece ranks before one of the shared rank that it is made of")
        self.pairs = {(ids[a], ids[b]): (of[p], ids[p]) for p, ways in made.items() for a, b in ways}
        self.table = PairTable(self.pairs)

    # -------------------------------------------------------------- merge rounds

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words after merging, offsets of each word's); characters without a piece are size + code point."""
        lens = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")]
        sym, word = self.table.merge(sym, np.repeat(np.arange(len(words)), lens), self.shared)
        return sym, np.searchsorted(word, np.arange(len(words) + 1))

    def from_the_left(self, symbols: list[int]) -> list[int]:
        """Pieces of the shared last rank: always the leftmost pair, so what lies left of it is a stack."""
        out: list[int] = []
        for s in symbols:
            out.append(s)
            while len(out) > 1 and (out[-2], out[-1]) in self.pairs:
                out[-2:] = [self.pairs[out[-2], out[-1]][1]]
        return out

    def learn(self, words: list[str]) -> None:
        sym, off = self.merge(words)
        plain = sym.astype("<u4").tobytes()
        odd = np.zeros(len(words), dtype=bool)  # words with byte pieces or with pairs of the shared rank
        lens = np.diff(off)
        word = np.repeat(np.arange(len(words)), lens)
        odd[word[sym >= self.size]] = True
        if self.shared != NONE:
            odd[word[self.table.pair_ranks(sym, word)[0] == self.shared]] = True
        for k, w in enumerate(words):
            self[w] = plain[4 * off[k]:4 * off[k + 1]] if not odd[k] else self._finish(sym[off[k]:off[k + 1]])
            self.held += 4 * len(w) + 4 * int(lens[k]) + ENTRY_BYTES

    def _finish(self, sym: np.ndarray) -> bytes:
        out: list[int] = []
        for s in self.from_the_left(sym.tolist()):
            if s < self.size:
                out.append(s)
            else:
                out.extend(self.byte_ids[list(chr(s - self.size).encode())].tolist())
        return np.array(out, dtype="<u4").tobytes()

    # -------------------------------------------------------------- texts

    def encode_all(self, texts: list[str], ends: bool = True) -> list[bytes]:
        """Ids of whole texts, with begin and end ids if asked for."""
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        split = [self.words(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new, symbols = [], 0
        for w in set().union(*split).difference(self):
            new.append(w)
            symbols += len(w)
            if symbols >= LEARN_SYMBOLS:
                self.learn(new)
                new, symbols = [], 0
        if new:
            self.learn(new)
        bos, eos = (np.array([x], dtype="<u4").tobytes() if ends else b"" for x in (self.bos, self.eos))
        get = self.__getitem__
        return [b"".join([bos, *map(get, s), eos]) for s in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids: strings joined, the dummy space left out, control ids silent."""
        places = memoryview(ids).cast("I")
        raw = b"".join(map(self.strings.__getitem__, places))
        first = next((i for i in places if i not in self.controls), None)
        if first is not None and self.library.id_to_piece(first).startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # byte pieces that are no character: the library's replacement rule
            return self.library.decode(places.tolist())


def pieces(broadcast) -> Pieces:
    """The vocabulary of a broadcast file, read once per worker."""
    data = broadcast.value
    key = hash(data)
    if key not in _models:
        _models[key] = Pieces(data)
    return _models[key]


def _broadcast(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _texts(batch: pa.RecordBatch):
    for first, end, texts in text_groups(batch):
        yield first, end, [t.decode() for t in texts]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) per input row: little-endian unsigned 32-bit integers with begin and end ids.

    Null or empty text has the begin and end ids only; null doc_ids pass through; repeated rows each give
    a row; an empty table gives an empty result; further columns, whatever their names, are not read.
    """
    shared = _broadcast(docs, vocabulary)

    def run(batches):
        p = pieces(shared)
        for batch in batches:
            for first, end, texts in _texts(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], pa.array(p.encode_all(texts), pa.binary())], ["doc_id", "ids"])

    return map_arrow(id_text(docs), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from rows (doc_id, ids); null or empty ids decode to the empty text."""
    shared = _broadcast(encoded, vocabulary)

    def run(batches):
        p = pieces(shared)
        for batch in batches:
            texts = [p.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per input row: n_tokens (begin and end ids included), sha256 of the ids and of the text decoded from them, in one scan.

    Rows are treated as by :func:`encode`.
    """
    shared = _broadcast(docs, vocabulary)

    def run(batches):
        p = pieces(shared)
        for batch in batches:
            for first, end, texts in _texts(batch):
                ids = p.encode_all(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:end], pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                     pa.array([hashlib.sha256(p.decode(x).encode()).hexdigest() for x in ids], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(id_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
