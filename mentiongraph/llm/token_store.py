"""Token ids in canonical length-limited Huffman code, in independent blocks with bit-offset checkpoints.

Files are Parquet parts in ascending doc_id order, one folder per range of ids; a row holds one document: its ids coded in blocks
of ``BLOCK`` ids, the bit offset of every block, and the number of ids before the document. The code is
canonical, so the lengths (one byte per id of the vocabulary) are all that a reader needs; they are a
small table beside the blocks. Decoding looks up ``LIMIT`` bits at a time in one table and runs over
all blocks of a batch in step, each from its checkpoint.

Ids come from the vocabulary's own library. Pieces between white space are encoded independently of
each other by word-level vocabularies, and so are the units (words, digits, runs of marks) that the
split rule cuts them into. Each worker keeps bounded tables of pieces it has seen. New pieces of Latin
letters and ASCII marks are cut here and their units go to the library's model alone, which skips its
normaliser and pattern engine; all other pieces go through the whole library.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_files
from .common import id_text, map_arrow, partitions, scratch_path, text_groups
from .tables import Scratch

LIMIT = 16
BLOCK = 256
GROUP_IDS = 400_000
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 150          # Python's own cost of a table entry, about
LEARN_PIECES = 2000
# units of the split rule, for lower-case pieces; a piece with any other character is not covered by them
UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u024F]+|[0-9]|[!-/:-@\\[-`{-~]+").findall
LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
_encoders: dict[int, "Encoder"] = {}


# ------------------------------------------------------------------ ids


class Encoder(dict):
    """White-space-free piece -> its ids as little-endian unsigned 32-bit integers, from the library.

    Two tables of ``CACHE_BYTES``: when this one is full it becomes ``old``, and pieces seen again come back from there.
    """

    def __init__(self, data: bytes):
        super().__init__()
        from tokenizers import Tokenizer, normalizers

        self.library, self.rules = Tokenizer.from_str(data.decode()), bpe_files.parse(data)
        self.library.no_truncation()
        self.library.no_padding()
        if not self.rules.lower or not self.rules.added:
            raise ValueError("piecewise encoding needs a word-level vocabulary with an added token")
        self.mark = next(iter(self.rules.added))
        self.tokenize = self.library.model.tokenize
        self.compose = normalizers.NFC().normalize_str  # Python's Unicode tables are newer
        self.packed = [struct.pack("<I", i) for i in range(max(self.rules.strings) + 1)]
        self.characters = dict(enumerate(bpe_files.byte_characters()))
        self.old: dict[str, bytes] = {}
        self.waiting: set[str] = set()
        self.held = 0

    def __missing__(self, piece: str) -> bytes | None:
        """Ids of a piece that is not in the table; None if it waits for the whole library."""
        ids = self.old.pop(piece, None)
        if ids is None:
            if piece.isascii() and piece.isalpha() and piece.islower():
                ids = self._unit(piece)
            else:
                lower = piece.lower()
                units = UNITS(lower)
                if sum(map(len, units)) != len(lower):
                    self.waiting.add(piece)
                    return None
                ids = self._unit(lower) if len(units) == 1 else b"".join(map(self.__getitem__, units))
        self._keep(piece, ids)
        return ids

    def _unit(self, unit: str) -> bytes:
        if not unit.isascii():
            unit = unit.encode().decode("latin-1").translate(self.characters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(unit)])

    def _keep(self, piece: str, ids: bytes) -> None:
        self[piece] = ids
        self.held += len(ids) + len(piece) + ENTRY_BYTES

    def learn(self, pieces: list[str]) -> None:
        """Ids of any new pieces, from the whole library: with an added token (which none holds) between them."""
        for k in range(0, len(pieces), LEARN_PIECES):
            some = pieces[k:k + LEARN_PIECES]
            ids = np.array(self.library.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            data, at = ids.tobytes(), 0
            ends = np.append(np.flatnonzero(ids == self.rules.added[self.mark]), len(ids))
            for p, end in zip(some, ends.tolist(), strict=True):
                self._keep(p, data[4 * at:4 * end])
                at = end + 1

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, or None where white space alone does not part them."""
        # added tokens may span white space, and str.split knows four separators more than the library
        if (self.rules.splitter and self.rules.splitter.search(text)) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        try:
            return text.encode("latin-1").translate(LOWER).decode("latin-1").split()  # composed already
        except UnicodeEncodeError:
            return self.compose(text).split()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.held = 0
        out, late = [], []
        for text in texts:
            pieces = self.pieces(text)
            found = [self.whole(text)] if pieces is None else list(map(self.__getitem__, pieces))
            if self.waiting and None in found:
                late.append((len(out), pieces))
                found = []
            out.append(b"".join(found))
        if late:
            self.learn(list(self.waiting))
            self.waiting.clear()
            for i, pieces in late:
                out[i] = b"".join(map(self.__getitem__, pieces))
        return out


def encoder(broadcast) -> Encoder:
    data = broadcast.value
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


# ------------------------------------------------------------------ the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths (0: id not in use) of the code with the fewest bits in all among those of at most ``limit`` bits.

    Package-merge: from the longest length up, the list of a length is the ids' own counts merged with the pairs of the
    list below it. An id's length is the number of lists whose ``2 * ids - 2`` first entries, carried down through the
    pairs they hold, contain it; as ids enter in order of count, a list only needs the number of ids it takes.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("more ids in use than codes of that length")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    own = counts[order].astype(np.int64)
    merged, single = own, [np.ones(len(own), dtype=bool)]  # of the longest length: ids only
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([own, packages])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        single.append(at < len(own))
    take = 2 * len(own) - 2
    for is_id in reversed(single):  # from the shortest length down
        ids = int(is_id[:take].sum())
        lengths[order[:ids]] += 1
        take = 2 * (take - ids)
    return lengths


@dataclass
class Code:
    lengths: np.ndarray   # by id
    codes: np.ndarray     # by id, right-aligned
    symbol: np.ndarray    # by the next LIMIT bits: the id
    width: np.ndarray     # by the next LIMIT bits: its length


def canonical(lengths: np.ndarray, limit: int = LIMIT) -> Code:
    """Codes in order of (length, id): each is the one before plus one, shifted to its length."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    span = np.int64(1) << (limit - lengths[ids].astype(np.int64))
    first = np.concatenate([[0], np.cumsum(span)])[:-1]
    codes = np.zeros(len(lengths), dtype=np.uint64)
    codes[ids] = (first >> (limit - lengths[ids].astype(np.int64))).astype(np.uint64)
    symbol = np.zeros(1 << limit, dtype=np.uint32)
    width = np.ones(1 << limit, dtype=np.uint8)
    filled = int(span.sum())
    symbol[:filled] = np.repeat(ids, span)
    width[:filled] = np.repeat(lengths[ids], span)
    return Code(lengths.astype(np.uint64), codes, symbol, width)


def write_bits(ids: np.ndarray, counts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of ``counts`` ids after each other: (bit streams as bytes, each from a whole byte on; byte at which each
    starts, and the end; bit offset of every id in its document's stream)."""
    width = code.lengths[ids]
    bits = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(width, out=bits[1:])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    base = np.concatenate([[0], np.cumsum((np.diff(bits[bounds]) + 7) >> 3)])
    inside = bits[:-1] - np.repeat(bits[bounds[:-1]], counts)
    at = inside + np.repeat(base[:-1] << 3, counts)
    words = np.zeros(int(base[-1]) // 4 + 3, dtype=np.uint64)
    place, shift = at >> 5, (at & 31).astype(np.uint64)
    # a code of at most 16 bits lies in the 64 bits from its 32-bit word on; codes never share bits, so sums are unions
    value = code.codes[ids] << (np.uint64(64) - shift - width)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    if len(new):
        both = np.add.reduceat(value, new)
        words[place[new]] += both >> np.uint64(32)
        words[place[new] + 1] += both & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").view(np.uint8)[: int(base[-1])], base, inside


def read_bits(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, code: Code) -> np.ndarray:
    """The ids of blocks that start at the bit offsets ``starts`` and hold ``counts`` ids, all blocks in step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]  # 32 bits from each byte on
    out = np.zeros(int(counts.sum()), dtype=np.uint32)
    order = np.argsort(-counts, kind="stable")
    at = starts[order].astype(np.int64)
    to = (np.cumsum(counts) - counts)[order]
    left = counts[order]
    lives = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")
    both = code.symbol.astype(np.uint32) << np.uint32(5) | code.width  # a width takes five bits
    for live in lives.tolist():  # blocks that hold an id at this step
        a = at[:live]
        bits = (window[a >> 3] >> (16 - (a & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        found, place = both[bits], to[:live]
        out[place] = found >> np.uint32(5)
        a += (found & np.uint32(31)).astype(np.int64)
        place += 1
    return out


# ------------------------------------------------------------------ files


class TokenStore:
    """A written store: ``blocks`` (parts in id order) and ``lengths`` under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def code(self) -> Code:
        rows = self.spark.read.parquet(f"{self.path}/lengths").collect()  # one row, one byte per vocabulary id
        return canonical(np.frombuffer(rows[0].lengths, np.uint8))

    def documents(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids): whole documents decoded block by block from the files."""
        shared = self.spark.sparkContext.broadcast(self.code())

        def run(batches):
            code = shared.value
            for batch in batches:
                n = batch.column("n_tokens").to_numpy()
                streams, offsets = batch.column("bits").to_pylist(), batch.column("checkpoints").to_pylist()
                for i, j in _groups(n):
                    base = np.cumsum([0] + [len(s) for s in streams[i:j]])
                    marks = [np.frombuffer(o, np.int64) for o in offsets[i:j]]
                    starts = np.concatenate([m + 8 * b for m, b in zip(marks, base)])
                    counts = np.concatenate([np.minimum(BLOCK, x - BLOCK * np.arange(len(m))) for m, x in zip(marks, n[i:j])])
                    ids = read_bits(np.frombuffer(b"".join(streams[i:j]), np.uint8), starts, counts, code)
                    ends = np.cumsum(n[i:j])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id")[i:j], batch.column("start")[i:j], batch.column("n_tokens")[i:j],
                         pa.array([x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

        blocks = self.spark.read.schema("doc_id long, start long, n_tokens long, checkpoints binary, bits binary").parquet(f"{self.path}/blocks")
        return map_arrow(blocks, run, "doc_id long, start long, n_tokens long, ids binary")

    def digests(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) from the files."""
        return self.documents().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _tokenise(shared, end_id: int, size: int):
    """Rows of documents, and a last one without doc_id that holds the counts of the range's ids."""
    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        e, z = encoder(shared), zstandard.ZstdCompressor(level=1)
        end, at = np.array([end_id], dtype="<u4").tobytes(), 0
        for batch in batches:
            for first, last, texts in text_groups(batch):
                ids = [x + end for x in e.encode_all([t.decode() for t in texts])]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                inside = at + np.cumsum(n) - n  # a range is one task, read in order
                at += int(n.sum())
                total += np.bincount(np.frombuffer(b"".join(ids), "<u4"), minlength=size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:last], pa.array(inside), pa.array(n), pa.array([z.compress(_planes(x)) for x in ids], pa.binary())],
                    ["doc_id", "inside", "n_tokens", "z"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([at]), pa.array([0]), pa.array([z.compress(total.tobytes())], pa.binary())],
                                         ["doc_id", "inside", "n_tokens", "z"])

    return run


def _planes(ids: bytes) -> bytes:
    """Low bytes, then the next, ...: what the compressor takes in for ids below 2**16 is half zeros."""
    return np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(-1, 4).T).tobytes()


def _ids(batch: pa.RecordBatch):
    """Groups of rows that hold about ``GROUP_IDS`` ids: (first row, end row, the rows' ids after each other)."""
    n, d = batch.column("n_tokens").to_numpy(), zstandard.ZstdDecompressor()
    for first, last in _groups(n):
        parts = []
        for z in batch.column("z")[first:last].to_pylist():
            raw = np.frombuffer(d.decompress(z), np.uint8).reshape(4, -1)
            parts.append(np.ascontiguousarray(raw.T).view("<u4").ravel())
        yield first, last, np.concatenate(parts)


def _groups(n: np.ndarray):
    i = 0
    while i < len(n):
        j, held = i, 0
        while j < len(n) and (held == 0 or held + n[j] <= GROUP_IDS):
            held += int(n[j])
            j += 1
        yield i, j
        i = j


def _counts(size: int):
    """(id, n) of the rows that hold counts, added up by task."""
    def run(batches):
        total, d = np.zeros(size, dtype=np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for z in batch.column("z").to_pylist():
                total += np.frombuffer(d.decompress(z), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])

    return run


def _code(shared):
    def run(batches):
        code = shared.value
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            for first, last, ids in _ids(batch):
                data, base, at = write_bits(ids, n[first:last], code)
                data, ends = data.tobytes(), np.cumsum(n[first:last])
                bits = [data[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]
                marks = [at[a:b:BLOCK].tobytes() for a, b in zip((ends - n[first:last]).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(c)[first:last] for c in ("doc_id", "start", "n_tokens", "range")]
                                                 + [pa.array(marks, pa.binary()), pa.array(bits, pa.binary())],
                                                 ["doc_id", "start", "n_tokens", "range", "checkpoints", "bits"])

    return run


def write_store(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 1) -> TokenStore:
    """Encode whole texts (null: empty), append ``end_id``, and write the coded files in ascending doc_id order.

    Rows with null doc_id are left out; repeated ids follow each other by a hash of the text; an empty table gives a
    store without documents; further columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    path = path or scratch_path(spark, "token-store")
    with open(vocabulary, "rb") as f:
        data = f.read()
    size = max(bpe_files.parse(data).strings) + 1
    docs = id_text(docs).where("doc_id is not null")
    docs = docs.withColumn("mixed", F.xxhash64("text"))  # samples of the range bounds carry no texts
    ranges = docs.repartitionByRange(partitions(spark), "doc_id", "mixed").sortWithinPartitions("doc_id", "mixed").drop("mixed")
    coded = map_arrow(ranges, _tokenise(spark.sparkContext.broadcast(data), end_id, size), "doc_id long, inside long, n_tokens long, z binary")
    ids = scratch.write("ids", coded.withColumn("range", F.spark_partition_id()))
    counts = np.zeros(size, dtype=np.int64)
    counted = ids.where("doc_id is null").select("z")  # a row per range
    for r in map_arrow(counted, _counts(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row per vocabulary id
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    # ids before each document: those before it in its range, and all of the ranges before (one row each)
    totals = {r.range: r.n for r in ids.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect()}
    before, at = [], 0
    for k in sorted(totals):
        before.append((k, at))
        at += totals[k]
    offsets = spark.createDataFrame(before, "range int, before long")
    rows = ids.where("doc_id is not null").join(F.broadcast(offsets), "range").withColumn("start", F.col("before") + F.col("inside")).sortWithinPartitions("range", "inside")
    out = map_arrow(rows.select("doc_id", "start", "n_tokens", "range", "z"), _code(spark.sparkContext.broadcast(canonical(lengths))),
                    "doc_id long, start long, n_tokens long, range int, checkpoints binary, bits binary")
    out.write.partitionBy("range").parquet(f"{path}/blocks")
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/lengths")
    scratch.drop("ids")
    return TokenStore(spark, path)
