"""Helpers shared by the training-data operators: shipping code, scratch tables, word hashing.

Words are maximal runs of bytes other than space and 0x09-0x0D. All hashing is numpy over a
concatenated byte buffer, in pieces of bounded size, so a batch of short texts and one very long
text cost the same memory per byte.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_path  # noqa: F401  (re-exported for the operators)

PIECE_BYTES = 1 << 20
SQUEEZED_ROWS = 1000
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_VALUE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application (they may not share the driver's path)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def partitions(spark: SparkSession, at_least: int = 8) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*(columns or ("doc_id", "text")))


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` for a generator over record batches; the package is shipped first."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read, whatever else the table carries; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): every other column in one struct, so that no name can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))


def uncarried(rows: DataFrame, like: DataFrame, counted: bool = True) -> DataFrame:
    """The columns of ``like`` from (doc_id, text, rest), n_chars following the text if ``counted``."""
    def column(c: str):
        if c == "n_chars" and counted:
            return F.char_length("text").cast(like.schema[c].dataType).alias(c)
        return F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`")

    return rows.select([column(c) for c in like.columns])


def squeezed(docs: DataFrame, rest: bool = False) -> DataFrame:
    """(doc_id, z[, rest]): texts as zstd binary, about half of what a shuffle's own compression leaves."""
    names = ["doc_id", "z"] + ["rest"] * rest
    rows = carried(docs)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("z", T.BinaryType())] + [rows.schema["rest"]] * rest)

    def run(batches):
        c = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for first in range(0, whole.num_rows, SQUEEZED_ROWS):
                batch = whole.slice(first, SQUEEZED_ROWS)
                z = [c.compress(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(z, pa.binary())] + ([batch.column("rest")] if rest else []), names)

    return map_arrow(rows if rest else rows.drop("rest"), run, schema)


def unsqueezed(batch: pa.RecordBatch) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(z) for z in batch.column("z").to_pylist()]


# ------------------------------------------------------------------ numpy over texts


def text_groups(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive rows of a batch whose texts hold about ``limit`` bytes: (first row, end row, texts)."""
    rows = unsqueezed(batch) if column == "z" else batch.column(column).cast(pa.binary()).to_pylist()
    data, first, held = [], 0, 0
    for i, text in enumerate(rows):
        data.append(text or b"")
        held += len(data[-1])
        if held >= limit:
            yield first, i + 1, data
            data, first, held = [], i + 1, 0
    if data:
        yield first, first + len(data), data


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for reuse."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=np.uint64)
        if size > 4 * PIECE_BYTES:
            _powers.pop(base)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_spans(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a buffer."""
    space = _SPACE[np.frombuffer(buf, dtype=np.uint8)]
    edge = np.ones(len(space) + 2, dtype=bool)
    edge[1:-1] = space
    flips = np.flatnonzero(edge[1:] != edge[:-1])
    return flips[::2], flips[1::2]


def _hash_piece(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(buf)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[np.frombuffer(buf, dtype=np.uint8)] * powers(_BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the offsets of each text's words."""
    buf = b"\n".join(texts)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, ends = word_spans(buf)
    offsets = np.searchsorted(starts, bounds)
    if len(buf) <= 2 * PIECE_BYTES:
        return _hash_piece(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64), offsets
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES)))
        lo, hi = int(starts[i]), int(ends[j - 1])
        out.append(_hash_piece(buf[lo:hi], starts[i:j] - lo, ends[i:j] - lo))
        i = j
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offsets


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words (one fewer than ``n`` shorter than the input)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    c = powers(0xFF51AFD7ED558CCD, n)
    total = words[: len(words) - n + 1] * c[0]
    for k in range(1, n):
        total = total + words[k : len(words) - n + 1 + k] * c[k]
    return mix(total)


def ragged(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column whose row i is ``values[offsets[i]:offsets[i+1]]``."""
    v = np.ascontiguousarray(values)
    off = (np.asarray(offsets, dtype=np.int64) * v.dtype.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(v)]).cast(pa.binary())
