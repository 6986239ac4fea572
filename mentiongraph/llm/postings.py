"""Counting hashes over a whole table with packed rows and map-side combining.

A posting is (hash, key, place). Map tasks gather postings, sort them by hash and write one row per
fragment of the hash order, its arrays packed as binary. A hash met twice within one such write is
known to repeat: its postings go on as *known* and only one marker is left to be counted, so a hash
held by a third of all rows costs each write one entry and never gathers in one task. The reducer
of a fragment sorts what it was dealt and reports the postings whose hash occurs more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, mix, ragged

COUNTED, KNOWN, ROWS = 0, 1, 2
MARKER = np.iinfo(np.int64).min
WRITE_AT = 400_000
SCHEMA = "part int, kind int, h binary, k binary, p binary"
NAMES = ["part", "kind", "h", "k", "p"]


class Writer:
    """Gathers postings of one task. ``distinct``: equal (hash, key) are one posting."""

    def __init__(self, parts: int, distinct: bool):
        self.parts, self.distinct = parts, distinct
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, h: np.ndarray, k: np.ndarray, p: np.ndarray) -> None:
        self.held.append((h, k, p))
        self.size += len(h)

    def add_rows(self, h: np.ndarray, k: np.ndarray, p: np.ndarray) -> None:
        """Rows that pass through uncounted."""
        self.rows.append((h, k, p))
        self.size += len(h)

    def full(self) -> bool:
        return self.size >= WRITE_AT

    def part_of(self, h: np.ndarray) -> np.ndarray:
        """Fragment of the hash order: a cut of it into ``parts`` equal ranges."""
        return ((h >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int32)

    def _pack(self, kind: int, h: np.ndarray, k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        part = self.part_of(h)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        off = np.append(first, len(h))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[first]), pa.array(np.full(len(first), kind, np.int32)), ragged(off, h), ragged(off, k), ragged(off, p)], NAMES)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            h, k, p = (np.concatenate(x) for x in zip(*self.rows))
            order = np.argsort(h, kind="stable")
            yield self._pack(ROWS, h[order], k[order], p[order])
        if self.held:
            h, k, p = (np.concatenate(x) for x in zip(*self.held))
            if len(h):
                h, k, p = sort_postings(h, k, p, self.distinct)
                again, first = repeated(h), starts(h)
                if again.any():
                    yield self._pack(KNOWN, h[again], k[again], p[again])
                once = ~again | first
                k = np.where(again, MARKER, k)
                yield self._pack(COUNTED, h[once], k[once], p[once])
        self.held, self.rows, self.size = [], [], 0


def sort_postings(h, k, p, distinct: bool):
    if not distinct:
        order = np.argsort(h, kind="stable")
        return h[order], k[order], p[order]
    order = np.lexsort((k, h))
    h, k, p = h[order], k[order], p[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    return h[keep], k[keep], p[keep]


def starts(h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    out[1:] = h[1:] != h[:-1]
    return out


def repeated(h: np.ndarray) -> np.ndarray:
    """For sorted hashes: whether the neighbour is equal."""
    out = np.zeros(len(h), dtype=bool)
    same = h[1:] == h[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _gather(batches) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    got: dict[int, list[list[bytes]]] = {}
    for b in batches:
        for kind, *cols in zip(*(b.column(c).to_pylist() for c in NAMES[1:])):
            lists = got.setdefault(kind, [[], [], []])
            for x, v in zip(lists, cols):
                x.append(v)
    return {kind: (np.frombuffer(b"".join(h), np.uint64), np.frombuffer(b"".join(k), np.int64), np.frombuffer(b"".join(p), np.int32))
            for kind, (h, k, p) in got.items()}


def repeated_postings(batches, distinct: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The postings of one partition whose hash occurs more than once anywhere in the table."""
    got = _gather(batches)
    if ROWS in got:
        yield (ROWS, *got[ROWS])
    if KNOWN in got:
        yield (KNOWN, *got[KNOWN])
    if COUNTED in got:
        h, k, p = sort_postings(*got[COUNTED], distinct)
        again = repeated(h)
        # a marker alone with others of its hash, or alone: it stands for at least two postings already sent on as known
        keep = again & (k != MARKER)
        yield (COUNTED, h[keep], k[keep], p[keep])


def frequencies(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, key, how many keys have it) of the distinct postings of one partition whose hash has two keys or more, then the rows."""
    got = _gather(batches)
    found = [got[x] for x in (KNOWN, COUNTED) if x in got]
    if found:
        h, k, p = (np.concatenate(x) for x in zip(*found))
        real = k != MARKER  # what a marker stands for is among the known ones
        h, k, p = sort_postings(h[real], k[real], p[real], True)
        n = np.diff(np.append(np.flatnonzero(starts(h)), len(h)))
        n = np.repeat(n, n)
        yield h[n > 1], k[n > 1], n[n > 1].astype(np.int32)
    if ROWS in got:
        yield got[ROWS]


def exchange(postings: DataFrame, parts: int) -> DataFrame:
    """Deal packed rows out by fragment."""
    return postings.repartitionById(parts, "part")


def _bucket_of(k: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(k.view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _by_bucket(found, parts: int, hashes: bool) -> Iterator[pa.RecordBatch]:
    """Postings as one packed row for each bucket of keys; the hashes are left behind unless asked for."""
    for *_, h, k, p in found:
        if not len(h):
            continue
        bucket = _bucket_of(k, parts)
        order = np.argsort(bucket, kind="stable")
        bucket, h, k, p = bucket[order], h[order], k[order], p[order]
        first = np.flatnonzero(starts(bucket))
        off = np.append(first, len(k))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(np.zeros(len(first), np.int32)),
                                          ragged(off if hashes else off * 0, h), ragged(off, k), ragged(off, p)], NAMES)


def _by_key(batches) -> Iterator[pa.RecordBatch]:
    """The postings of one bucket of keys: (key, places in order as int32, hashes as uint64), both packed."""
    for h, k, p in _gather(batches).values():
        h = h if len(h) else np.zeros(len(k), np.uint64)
        order = np.lexsort((p, k))
        h, k, p = h[order], k[order], p[order]
        first = np.flatnonzero(starts(k))
        off = np.append(first, len(k))
        yield pa.RecordBatch.from_arrays([pa.array(k[first]), ragged(off, p), ragged(off, h)], ["key", "p", "h"])


def gathered(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All postings of one bucket of keys: hashes, keys, places."""
    got = list(_gather(batches).values())
    return tuple(np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))


def frequencies_by_key(postings: DataFrame, parts: int) -> DataFrame:
    """What :func:`frequencies` finds, dealt out by key."""
    return exchange(map_arrow(exchange(postings, parts), lambda b: _by_bucket(frequencies(b), parts, True), SCHEMA), parts)


def repeated_by_key(postings: DataFrame, parts: int, distinct: bool = False, hashes: bool = True) -> DataFrame:
    """(key, p, h): one row per key, with the places and hashes (else zeros) of its postings whose hash occurs twice or more."""
    found = map_arrow(exchange(postings, parts), lambda b: _by_bucket(repeated_postings(b, distinct), parts, hashes), SCHEMA)
    return map_arrow(exchange(found, parts), _by_key, "key long, p binary, h binary")
