"""Maximal periodic runs of words: Lyndon arrays from Baier's grouping, roots extended to runs.

Every run has a Lyndon root that is the longest Lyndon word at its start under the order of the
words or under the reverse order. The first phase of Baier's suffix sorter groups suffixes by just
that word: groups are taken from the highest down, and the nearest suffix to the left of a group's
member that is still waiting gets its context longer by the group's context. What a group's context has grown
to when its turn comes is the Lyndon array, with no suffix array built. Roots are extended to both
sides by longest common extensions (names of all stretches of 2**k words), and those of the wanted
exponent are the runs.

Only words inside a run of at least ``least`` words matter, and all of a run is covered by windows of ``least``/2
words that occur twice in it. Words that no repeated window covers are set aside first, which for
ordinary prose leaves nothing to group.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import carried, gram_hashes, id_text, map_arrow, mix, text_groups, uncarried, word_hashes

Edit = Callable[[int | None, int], np.ndarray | None]


# ------------------------------------------------------------------ runs of one array


def lyndon_array(x: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every place of ``x`` (values 0 .. k-1, all in use; the end is least)."""
    n = len(x)
    size = max(x) + 1 if n else 0
    members: list[list[int]] = [[] for _ in range(size)]
    for i, v in enumerate(x):
        members[v].append(i + 1)  # places from 1 on; 0 is left of the text
    context = [1] * size
    group = [0, *x]
    below, above = list(range(-1, size - 1)), [*range(1, size), -1]
    waiting = list(range(n + 1))  # union-find: nearest place to the left, or here, whose group's turn is yet to come
    found = [0] * (n + 1)
    g = size - 1
    while g >= 0:
        now = [i for i in members[g] if group[i] == g]
        c = context[g]
        for i in now:
            found[i] = c
            waiting[i] = i - 1
        meets: dict[int, int] = {}
        for i in now:
            j = waiting[i]
            while waiting[j] != j:
                waiting[j] = j = waiting[waiting[j]]
            waiting[i] = j
            if j:
                meets[j] = meets.get(j, 0) + 1
        if len(meets) == 1:
            (j, times), = meets.items()
            moves = [((-times, group[j]), [j])]
        else:
            parts: dict[tuple[int, int], list[int]] = {}
            for j, times in meets.items():
                parts.setdefault((-times, group[j]), []).append(j)
            moves = sorted(parts.items()) if len(parts) > 1 else parts.items()
        for (times, old), places in moves:
            new = len(context)
            context.append(context[old] - times * c)
            members.append(places)
            for j in places:
                group[j] = new
            up = above[old]  # the new group stands right above the old one, of which it is a part
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        g = below[g]
    return found[1:]


class Extensions:
    """Longest common extensions of an array to the right and to the left, exact, for arrays of queries."""

    def __init__(self, x: np.ndarray):
        self.n, self.names = len(x), [x.astype(np.int64)]
        width = 1
        while 2 * width <= self.n:
            last = self.names[-1]
            pair = last[: self.n - 2 * width + 1] * (int(last.max()) + 1) + last[width: self.n - width + 1]
            values, name = np.unique(pair, return_inverse=True)
            self.names[-1] = last.astype(np.int32)
            if len(values) == len(pair):  # nothing of that length repeats
                break
            self.names.append(name.astype(np.int64))
            width *= 2
        self.names[-1] = self.names[-1].astype(np.int32)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common part from i and from j on (i < j)."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b, name = i + out, j + out, self.names[k]
            fits = np.flatnonzero(b + (1 << k) <= self.n)
            out[fits[name[a[fits]] == name[b[fits]]]] += 1 << k
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common part that ends right before i and right before j (i < j)."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b, name = i - out - (1 << k), j - out - (1 << k), self.names[k]
            fits = np.flatnonzero(a >= 0)
            out[fits[name[a[fits]] == name[b[fits]]]] += 1 << k
        return out


def array_runs(values: np.ndarray, least: int = 2) -> np.ndarray:
    """Rows (start, length, period), in order of start, of the maximal runs of length >= max(least, 2 * period)."""
    _, x = np.unique(values, return_inverse=True)
    n = len(x)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    place = np.arange(n)
    roots = []
    for order in (x, x.max() - x):
        p = np.array(lyndon_array(order.tolist()), dtype=np.int64)
        near = np.minimum(place + p, n - 1)
        may = ((place + p < n) & (x[place] == x[near])) | ((place > 0) & (x[place - 1] == x[place + p - 1]))
        roots.append(np.stack([place[may], p[may]], 1))
    i, p = np.unique(np.concatenate(roots), axis=0).T
    lce = Extensions(x)
    start = i - lce.left(i, i + p)
    length = i + p + lce.right(i, i + p) - start
    long = length >= np.maximum(least, 2 * p)
    return np.unique(np.stack([start, length, p], 1)[long], axis=0)[:, [0, 1, 2]]


# ------------------------------------------------------------------ runs of texts


def _stretches(words: np.ndarray, part: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least ``least`` words covered by windows that occur twice in their part.

    Parts are numbered in rising order. A stretch is a part of its own in the next pass; passes end when nothing is set aside.
    """
    place = np.arange(len(words))
    while len(words) >= window:
        gram = mix(gram_hashes(words, window) + part[: len(words) - window + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        inside = np.flatnonzero(part[: len(words) - window + 1] == part[window - 1:])
        order = inside[np.argsort(gram[inside], kind="stable")]
        same = gram[order[1:]] == gram[order[:-1]]
        again = np.zeros(len(order), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        at = order[again]
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        cut = np.concatenate([[True], (covered[1:] != covered[:-1]) | (part[1:] != part[:-1])])
        piece = np.cumsum(cut) - 1
        keep = covered & (np.bincount(piece)[piece] >= least)
        if keep.all() and len(np.unique(piece)) == len(np.unique(part)):
            break
        words, part, place = words[keep], piece[keep], place[keep]
    else:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return place[first], place[np.append(first[1:], len(part)) - 1] + 1


def _runs_of_texts(words: np.ndarray, offsets: np.ndarray, least: int) -> list[np.ndarray]:
    """Runs (start, length, period) of each text; ``words`` are word hashes, text k has ``offsets[k]:offsets[k+1]``."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(offsets) - 1)]
    part = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for a, b in zip(*_stretches(words, part, (least + 1) // 2, least)):
        runs = array_runs(words[a:b], least)
        if len(runs):
            k = int(part[a])
            out[k].append(runs + np.array([a - offsets[k], 0, 0]))
    return [np.concatenate(r) if r else np.zeros((0, 3), np.int64) for r in out]


def _groups(batch: pa.RecordBatch, least: int, edit: Edit | None):
    """Rows of a batch in groups: (first row, end row, [(words, runs)]), the words as edited."""
    for first, end, texts in text_groups(batch):
        hashes, offsets = word_hashes(texts)
        words = [t.split() for t in texts]
        if edit is not None:
            ids = batch.column("doc_id")[first:end].to_pylist()
            for k, (i, w) in enumerate(zip(ids, words)):
                source = edit(i, len(w))
                if source is not None:
                    hashes[offsets[k]:offsets[k + 1]] = hashes[offsets[k]:offsets[k + 1]][source]
                    words[k] = [w[j] for j in source.tolist()]
        yield first, end, list(zip(words, _runs_of_texts(hashes, offsets, least)))


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


def runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, start, length, period) of every maximal run of at least max(``least``, 2 * period) words.

    Words are maximal runs of other than space and 0x09-0x0D. Null and empty texts have no runs; null doc_ids pass through;
    each of repeated rows gives its runs; an empty table gives an empty result; further columns are not read.
    """
    def run(batches):
        for batch in batches:
            for first, end, found in _groups(batch, least, None):
                n = np.array([len(r) for _, r in found])
                ids = batch.column("doc_id")[first:end].take(pa.array(np.repeat(np.arange(len(n)), n)))
                all_runs = np.concatenate([r for _, r in found])
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(all_runs[:, c]) for c in range(3))], ["doc_id", "start", "length", "period"])

    return map_arrow(id_text(docs), run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, least: int = 12) -> DataFrame:
    """``docs`` with each run reduced to its first period: kept words joined by one space where a run was found.

    Texts without a run stay as they are, null among them; n_chars, if there, follows the text; other columns of any name stay.
    Repeated rows are each treated; an empty table stays empty.
    """
    rows = carried(docs)

    def run(batches):
        for batch in batches:
            for first, end, found in _groups(batch, least, None):
                old = batch.column("text")[first:end].to_pylist()
                new = [t if not len(r) else _collapsed(w, r).decode() for t, (w, r) in zip(old, found)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], pa.array(new, pa.string()), batch.column("rest")[first:end]],
                                                 ["doc_id", "text", "rest"])

    return uncarried(map_arrow(rows, run, rows.schema), docs)


def planted_periods(doc_id: int | None, n: int) -> np.ndarray | None:
    """Source places of the words of a text whose tail is made periodic, for a tenth of the ids; None: unchanged."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    source = np.arange(n)
    source[a:] = a + (source[a:] - a) % p
    return source


DIGEST = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def digests(docs: DataFrame, least: int = 12, edit: Edit | None = None) -> DataFrame:
    """Per input row: number of runs, the longest (ties: smallest start, then period), digests of all runs and of the collapsed text.

    ``edit(doc_id, n)`` gives source places of the words to look at in place of the text's own order, or None.
    Null and empty texts have no runs and collapse to the empty text; rows are treated as by :func:`runs`.
    """
    def run(batches):
        for batch in batches:
            for first, end, found in _groups(batch, least, edit):
                cols: list[list] = [[] for _ in range(7)]
                for words, r in found:
                    r = r[np.lexsort((r[:, 2], r[:, 0]))]
                    top = (None,) * 4
                    if len(r):
                        s, n, p = r[np.argmax(r[:, 1])].tolist()  # the first of the longest
                        top = (s, n, p, 1000 * n // p)
                    lines = "".join(f"{s},{n},{p}\n" for s, n, p in r.tolist())
                    row = (len(r), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(_collapsed(words, r)).hexdigest())
                    for c, v in zip(cols, row):
                        c.append(v)
                types = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], *(pa.array(c, t) for c, t in zip(cols, types))],
                                                 [f.split()[0] for f in DIGEST.split(", ")])

    return map_arrow(id_text(docs), run, DIGEST)
