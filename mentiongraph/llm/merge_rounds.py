"""Byte-pair merging of many words at once, in vectorised rounds over one flat array of symbols.

Each round takes, by a segmented minimum, the lowest pair rank of every word, merges that pair at all
its leftmost places without overlap, compacts the array and looks up the ranks of the pairs that are
new; a word without a mergeable pair leaves the array. Merging all places of a rank in one round is
exact unless a merge can open a pair of lower rank beside it; the ranks for which that can happen are
found when a table is made, and of these a round merges a word's leftmost place only.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max
Pairs = dict[tuple[int, int], tuple[int, int]]


class PairTable:
    """(left id, right id) -> (rank, merged id), looked up for whole arrays by hashed slots."""

    def __init__(self, pairs: Pairs):
        keys = np.array([a << 32 | b for a, b in pairs] or [0], dtype=np.uint64)
        values = np.array(list(pairs.values()) or [(NONE, 0)], dtype=np.int32)
        self.alone = opening_ranks(pairs)
        self.levels = []
        bits = 21
        while len(keys):  # what shares a slot with an earlier key goes to the next, smaller table
            slot = self._slot(keys, bits, len(self.levels))
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << bits, -1, dtype=np.int32)
            table[slot[first]] = np.arange(len(first), dtype=np.int32)
            self.levels.append((bits, table, keys[first], values[first]))
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, values, bits = keys[rest], values[rest], max(8, bits - 3)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15 + 2 * level) + (keys >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        rank, merged = np.full(len(keys), NONE, dtype=np.int32), np.zeros(len(keys), dtype=np.int32)
        for level, (bits, table, known, values) in enumerate(self.levels):
            at = table[self._slot(keys, bits, level)]
            some = np.flatnonzero(at >= 0)
            some = some[known[at[some]] == keys[some]]
            rank[some], merged[some] = values[at[some], 0], values[at[some], 1]
        return rank, merged

    def pair_ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and results of the pairs that start at the places ``at`` (all); none at a word's end."""
        at = np.arange(len(sym)) if at is None else at
        right = np.minimum(at + 1, len(sym) - 1)
        rank, merged = self.find(sym[at], sym[right])
        rank[(right == at) | (word[right] != word[at])] = NONE
        return rank, merged

    def merge(self, sym: np.ndarray, word: np.ndarray, last: int = NONE) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, words) after all merges of ranks below ``last``; ``word`` numbers the symbols' words in rising order."""
        rank, merged = self.pair_ranks(sym, word)
        done_sym, done_word = [np.zeros(0, sym.dtype)], [np.zeros(0, word.dtype)]
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            n = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            going = least < last
            if not going.all():
                over = np.repeat(~going, n)
                done_sym.append(sym[over])
                done_word.append(word[over])
                least, n = least[going], n[going]
                sym, word, rank, merged = sym[~over], word[~over], rank[~over], merged[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, n))
            # neighbouring places of one rank overlap: every other one of such a row, from its left end
            row = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
            at = at[(np.arange(len(at)) - np.repeat(row, np.diff(np.append(row, len(at))))) % 2 == 0]
            alone = self.alone[rank[at]]
            if alone.any():
                at = at[~alone | np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            sym[at] = merged[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
            at -= np.arange(len(at))  # places removed before each
            near = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
            rank[near], merged[near] = self.pair_ranks(sym, word, near)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]


def opening_ranks(pairs: Pairs) -> np.ndarray:
    """By rank: whether merging such a pair can open one of lower rank beside it.

    A pair (x, m) of lower rank than the merge (a, b) -> m comes up only if (x, a) had no lower rank itself, or it
    would have merged before; likewise to the right.
    """
    before: dict[int, list[tuple[int, int]]] = {}
    after: dict[int, list[tuple[int, int]]] = {}
    for (a, b), (r, _) in pairs.items():
        before.setdefault(b, []).append((a, r))
        after.setdefault(a, []).append((b, r))
    alone = np.zeros(max((r for r, _ in pairs.values()), default=0) + 1, dtype=bool)
    none = (NONE, 0)
    for (a, b), (r, m) in pairs.items():
        alone[r] = alone[r] or any(q < r <= pairs.get((x, a), none)[0] for x, q in before.get(m, ())) \
            or any(q < r <= pairs.get((b, y), none)[0] for y, q in after.get(m, ()))
    return alone
