"""Byte-pair merges of many words at once, in flat numpy arrays."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max


class PairTable:
    """Rank and merged symbol of a pair of symbols: an open-addressing table probed with whole arrays."""

    def __init__(self, base: int, keys: np.ndarray, ids: np.ndarray, ranks: np.ndarray):
        self.base = base
        self.bits = max(10, int(len(keys) * 8).bit_length())
        self.key = np.full((1 << self.bits) + 64, -1, np.int64)
        self.id, self.rank = np.zeros_like(self.key), np.full_like(self.key, NONE)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):  # a probe distance at a time
            slot = self._slot(keys[left]) + self.probes
            free = self.key[slot] < 0
            self.key[slot[free]] = keys[left[free]]
            put = self.key[slot] == keys[left]
            self.id[slot[put]], self.rank[slot[put]] = ids[left[put]], ranks[left[put]]
            left, self.probes = left[~put], self.probes + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` without a merge) and merged symbol of each pair."""
        key = left * self.base + right
        slot = self._slot(key)
        found = self.key[slot]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] += 1
            there = self.key[slot[open_]]
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return np.where(self.key[slot] == key, self.rank[slot], NONE), self.id[slot]


def merge_rounds(sym: np.ndarray, word: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge until no word has a pair left; symbols, the place of each one's first character, and its word.

    A round takes the segmented minimum of the pair ranks per word, merges all of a word's pairs of
    that rank from the left, and compacts.  One-at-a-time merging takes the lowest rank first and the
    leftmost pair among equals; the results can differ only if a merge makes a pair that ranks no
    later than the round's rank, and then only the word's leftmost pair is merged in the round.
    """
    place = np.arange(len(sym))
    rank, merged = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
    if len(sym) > 1:
        r, m = pairs(sym[:-1], sym[1:])
        rank[:-1], merged[:-1] = np.where(word[:-1] == word[1:], r, NONE), m
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(sym[:0], place[:0], word[:0])]
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
        idle = best == NONE
        if idle.any():
            done.append((sym[idle], place[idle], word[idle]))
            busy = ~idle
            sym, place, word, rank, merged, best = (x[busy] for x in (sym, place, word, rank, merged, best))
        n = len(sym)
        at = np.flatnonzero(rank == best)
        if not len(at):
            break
        # overlapping pairs of one rank: of each run of neighbours, every second one from the left
        at = at[(at - np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], at, 0))) % 2 == 0]
        new, keep = sym.copy(), np.ones(n, bool)
        new[at] = merged[at]
        keep[at + 1] = False
        before = at - 1
        before -= ~keep[before] & (before >= 0)
        has = (before >= 0) & (word[before] == word[at])
        early = np.zeros(len(at), bool)
        early[has] = pairs(new[before[has]], new[at[has]])[0] <= best[at[has]]
        after = np.minimum(at + 2, n - 1)
        has = (at + 2 < n) & (word[after] == word[at])
        early[has] |= pairs(new[at[has]], sym[after[has]])[0] <= best[at[has]]
        if early.any():
            careful = np.isin(word[at], word[at[early]])
            at = at[~careful | np.r_[True, word[at[1:]] != word[at[:-1]]]]
            new, keep = sym.copy(), np.ones(n, bool)
            new[at] = merged[at]
            keep[at + 1] = False
        moved = np.cumsum(keep)[at] - 1
        sym, place, word, rank, merged = new[keep], place[keep], word[keep], rank[keep], merged[keep]
        touched = np.r_[moved, moved[moved > 0] - 1]
        rank[touched] = NONE
        touched = touched[touched + 1 < len(sym)]
        touched = touched[word[touched] == word[touched + 1]]
        rank[touched], merged[touched] = pairs(sym[touched], sym[touched + 1])
    sym, place, word = (np.concatenate(x) for x in zip(*done, strict=True))
    by = np.argsort(place)
    return sym[by], place[by], word[by]
