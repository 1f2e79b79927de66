"""Merging adjacent symbol pairs in the order of their score: one agenda for a long segment, many short ones in lockstep."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

NONE = np.iinfo(np.int64).max
#: Segments of more symbols get an agenda of their own; the others advance together, a merge each in every round.
LONG = 256


class Merges:
    """The pairs (left, right) of symbols that merge, the rank of each (the smallest merges first) and what they become."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray):
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        order = np.lexsort((rank, keys))
        keys, rank, result = keys[order], rank[order].astype(np.int64), result[order].astype(np.int64)
        first = np.append(True, keys[1:] != keys[:-1])
        self.keys, self.rank, self.result = keys[first], rank[first], result[first]
        self.table: dict[int, tuple[int, int]] = {}  # made for the first long segment

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (NONE if it does not merge) and its place."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE), at

    def one(self, symbols: list[int]) -> list[int]:
        """The agenda proper: the best pair (of equals the leftmost) merges and its neighbours' new pairs join the agenda."""
        if not self.table:
            self.table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.result.tolist(), strict=True), strict=True))
        sym, n = list(symbols), len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        found = self.table.get
        agenda = [(*hit, i, sym[i], sym[i + 1]) for i in range(n - 1) if (hit := found(sym[i] << 32 | sym[i + 1]))]
        agenda = [(rank, i, a, b, result) for rank, result, i, a, b in agenda]
        heapify(agenda)
        while agenda:
            _, i, a, b, result = heappop(agenda)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # one of the two has merged with another
            sym[i], sym[j] = result, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if hit := found(result << 32 | sym[k]):
                    heappush(agenda, (hit[0], i, result, sym[k], hit[1]))
            h = before[i]
            if h >= 0 and (hit := found(sym[h] << 32 | result)):
                heappush(agenda, (hit[0], h, sym[h], result, hit[1]))
        return [s for s in sym if s >= 0]

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each segment of the joined ``symbols`` to the end; gives the joined results and their lengths."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        edges = np.concatenate([[0], np.cumsum(lengths)])
        for k in np.flatnonzero(lengths > LONG):
            one = np.array(self.one(symbols[edges[k] : edges[k + 1]].tolist()), np.int64)
            done.append((np.full(len(one), k), one))
        short = (lengths <= LONG) & (lengths > 0)
        sym, seg = symbols[np.repeat(short, lengths)].astype(np.int64), np.repeat(np.flatnonzero(short), lengths[short])
        rank, at = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym):
            r, at[:-1] = self._find(sym[:-1], sym[1:])
            rank[:-1] = np.where(seg[1:] == seg[:-1], r, NONE)
        while len(sym):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            over = np.repeat(best == NONE, count)
            done.append((seg[over], sym[over]))
            hit = np.flatnonzero((rank == np.repeat(best, count)) & ~over)
            if not hit.size:
                break
            hit = hit[np.append(True, seg[hit[1:]] != seg[hit[:-1]])]
            sym[hit] = self.result[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            new = np.cumsum(keep)[hit] - 1
            sym, seg, rank, at = sym[keep], seg[keep], rank[keep], at[keep]
            for i in (new - 1, new):
                i = i[i >= 0]
                j = np.minimum(i + 1, len(sym) - 1)
                r, a = self._find(sym[i], sym[j])
                rank[i], at[i] = np.where((seg[i] == seg[j]) & (i < j), r, NONE), a
        segs = np.concatenate([s for s, _ in done]) if done else np.empty(0, np.int64)
        order = np.argsort(segs, kind="stable")
        flat = np.concatenate([x for _, x in done])[order] if done else np.empty(0, np.int64)
        return flat, np.bincount(segs, minlength=len(lengths))
