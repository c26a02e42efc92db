"""A run-length compressed Burrows-Wheeler index and matching statistics, many queries in step."""

from __future__ import annotations

import numpy as np

from .anchors import BYTE, Rolling


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of t (symbols below 512) in order, by doubling; only unsettled ones are sorted again."""
    n, k = len(t), 7
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= 9
        key[: max(0, n - j)] |= t[j:]
    sa = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[sa][1:] != key[sa][:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    idx = np.arange(n)
    while True:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        idx = idx[~(new & last)[idx]]
        if not len(idx):
            return sa
        at = sa[idx]
        far = at + k
        key = rank[at] << 32 | np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        order = np.argsort(key)
        key, at = key[order], at[order]
        sa[idx] = at
        first = np.ones(len(idx), bool)
        first[1:] = key[1:] != key[:-1]
        new[idx] = first
        rank[at] = np.maximum.accumulate(np.where(first, idx, 0))
        k *= 2


class RunIndex:
    """The Burrows-Wheeler transform of texts as runs, with suffix array samples at both ends of each run.

    Texts are byte strings, each followed by a separator that no query has. The index proper has an entry
    for each run; beside it stand the texts' prefix hashes, for common prefixes, and the bounds of the texts.
    The whole suffix array exists only while the index is built.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        stop = np.cumsum(lengths)
        t = np.insert(data.astype(np.int64) + 1, stop, 0)
        n = len(t)
        sa = suffix_array(t)
        bwt = t[sa - 1]
        head = np.ones(n, bool)
        head[1:] = bwt[1:] != bwt[:-1]
        self.start = np.flatnonzero(head)  # rows
        end = np.append(self.start[1:], n) - 1
        self.symbol = bwt[self.start]
        self.first, self.last = sa[self.start], sa[end]  # samples
        runs = len(self.start)
        self.by_symbol = np.argsort(self.symbol, kind="stable")
        size = end - self.start + 1
        row = np.empty(runs, np.int64)  # of the symbol's first occurrence in the run, as a suffix
        row[self.by_symbol] = np.cumsum(size[self.by_symbol]) - size[self.by_symbol]
        self.to = row
        self.key = self.symbol[self.by_symbol] * runs + self.by_symbol
        self.runs, self.n, self.any = runs, n, int(sa[0])
        self.text_at = np.concatenate([[0], stop + np.arange(1, len(lengths) + 1)])
        self.hash = Rolling(np.concatenate([[0], BYTE, BYTE[:1]])[t].astype(np.uint64) * np.uint64(3))

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes a and b, up to `most`."""
        h, down, n = self.hash.h, self.hash.down, self.n
        hi = np.minimum(most, n - np.maximum(a, b))
        lo, own = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(own):
            x, y, mid = a[own], b[own], (lo[own] + hi[own] + 1) >> 1
            same = (h[x + mid] - h[x]) * down[x] == (h[y + mid] - h[y]) * down[y]
            lo[own[same]], hi[own[~same]] = mid[same], mid[~same] - 1
            own = own[lo[own] < hi[own]]
        return lo

    def whereabouts(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which text a place is in, and how far from its start."""
        text = np.searchsorted(self.text_at, place, side="right") - 1
        return text, place - self.text_at[text]

    def matching_statistics(self, data: np.ndarray, offs: np.ndarray, most: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the queries: the longest match (up to `most`) of the text from there with
        any indexed text, and a place of that match.

        Queries are read from their ends, all in step. A row whose run has the next symbol is followed;
        else the nearer end, by common prefix, of the runs of that symbol above and below goes on.
        A query is left where no match from there or before can reach `least` any more: its places keep 0.
        """
        length, place = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        at = offs[1:] - 1
        begin = offs[:-1]
        order = np.argsort(begin - at, kind="stable")  # longest first
        at, begin = at[order], begin[order]
        row, ptr, l = (np.zeros(len(at), np.int64) for _ in range(3))
        ptr += self.any
        live = int(np.searchsorted(begin - at, 0, side="right"))
        runs, steps = self.runs, 0
        while live:
            at, begin, row, ptr, l = at[:live], begin[:live], row[:live], ptr[:live], l[:live]
            c = data[at].astype(np.int64) + 1
            run = np.searchsorted(self.start, row, side="right") - 1
            away = np.flatnonzero(self.symbol[run] != c)
            if len(away):
                k = np.searchsorted(self.key, c[away] * runs + run[away])
                up, down = k - 1, np.minimum(k, runs - 1)
                has_up = (up >= 0) & (self.key[np.maximum(up, 0)] // runs == c[away])
                has_down = (k < runs) & (self.key[down] // runs == c[away])
                y, z = self.by_symbol[np.maximum(up, 0)], self.by_symbol[down]
                most_ = l[away]
                ask = np.concatenate([np.where(has_up, most_, 0), np.where(has_down, most_, 0)])
                both = np.zeros(2 * len(away), np.int64)
                some = np.flatnonzero(ask)
                both[some] = self.common(np.concatenate([self.last[y], self.first[z]])[some], np.tile(ptr[away], 2)[some], ask[some])
                a = np.where(has_up, both[: len(away)], -1)
                b = np.where(has_down, both[len(away) :], -1)
                upper = a >= b
                run[away] = np.where(upper, y, z)
                row[away] = np.where(upper, self.start[np.minimum(y + 1, runs - 1)] - 1, self.start[z])
                row[away[upper & (y + 1 == runs)]] = self.n - 1
                ptr[away] = np.where(upper, self.last[y], self.first[z])
                l[away] = np.where(upper, a, b)
            new = l + 1
            lost = new == 0
            row = np.where(lost, 0, self.to[run] + row - self.start[run])
            ptr = np.where(lost, self.any, ptr - 1)
            l = np.where(lost, 0, np.minimum(new, most))
            length[at], place[at] = l, ptr
            if least and not steps % 4:
                hope = np.flatnonzero(at - begin + l >= least)
                at, begin, row, ptr, l = at[hope], begin[hope], row[hope], ptr[hope], l[hope]
            steps += 1
            at = at - 1
            live = int(np.searchsorted(begin - at, 0, side="right"))
        return length, place
