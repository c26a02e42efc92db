"""Exact search for windows of k symbols that repeat across a corpus, without a row per window.

A document is a path of symbols (words or bytes) in a De Bruijn graph: each window of k symbols is an
edge, each window of k - 1 a node. The least of an edge's s-symbol hashes (rightmost if tied) is its
anchor, which its content alone decides; consecutive edges of one anchor occurrence form a piece, a
path that travels as one entry. Documents are dealt into blocks and the chain is

 1. block -> bucket of anchors: each distinct anchor of a block once, with its path's hash;
 2. bucket: an anchor met in other blocks is repeated. If its paths are all one (nonbranching), the
    path is decided as a whole, with the place where it comes first; else (branching) its edges
    have to be told apart;
 3. blocks joined with those verdicts -> bucket of edges: the edges of branching anchors only;
 4. blocks joined with all verdicts: neighbouring paths and edges whose first places also follow each
    other are compacted to one long path; repeats in the block itself are found here too;
 5. each compacted path is joined with the block of its source, at the source's coordinates (block and
    position), and the symbols are compared there by SHA-256: hashes only propose;
 6. blocks joined with the answers: spans are marked. A proposal that isn't confirmed means that two
    texts had one 64-bit hash; the job then stops with an error instead of giving a wrong row.

Anchors with few paths can go to shards of their own instead, as the paths' symbols, where another
search (`shards`) tells their windows apart; those with more go the way of edges.

Hashes are salted anew in each run, so no text can be made to collide. A key occurs at most
once for each block, however many documents share it, so no bucket grows with a hot line, and the
entries of a bucket travel as packed arrays. A hot source gets 48 bytes for each block and path. The
documents are shuffled once; all uses of that exchange are one. Rows are dealt by a hash of id and
text, so neither rows without an id nor those of one id gather; a block's worker holds about 40 bytes
for each byte of its texts (2 to 4 MB, or one longer document).
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, ids_and_texts, pack, parts, prepare, released, unpack

U = np.uint64
CHUNK = 1 << 18
BLOCK_BYTES = 2 << 20
LAST = np.iinfo(np.int64).max
ENTRIES = "way long, bucket long, block long, a binary, b binary, doc binary, at binary, size binary, text binary"
VERDICTS = "block long, kind int, a binary, b binary, c binary"
CLAIMS = "block long, origin long, kind int, a binary, b binary, c binary, digest binary"
#: what a verdict says of a block's anchors (the first three), edges, runs of a path's windows and paths
EXPAND, SHARD, COVERED_ANCHOR, COVERED_EDGE, COVERED_RUN, COVERED_PATH = range(6)
KINDS = ("expand", "shard", "anchor", "edge", "run", "path")
OWN, CLAIM, ANSWER = range(3)  # rows of the last two joins
PLACE_BITS = 43  # a source's coordinates are its block and its position there
PLACE = (1 << PLACE_BITS) - 1
SHORT_WORD = 64  # bytes; longer words are hashed by the library
EDGES, SHARDS = -1, -2  # ways of entries; a verdict that passes through goes the way of its block
MANY = 1 << 20



def byte_values(seed: int) -> np.ndarray:
    """Odd symbols for the 256 bytes."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)


BYTE = byte_values(20240229)
BASE = U(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(n, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


class Rolling:
    """Hashes of any span of a run of symbols."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.h = np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=self.h[1:])

    def all(self, k: int) -> np.ndarray:
        return mixed((self.h[k:] - self.h[:-k]) * self.down[: len(self.h) - k])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.h[stop] - self.h[start]) * self.down[start])


class Text:
    """The documents of a block as symbols, in order of doc_id; rows of one id by the rank (hash) of their text."""

    def __init__(self, table: pa.Table, words: bool, k: int, seed: int = 0):
        table = table.sort_by([("doc_id", "ascending"), ("rank", "ascending")])
        self.table = table
        self.block = table.column("block")[0].as_py() if table.num_rows else 0
        self.ids = table.column("doc_id").combine_chunks()
        self.key = table.column("doc_id").fill_null(LAST).to_numpy().astype(np.int64)
        self.data, self.bytes_at = column_bytes(table.column("text"))
        self.words, self.k, self.seed = words, k, seed
        if words:
            self.start, self.stop = split_words(self.data, self.bytes_at)
            self.symbols = word_hashes(self.data, self.start, self.stop, seed)
            self.at = np.searchsorted(self.start, self.bytes_at)
        else:
            self.symbols, self.at = self.data, self.bytes_at
            self.byte = byte_values(seed)
        self.n = len(self.symbols)
        self._plain = None

    def values(self, a: int, b: int) -> np.ndarray:
        return self.symbols[a:b] if self.words else self.byte[self.symbols[a:b]]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position, side="right") - 1

    def plain(self) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """The symbols themselves, words separated by one space, and where each starts and stops."""
        if self._plain is None:
            if self.words:
                data = np.insert(self.data, self.bytes_at[1:], 32)
                solid = _solid(data)
                keep = solid.copy()
                keep[1:] |= solid[:-1]  # the first space after each word
                data, solid = data[keep], solid[keep]
                data[~solid] = 32
                stop = np.flatnonzero(~solid)
                start = np.concatenate([[0], stop[:-1] + 1])[: len(stop)]
            else:
                data, start = np.ascontiguousarray(self.data), np.arange(self.n)
                stop = start + 1
            self._plain = memoryview(data), start, stop
        return self._plain

    def digests(self, first: np.ndarray, count: np.ndarray) -> list[bytes]:
        """SHA-256 of each run of `count` symbols."""
        data, start, stop = self.plain()
        a, b = start[first].tolist(), stop[first + count - 1].tolist()
        return [hashlib.sha256(data[i:j]).digest() for i, j in zip(a, b, strict=True)]


def _solid(data: np.ndarray) -> np.ndarray:
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def split_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of bytes other than space and U+0009 to U+000D in one document."""
    solid = _solid(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    stop = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, stop


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time through a mixing step, long words by the library's XXH3."""
    size = stop - start
    h = mixed(size.astype(U) * BASE + U(seed))
    if not len(size):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    own = np.flatnonzero(size <= SHORT_WORD)
    for at in range(0, SHORT_WORD, 8):
        own = own[size[own] > at]
        if not len(own):
            break
        left = np.minimum(size[own] - at, 8).astype(U)
        lane = lanes[start[own] + at] << (U(64) - left * U(8))
        h[own] = mixed((h[own] ^ mixed(lane + U(at + 1))) * BASE)
    for i in np.flatnonzero(size > SHORT_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]].tobytes(), seed)
    return h


class Pieces:
    """All pieces of a block: anchor, path hash, first window and number of windows."""

    def __init__(self, text: Text, s: int):
        k = text.k
        w = k - s + 1
        found: list[tuple[np.ndarray, ...]] = []
        for c in range(0, max(0, text.n - k + 1), CHUNK):
            values = text.values(c, min(text.n, c + CHUNK + k - 1))
            n = len(values) - k + 1
            r = Rolling(values)
            small = r.all(s)
            place = (1 << 22) - 1
            least = (small >> U(22) << U(22)) | (U(place) - np.arange(len(small), dtype=U))
            width = 1
            while width < w:  # sliding minimum by doubling
                step = min(width, w - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            least = least[:n]
            at = (U(place) - (least & U(place))).astype(np.int64)
            doc_end = np.zeros(n + 1, bool)  # a window can't cross the end of a document
            cut = text.at[(text.at > c) & (text.at < c + n + k)] - c
            valid = np.ones(n, bool)
            for e in cut.tolist():
                valid[max(0, e - k + 1) : min(n, e)] = False
            doc_end[cut[cut <= n]] = True
            new = np.ones(n, bool)
            new[1:] = (at[1:] != at[:-1]) | ~valid[:-1] | doc_end[1:n]
            a = np.flatnonzero(new & valid)
            end = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
            path = (r.spans(a, end + k) ^ mixed((end - a + 1).astype(U))) | U(1 << 63)
            found.append((small[at[a]], path, a + c, end - a + 1))
        cols = zip(*found, strict=True) if found else ([np.zeros(0, t)] for t in (U, U, np.int64, np.int64))
        self.anchor, self.path, self.first, self.count = map(np.concatenate, cols)
        self.doc = text.doc_of(self.first)
        self.text = text
        self.order = np.argsort(self.anchor, kind="stable")
        by = self.anchor[self.order]
        self.heads = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, np.int64)
        self.anchors = by[self.heads]
        if len(by):
            p = self.path[self.order]
            self.one_path = np.minimum.reduceat(p, self.heads) == np.maximum.reduceat(p, self.heads)
        else:
            self.one_path = np.zeros(0, bool)
        self.group = np.empty(len(by), np.int64)  # of each piece
        self.group[self.order] = np.repeat(np.arange(len(self.heads)), np.diff(np.append(self.heads, len(by))))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen pieces, in order of position: start, edge hash and anchor of each window."""
        start, edge, text, k = _ranges(self.first[chosen], self.count[chosen]), None, self.text, self.text.k
        edge = np.empty(len(start), U)
        lo = 0
        while lo < len(start):
            c = int(start[lo])
            hi = int(np.searchsorted(start, c + CHUNK))
            r = Rolling(text.values(c, min(text.n, c + CHUNK + k - 1)))
            edge[lo:hi] = r.spans(start[lo:hi] - c, start[lo:hi] - c + k)
            lo = hi
        return start, edge, np.repeat(self.anchor[chosen], self.count[chosen])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., `count` numbers for each."""
    total = np.cumsum(count)
    return np.repeat(first - (total - count), count) + np.arange(total[-1] if len(count) else 0)


def _alike(edge: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """An order that brings windows of equal edge and anchor together."""
    order = np.argsort(edge)
    e, a = edge[order], anchor[order]
    if ((e[1:] == e[:-1]) & (a[1:] != a[:-1])).any():  # two windows of one edge hash
        return np.lexsort((anchor, edge))
    return order


def _within(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _bucketed(
    way: int, a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray, block: int, buckets: int, texts: list[bytes] | None = None
) -> dict:
    """Entries, and their texts if any, as one packed row for each bucket of a.

    Anchors are least hashes and so crowd near zero; they are mixed again to fill the buckets evenly.
    """
    of = ((mixed(a) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    of, a, b, doc, at = of[order], a[order], b[order], doc[order], at[order]
    if texts is not None:
        texts = [texts[i] for i in order.tolist()]
    keys, lo = np.unique(of, return_index=True)
    hi = np.append(lo[1:], len(of)) if len(of) else lo
    rows = list(zip(lo.tolist(), hi.tolist(), strict=True))
    sizes = np.array([len(t) for t in texts], np.int64) if texts is not None else None
    return {
        "way": [way] * len(keys),
        "bucket": keys.tolist(),
        "block": [block] * len(keys),
        **{n: [pack(x[i:j]) for i, j in rows] for n, x in (("a", a), ("b", b), ("doc", doc), ("at", at))},
        "size": [pack(sizes[i:j]) if texts is not None else b"" for i, j in rows],
        "text": [b"".join(texts[i:j]) if texts is not None else b"" for i, j in rows],
    }


def _join(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Packed rows as one array, and the row that each entry came from."""
    parts_ = [unpack(x, dtype) for x in column.to_pylist()]
    rows = np.repeat(np.arange(len(parts_)), [len(x) for x in parts_])
    return (np.concatenate(parts_) if parts_ else np.zeros(0, dtype)), rows


def _table(rows: dict, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array(rows.get(n, []), kinds[t]) for n, t in fields})


def _joined(*rows: dict) -> dict:
    return {k: [x for r in rows for x in r[k]] for k in rows[0]}


class Entries:
    """A bucket's entries: block, two keys, and the first document and place of each in its block."""

    def __init__(self, table: pa.Table):
        self.a, row = _join(table.column("a"), U)
        self.b, _ = _join(table.column("b"), U)
        self.doc, _ = _join(table.column("doc"), np.int64)
        at, _ = _join(table.column("at"), np.int64)
        self.block = table.column("block").to_numpy()[row]
        self.place = self.block << PLACE_BITS | at

    def take(self, order: np.ndarray) -> None:
        for name in ("a", "b", "doc", "block", "place"):
            setattr(self, name, getattr(self, name)[order])

    def rank(self) -> tuple[np.ndarray, np.ndarray]:
        """Sort keys of the corpus' order, least significant first: blocks hold rows of one id in order of rank."""
        return self.place, self.doc

    def later(self, head: np.ndarray, same_document: bool) -> np.ndarray:
        """Which entries come after the entries `head`, in another document unless same_document."""
        return self.place != self.place[head] if same_document else self.doc[head] < self.doc


def verdict_rows(block: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> dict:
    """One packed row for each block."""
    order = np.lexsort((a, block))
    block, cols = block[order], [a[order], b[order], *([] if c is None else [c[order]])]
    keys, lo = np.unique(block, return_index=True)
    cut = [*lo.tolist(), len(block)]
    packed = [[pack(x[i:j]) for i, j in zip(cut, cut[1:], strict=False)] for x in cols]
    return {"block": keys.tolist(), "kind": [kind] * len(keys), "a": packed[0], "b": packed[1], "c": packed[2] if len(cols) == 3 else [b""] * len(keys)}


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    return new


def decide_paths(table: pa.Table, same_document: bool, few: int = 0) -> pa.Table:
    """One bucket of anchors: which blocks' paths are covered, which anchors branch, into how many paths."""
    e = Entries(table)
    e.take(np.lexsort((*e.rank(), e.a)))
    if not len(e.a):
        return _table({}, VERDICTS)
    head = np.flatnonzero(_heads(e.a))
    size = np.diff(np.append(head, len(e.a)))
    head, size = head[size > 1], size[size > 1]
    if not len(head):
        return _table({}, VERDICTS)
    e.take(_ranges(head, size))
    head = np.cumsum(size) - size
    low, high = np.minimum.reduceat(e.b, head), np.maximum.reduceat(e.b, head)
    several = e.b < U(MANY)  # the block itself has so many paths
    paths = np.add.reduceat(np.where(several, e.b, U(1)).astype(np.int64), head)
    branching = np.repeat((low != high) | (low < U(MANY)), size)
    shard = branching & np.repeat(paths <= few, size)
    source = np.repeat(head, size)
    covered = ~branching & e.later(source, same_document)
    chosen = ((EXPAND, branching & ~shard), (SHARD, shard), (COVERED_ANCHOR, covered))
    return _table(_joined(*(verdict_rows(e.block[x], k, e.a[x], e.place[source[x]]) for k, x in chosen)), VERDICTS)


def passed_through(table: pa.Table) -> pa.Table:
    """Verdicts on a block's paths, which travel among the entries."""
    names = (("block", "block"), ("kind", "bucket"), ("a", "a"), ("b", "b"))
    cols = {n: table.column(c).to_pylist() for n, c in names}
    return _table(cols | {"c": [b""] * table.num_rows}, VERDICTS)


def decide_edges(table: pa.Table, same_document: bool) -> pa.Table:
    """One bucket of edges: which blocks' edges are covered."""
    e = Entries(table)
    e.take(np.lexsort((*e.rank(), e.b, e.a)))
    if not len(e.a):
        return _table({}, VERDICTS)
    new = _heads(e.a, e.b)
    source = np.flatnonzero(new)[np.cumsum(new) - 1]
    covered = e.later(source, same_document)
    return _table(verdict_rows(e.block[covered], COVERED_EDGE, e.a[covered], e.place[source[covered]]), VERDICTS)


class Verdicts:
    """All verdicts on one block."""

    def __init__(self, table: pa.Table):
        kind = table.column("kind").to_numpy()
        for k, name in enumerate(KINDS):
            own = table.filter(pa.array(kind == k))
            a, _ = _join(own.column("a"), U)
            b, _ = _join(own.column("b"), np.int64)
            c, _ = _join(own.column("c"), np.int64)
            order = np.argsort(a, kind="stable")
            setattr(self, name, (a[order], b[order], c[order] if len(c) else c))

    def source(self, name: str, x: np.ndarray) -> np.ndarray:
        """Where it comes first."""
        a, b, _ = getattr(self, name)
        return b[np.searchsorted(a, x)]


class Proposed:
    """Compacted paths of a block that come earlier elsewhere: first window, number of windows, source's coordinates."""

    def __init__(self, pieces: Pieces, verdicts: Verdicts, same_document: bool, split=None):
        p, text = pieces, pieces.text
        here = np.int64(text.block) << PLACE_BITS
        leader = p.order[p.heads] if len(p.heads) else p.order
        first_of = leader[p.group]
        one = p.one_path[p.group]
        source = np.full(len(p.anchor), -1)
        for name, x in (("path", p.path), ("anchor", p.anchor)):
            own = _within(x, getattr(verdicts, name)[0])
            source[own] = verdicts.source(name, x[own])
        local = one & (first_of != np.arange(len(one))) & (source < 0)
        if not same_document:
            local &= text.key[p.doc[first_of]] < text.key[p.doc]
        source[local] = here | p.first[first_of[local]]
        gone = source >= 0
        found = [(p.first[gone], p.count[gone], source[gone])]

        spread = _within(p.anchor, verdicts.expand[0])
        shared = _within(p.anchor, verdicts.shard[0])
        if split is None:
            apart = np.flatnonzero(~gone & (~one | spread | shared))
        else:
            apart = np.flatnonzero(~gone & spread)
            found += self._runs(p, np.flatnonzero(~gone & shared), verdicts)
            found += self._split(p, np.flatnonzero(~gone & ~one & ~spread & ~shared), split, here)
            found += self._copies(p, np.flatnonzero(~gone & shared), here)
        found.append(self._edges(p, apart, verdicts, same_document, here))
        first, count, source = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(first, kind="stable")
        self.first, self.count, self.source = _compacted(first[order], count[order], source[order], text)

    @staticmethod
    def _edges(p: Pieces, chosen: np.ndarray, verdicts: Verdicts, same_document: bool, here) -> tuple:
        """Single windows by their edges' hashes."""
        text = p.text
        start, edge, anchor = p.windows(chosen)
        order = _alike(edge, anchor)
        e, s = edge[order], start[order]
        new = _heads(e, anchor[order])
        lead = np.minimum.reduceat(s, np.flatnonzero(new))[np.cumsum(new) - 1] if len(e) else s
        drop = (s != lead) if same_document else (text.key[text.doc_of(lead)] < text.key[text.doc_of(s)])
        source = here | lead
        across = _within(e, verdicts.edge[0])
        source[across] = verdicts.source("edge", e[across])
        drop |= across
        return s[drop], np.ones(int(drop.sum()), np.int64), source[drop]

    @staticmethod
    def _runs(p: Pieces, chosen: np.ndarray, verdicts: Verdicts) -> list[tuple]:
        """Runs of windows that a shard found covered; all pieces of one path have them."""
        path, place, span = verdicts.run
        lo, hi = np.searchsorted(path, p.path[chosen]), np.searchsorted(path, p.path[chosen], side="right")
        at, own = _ranges(lo, hi - lo), np.repeat(chosen, hi - lo)
        return [(p.first[own] + (span[at] >> 32), span[at] & 0xFFFFFFFF, place[at])]

    @staticmethod
    def _copies(p: Pieces, chosen: np.ndarray, here) -> list[tuple]:
        """Pieces of one path after the block's first, as a whole."""
        order = chosen[np.lexsort((p.first[chosen], p.path[chosen], p.anchor[chosen]))]
        new = _heads(p.anchor[order], p.path[order])
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        own = order[~new]
        return [(p.first[own], p.count[own], here | p.first[head[~new]])]

    def _split(self, p: Pieces, chosen: np.ndarray, split, here) -> list[tuple]:
        """Anchors that branch in this block only, by the same search as in shards."""
        order = chosen[np.lexsort((p.first[chosen], p.path[chosen], p.anchor[chosen]))]
        new = _heads(p.anchor[order], p.path[order])
        head = order[new]
        head = head[np.lexsort((p.first[head], p.anchor[head]))]
        found = self._copies(p, chosen, here)
        if len(head):
            size = p.count[head] + p.text.k - 1
            path, offset, count, by, there = split(p.text.data, p.first[head], size, p.anchor[head])
            found.append((p.first[head[path]] + offset, count, here | (p.first[head[by]] + there)))
        return found


def _compacted(first: np.ndarray, count: np.ndarray, source: np.ndarray, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring runs of windows whose sources also follow each other, as one; a window told twice keeps its first telling."""
    if not len(first):
        return first, count, source
    end = np.maximum.accumulate(first + count)
    over = np.concatenate([[0], np.maximum(end[:-1] - first[1:], 0)])
    keep = over < count
    first, count, source = (first + over)[keep], (count - over)[keep], (source + over)[keep]
    doc = text.doc_of(first)
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1] + count[:-1]) | (source[1:] != source[:-1] + count[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    return first[head], np.add.reduceat(count, head), source[head]


def propose(text: Text, found: Proposed) -> dict:
    """A block's own rows, and its claims on other blocks: each distinct path once.

    Paths whose source is in the block are compared here. Own rows tell each path's first window, number of
    windows and claim (or -1 - place of the source, if that has been compared).
    """
    n = found.count + text.k - 1
    block, place = found.source >> PLACE_BITS, found.source & PLACE
    digest = np.array(text.digests(found.first, n), "S32") if len(n) else np.zeros(0, "S32")
    claim = -1 - place
    local = np.flatnonzero(block == text.block)
    _confirm(all(a.ljust(32, b"\0") == b for a, b in zip(digest[local].tolist(), text.digests(place[local], n[local]), strict=True)))
    away = np.flatnonzero(block != text.block)
    order = away[np.lexsort((digest[away], n[away], found.source[away]))]
    new = _heads(found.source[order], n[order], digest[order])
    claim[order] = np.cumsum(new) - 1
    head = order[new]
    target, lo = np.unique(block[head], return_index=True)
    cut = [*lo.tolist(), len(head)]
    rows = list(zip(cut, cut[1:], strict=False))
    own = [pack(x) for x in (found.first, found.count, claim)]
    raw = [x.ljust(32, b"\0") for x in digest[head].tolist()]
    ids = np.arange(len(head))
    return {
        "block": [text.block, *target.tolist()],
        "origin": [text.block] * (len(rows) + 1),
        "kind": [OWN, *[CLAIM] * len(rows)],
        **{c: [x, *(pack(y[i:j]) for i, j in rows)] for c, x, y in zip("abc", own, (place[head], n[head], ids), strict=True)},
        "digest": [b"", *(b"".join(raw[i:j]) for i, j in rows)],
    }


def answer(table: pa.Table, claims: pa.Table, read) -> pa.Table:
    """One block's answers: which claimed paths are, symbol for symbol, at their source's coordinates, and of which document."""
    kind = claims.column("kind").to_numpy()
    own, asked = claims.filter(pa.array(kind == OWN)), claims.filter(pa.array(kind == CLAIM))
    out = {n: own.column(n).to_pylist() for n in ("block", "origin", "kind", "a", "b", "c", "digest")}
    if asked.num_rows:
        text = read(table)
        place, row = _join(asked.column("a"), np.int64)
        n, _ = _join(asked.column("b"), np.int64)
        claim, _ = _join(asked.column("c"), np.int64)
        told = b"".join(asked.column("digest").to_pylist())
        each, which = np.unique(np.stack([place, n], 1), axis=0, return_inverse=True)
        true = text.digests(each[:, 0], each[:, 1])
        same = np.array([true[w] == told[32 * i : 32 * i + 32] for i, w in enumerate(which.ravel().tolist())])
        origin, doc = asked.column("origin").to_numpy()[row], text.key[text.doc_of(place)]
        got = verdict_rows(origin[same], ANSWER, claim[same], doc[same])
        out = _joined(out, got | {"origin": [0] * len(got["block"]), "digest": [b""] * len(got["block"])})
    return _table(out, CLAIMS)


GRAPH = "block long, place binary, count binary, times binary, before binary, after binary, digest binary"
PATHS = "doc_id long, start long, n_symbols long, occurrences long, in_degree long, out_degree long"


def _beside(text: Text, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols before and after runs of symbols of one document, 0 at its ends (no symbol's hash is)."""
    values = np.append(text.values(0, text.n), U(0)) | U(1)
    doc = text.doc_of(first)
    before = np.where(first > text.at[doc], values[first - 1], U(0))
    return before, np.where(stop < text.at[doc + 1], values[stop], U(0))


def graph_claims(text: Text, found: Proposed) -> dict:
    """Every occurrence of a path elsewhere, to the block of its source: occurrences alike are one with their number."""
    n = found.count + text.k - 1
    before, after = _beside(text, found.first, found.first + n)
    raw = text.digests(found.first, n)
    digest = np.array(raw, "S32") if raw else np.zeros(0, "S32")
    order = np.lexsort((digest, after, before, n, found.source))
    new = _heads(found.source[order], n[order], before[order], after[order], digest[order])
    head = order[new]
    times = np.diff(np.append(np.flatnonzero(new), len(order)))
    block, lo = np.unique(found.source[head] >> PLACE_BITS, return_index=True)
    cut = [*lo.tolist(), len(head)]
    rows = list(zip(cut, cut[1:], strict=False))
    cols = {"place": found.source[head] & PLACE, "count": found.count[head], "times": times, "before": before[head], "after": after[head]}
    own = [raw[i] for i in head.tolist()]
    return {"block": block.tolist(), **{c: [pack(x[i:j]) for i, j in rows] for c, x in cols.items()}, "digest": [b"".join(own[i:j]) for i, j in rows]}


def graph_paths(text: Text, claims: pa.Table) -> pa.Table:
    """The paths of the graph whose first places are in this block, compacted as far as no node branches.

    Each claim is an occurrence of a run of edges that start here. Between two places where an occurrence
    begins or ends, every occurrence of an edge goes on to the next one, so the edges are one path; the
    degrees of its end nodes are the numbers of distinct symbols before and after them.
    """
    place, count, times = (_join(claims.column(c), np.int64)[0] for c in ("place", "count", "times"))
    before, after = (_join(claims.column(c), U)[0] for c in ("before", "after"))
    told, k = b"".join(claims.column("digest").to_pylist()), text.k
    _confirm(b"".join(text.digests(place, count + k - 1)) == told)
    stop = place + count
    cut, where = np.unique(np.concatenate([place, stop]), return_inverse=True)
    step = np.zeros(len(cut), np.int64)
    np.add.at(step, where, np.concatenate([times, -times]))
    cover = np.cumsum(step)
    some = np.flatnonzero(cover > 0)
    first, last = cut[some], cut[some + 1]

    def degrees(at: np.ndarray, node: np.ndarray, beside: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Distinct symbols beside each node, the source's own included."""
        x, y = np.concatenate([node, at]), np.concatenate([beside, own])
        x, y = x[y > 0], y[y > 0]
        order = np.lexsort((y, x))
        found = x[order][_heads(x[order], y[order])]
        return np.searchsorted(found, at, side="right") - np.searchsorted(found, at)

    own = _beside(text, first, last + k - 1)
    doc = text.doc_of(first)
    ids = text.ids.take(pa.array(doc))
    cols = (first - text.at[doc], last - first + k - 1, cover[some] + 1, degrees(first, place, before, own[0]), degrees(last, stop, after, own[1]))
    return pa.table([ids, *(pa.array(c, pa.int64()) for c in cols)], names=[x.split()[0] for x in PATHS.split(", ")])


def find_paths(docs: DataFrame, words: bool, k: int, s: int) -> DataFrame:
    """PATHS: the compacted De Bruijn graph of the windows that come again in a document of greater id.

    A path is told where it comes first; a window that a document repeats itself counts there once.
    """
    by_block, read, verdicts = _verdicts(docs, words, k, s, False)

    def claims(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table({}, GRAPH)
        text = read(table)
        return _table(graph_claims(text, Proposed(Pieces(text, s), Verdicts(found), False)), GRAPH)

    def paths(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.schema([(x.split()[0], pa.int64()) for x in PATHS.split(", ")]).empty_table()
        return graph_paths(read(table), asked)

    claimed = by_block.cogroup(verdicts.groupBy("block")).applyInArrow(claims, GRAPH)
    return by_block.cogroup(claimed.groupBy("block")).applyInArrow(paths, PATHS)


def _confirm(same: bool) -> None:
    if not same:
        raise RuntimeError("two different texts have one 64-bit hash; run again (hashes are salted anew)")


class Marked:
    """What is removed from a block: the mask of its symbols, and each path's first window and source document."""

    def __init__(self, text: Text, rows: pa.Table):
        kind = rows.column("kind").to_numpy()
        cols = [_join(rows.filter(pa.array(kind == OWN)).column(c), np.int64)[0] for c in "abc"]
        first, count, claim = cols
        told = rows.filter(pa.array(kind == ANSWER))
        claims, doc = (_join(told.column(c), np.int64)[0] for c in "ab")
        order = np.argsort(claims)
        claims, doc = claims[order], doc[order]
        away = claim >= 0
        _confirm(bool(_within(claim[away], claims).all()))
        self.first, self.source = first, np.empty(len(first), np.int64)
        self.source[away] = doc[np.searchsorted(claims, claim[away])]
        self.source[~away] = text.key[text.doc_of(-1 - claim[~away])]
        diff = np.bincount(first, minlength=text.n + 1)[: text.n + 1]
        diff = diff - np.bincount(first + count + text.k - 1, minlength=text.n + 1)[: text.n + 1]
        self.mask = np.cumsum(diff)[: text.n] > 0


def find_repeats(
    docs: DataFrame, words: bool, k: int, s: int, same_document: bool, emit, schema: str, few: int = 0, shards=None, split=None,
    carried: Column | None = None,
) -> DataFrame:
    """emit(text, marked) -> Arrow table of `schema`, for every block of documents.

    Windows have k symbols (words or bytes), anchors s. same_document: whether an earlier start in the
    same document counts. shards(table) -> verdicts, for anchors of at most `few` paths; split(data, first,
    size, group) -> covered runs of paths, the same search for anchors that branch in one block only.
    `carried` comes along as text.table's column "carried".
    """
    by_block, read, verdicts = _verdicts(docs, words, k, s, same_document, few, shards, carried)

    def claims(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table({}, CLAIMS)
        text = read(table)
        return _table(propose(text, Proposed(Pieces(text, s), Verdicts(found), same_document, split)), CLAIMS)

    def mark(table: pa.Table, rows: pa.Table) -> pa.Table:
        text = read(table)
        return emit(text, Marked(text, rows))

    claimed = by_block.cogroup(verdicts.groupBy("block")).applyInArrow(released(claims), CLAIMS)
    answers = by_block.cogroup(claimed.groupBy("block")).applyInArrow(released(lambda t, c: answer(t, c, read)), CLAIMS)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(released(mark), schema)


def _verdicts(docs: DataFrame, words: bool, k: int, s: int, same_document: bool, few: int = 0, shards=None, carried: Column | None = None):
    """The documents by block, how to read a block, and the verdicts on all blocks."""
    prepare(docs.sparkSession)
    seed = secrets.randbits(62)
    bits = max(7, min(20, (parts(docs, BLOCK_BYTES, 1) - 1).bit_length()))
    buckets = parts(docs, BLOCK_BYTES, 64)
    own = docs if carried is None else docs.withColumn("_carried", carried)
    dealt = ids_and_texts(own, more=() if carried is None else (own["_carried"].alias("carried"),)).withColumn("rank", F.xxhash64("doc_id", "text"))
    # the leading bits, so that blocks follow each other in order of rank
    dealt = dealt.withColumn("block", F.shiftrightunsigned("rank", 64 - bits)).withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))))
    by_block = dealt.groupBy("block")

    def read(table: pa.Table) -> Text:
        return Text(table, words, k, seed)

    def paths(table: pa.Table) -> pa.Table:
        p = Pieces(read(table), s)
        lead = p.order[p.heads] if len(p.heads) else p.order
        several = np.minimum(np.bincount(p.group, minlength=len(p.heads)), MANY - 1).astype(U)
        path = np.where(p.one_path, p.path[lead], several)
        return _table(_bucketed(EDGES, p.anchors, path, p.text.key[p.doc[lead]], p.first[lead], p.text.block, buckets), ENTRIES)

    def entries(table: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows or not table.num_rows:
            return _table({}, ENTRIES)
        block = table.column("block")[0].as_py()
        v, n = Verdicts(found), found.num_rows
        a, b = found.column("a").to_pylist(), found.column("b").to_pylist()
        out = [
            {"way": [block] * n, "bucket": found.column("kind").to_pylist(), "block": [block] * n, "a": a, "b": b}
            | {c: [b""] * n for c in ("doc", "at", "size", "text")}
        ]
        if len(v.expand[0]) or len(v.shard[0]):
            p = Pieces(read(table), s)
            out += [_edge_entries(p, v.expand[0], buckets), _shard_entries(p, v.shard[0], buckets)]
        return _table(_joined(*out), ENTRIES)

    def decide(table: pa.Table) -> pa.Table:
        way = table.column("way")[0].as_py()
        return decide_edges(table, same_document) if way == EDGES else shards(table) if way == SHARDS else passed_through(table)

    on_paths = by_block.applyInArrow(released(paths), ENTRIES).groupBy("bucket").applyInArrow(lambda t: decide_paths(t, same_document, few), VERDICTS)
    dealt_entries = by_block.cogroup(on_paths.groupBy("block")).applyInArrow(released(entries), ENTRIES)
    return by_block, read, dealt_entries.groupBy("way", "bucket").applyInArrow(released(decide), VERDICTS)


def _edge_entries(p: Pieces, anchors: np.ndarray, buckets: int) -> dict:
    """Each distinct edge of the anchors, with the first document and place."""
    start, edge, anchor = p.windows(np.flatnonzero(_within(p.anchor, anchors)))
    order = np.lexsort((start, anchor, edge))
    start, edge, anchor = start[order], edge[order], anchor[order]
    new = _heads(edge, anchor)
    start, edge, anchor = start[new], edge[new], anchor[new]
    return _bucketed(EDGES, edge, anchor, p.text.key[p.text.doc_of(start)], start, p.text.block, buckets)


def _shard_entries(p: Pieces, anchors: np.ndarray, buckets: int) -> dict:
    """Each distinct path of the anchors, with the first document, place and bytes."""
    own = np.flatnonzero(_within(p.anchor, anchors))
    own = own[np.lexsort((own, p.path[own], p.anchor[own]))]
    own = own[_heads(p.anchor[own], p.path[own])]
    data = p.text.data
    stop = p.first[own] + p.count[own] + p.text.k - 1
    texts = [data[a:b].tobytes() for a, b in zip(p.first[own].tolist(), stop.tolist(), strict=True)]
    return _bucketed(SHARDS, p.anchor[own], p.path[own], p.text.key[p.doc[own]], p.first[own], p.text.block, buckets, texts)
