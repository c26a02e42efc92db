"""Byte-level BPE by speculation: longest match proposes, pair checks verify, merging mends."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_texts, prepare
from .tokens import ByteLevel, broadcast_spec, byte_level

CACHE_WORDS = 300_000
FEW_WORDS = 16  # so few words are walked one by one, which gives the same as all in step
NEVER = np.int64(1) << 40  # later than any merge


class Speculator:
    """Encodes distinct pre-tokens of one byte-level vocabulary.

    An encoding is what merging gives exactly if each token encodes to itself and no merge crosses the
    border of any adjacent pair; so a longest-match proposal all of whose pairs pass is right as it is.
    """

    def __init__(self, vocabulary: ByteLevel):
        self.v = vocabulary
        self._trie()
        n = max([*vocabulary.ranks.values(), *vocabulary.special.values()]) + 1
        table = [b""] * n
        for t, i in vocabulary.ranks.items():
            table[i] = t
        for s, i in vocabulary.special.items():
            table[i] = s.encode()
        self.token = table
        self.length = np.array([len(t) for t in table], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.cache: dict[str, bytes] = {}
        self._merges()

    def _trie(self) -> None:
        nodes, accept, edges = 1, [-1], {}
        for t, i in self.v.ranks.items():
            at = 0
            for b in t:
                key = at << 8 | b
                if (to := edges.get(key)) is None:
                    to = edges[key] = nodes
                    nodes += 1
                    accept.append(-1)
                at = to
            accept[at] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.walk, self.ends = edges, accept
        self.edge = keys[order]
        self.to = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.accept = np.array(accept, np.int64)
        self.root = np.full(256, -1, np.int64)
        first = self.edge < 256
        self.root[self.edge[first]] = self.to[first]

    def _merges(self) -> None:
        """All pairs of tokens that can merge, and the two parts that each token is merged of last.

        A token's rank is its id, the time at which it is formed. The last split of a token is the one whose
        parts stay apart until then; parts are shorter, so the splits are judged by length.
        """
        ranks = self.v.ranks
        found = [
            (len(t), i, ranks[t[:c]], ranks[t[c:]])
            for t, i in ranks.items() for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks
        ]
        size, whole, left, right = np.array(found, np.int64).reshape(-1, 4).T
        key = left << 32 | right
        order = np.argsort(key)
        self.pair, self.merged = key[order], whole[order]
        n = len(self.token)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.formed = np.where(self.length > 1, np.arange(n), -1)
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            own = own[self.apart(left[own], right[own], whole[own])]
            self.left[whole[own]], self.right[whole[own]] = left[own], right[own]

    def whole(self, token: np.ndarray) -> np.ndarray:
        """Which tokens merging gives for their own bytes."""
        return (self.length[token] == 1) | (self.left[token] >= 0)

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | np.int64 = NEVER) -> np.ndarray:
        """For each pair of neighbours, whether no merge joins them across their border before the time `until`.

        All pairs are followed back in time at once: of the two tokens at the border the one formed later is
        taken apart (of two formed at one rank the right one, as merges go from left to right). A merge across
        the border happens if it ranks before those that hid either token.
        """
        x, y = a.copy(), b.copy()
        px, py = (np.broadcast_to(until, x.shape).copy() for _ in range(2))
        ok = self.whole(x) & self.whole(y)
        live = np.flatnonzero(ok)
        while len(live):
            u, v = x[live], y[live]
            key = u << 32 | v
            i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1) if len(self.pair) else np.zeros(len(key), np.int64)
            m = np.where(self.pair[i] == key, self.merged[i], NEVER) if len(self.pair) else np.full(len(key), NEVER)
            joined = (m < px[live]) & (m <= py[live])
            ok[live[joined]] = False
            more = ~joined & ((self.left[u] >= 0) | (self.left[v] >= 0))
            live, u, v = live[more], u[more], v[more]
            first = self.formed[u] > self.formed[v]
            l, r = live[first], live[~first]
            px[l], x[l] = self.formed[x[l]], self.right[x[l]]
            py[r], y[r] = self.formed[y[r]], self.left[y[r]]
        return ok

    def propose(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all words at once: word number and token, in order of the text."""
        word = np.flatnonzero(offs[1:] > offs[:-1])
        begin, end = offs[:-1][word], offs[1:][word]
        at, node = begin.copy(), np.zeros(len(word), np.int64)
        best, stop = np.full(len(word), -1, np.int64), begin.copy()
        out_word, out_at, out_token = [], [], []
        while len(word):
            if len(word) <= FEW_WORDS:
                rest = [self._follow(data[i:j].tobytes()) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
                out_word += [np.full(len(t), w) for w, (t, _) in zip(word.tolist(), rest, strict=True)]
                out_at += [a + i for i, (_, a) in zip(begin.tolist(), rest, strict=True)]
                out_token += [t for t, _ in rest]
                break
            byte = data[np.minimum(at, len(data) - 1)].astype(np.int64)
            key = node << 8 | byte
            i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            live = (self.edge[i] == key) & (at < end)
            node = np.where(live, self.to[i], 0)
            at = at + live
            token = self.accept[node]
            hit = live & (token >= 0)
            best, stop = np.where(hit, token, best), np.where(hit, at, stop)
            if not live.all():
                dead = ~live
                out_word.append(word[dead])
                out_at.append(begin[dead])
                out_token.append(best[dead])
                begin = np.where(dead, stop, begin)
                at, best = np.where(dead, stop, at), np.where(dead, -1, best)
                keep = begin < end
                if not keep.all():
                    word, begin, end, at, node, best, stop = (
                        x[keep] for x in (word, begin, end, at, node, best, stop)
                    )
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, a, t = map(np.concatenate, (out_word, out_at, out_token))
        order = np.argsort(a, kind="stable")
        return w[order], t[order]

    def _follow(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of one word, and where each starts."""
        walk, accept, token, place = self.walk, self.ends, [], []
        at, n = 0, len(word)
        while at < n:
            node, best, stop, i = 0, -1, at, at
            while i < n and (to := walk.get(node << 8 | word[i])) is not None:
                node, i = to, i + 1
                if accept[node] >= 0:
                    best, stop = accept[node], i
            token.append(best)
            place.append(at)
            at = stop
        return np.array(token, np.int64), np.array(place, np.int64)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens, as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if w not in self.v.special]
        out |= {w: np.array([self.v.special[w]], "<u4").tobytes() for w in words if w in self.v.special}
        if not plain:
            return out
        raw = [w.encode() for w in plain]
        offs = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
        word, token = self.propose(np.frombuffer(b"".join(raw), np.uint8), offs)
        same = word[1:] == word[:-1]
        failed = np.zeros(len(plain), bool)
        distinct, where = np.unique((token[:-1] << 32 | token[1:])[same], return_inverse=True)
        failed[word[1:][same][~self.apart(distinct >> 32, distinct & 0xFFFFFFFF)[where]]] = True
        failed[word[~self.whole(token)]] = True
        cut = np.searchsorted(word, np.arange(len(plain) + 1))
        ids = token.astype("<u4").tobytes()
        for k, (w, bad) in enumerate(zip(plain, failed.tolist(), strict=True)):
            out[w] = np.array(self.v.exact(raw[k]), "<u4").tobytes() if bad else ids[4 * cut[k] : 4 * cut[k + 1]]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        split = [self.v.pretokens(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.cache.update(self.encode_words(list(set(chain.from_iterable(split)) - self.cache.keys())))
        ids = self.cache
        return [b"".join([ids[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens kept; bytes that aren't UTF-8 become U+FFFD."""
        out = []
        every = np.frombuffer(ids, "<u4").astype(np.int64)
        for k in range(0, len(every), 1 << 18):
            i = every[k : k + (1 << 18)]
            n = self.length[i]
            stop = np.cumsum(n)
            at = np.repeat(self.start[i] - (stop - n), n) + np.arange(stop[-1])
            out.append(self.flat[at].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_MADE: dict[int, Speculator] = {}


def speculator(spec: str) -> Speculator:
    v = byte_level(spec)
    if id(v) not in _MADE:
        _MADE.clear()
        _MADE[id(v)] = Speculator(v)
    return _MADE[id(v)]


def encode_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every row.

    Null or empty text: no ids and an empty text. The other cases are those of digest_documents.
    """
    return _map(docs, vocabulary_path, "doc_id long, ids array<int>, decoded string", _full)


def digest_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, without a shuffle.

    Null or empty text: no ids, digests of nothing. A null doc_id stays null. Repeated rows give
    repeated rows, an empty table an empty one; other columns are ignored. Only byte-level BPE files
    without a normalizer or post-processor are taken.
    """
    return _map(
        docs, vocabulary_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest
    )


def _full(s: Speculator, column, ids: list[bytes]) -> list:
    return [
        column,
        pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())),
        pa.array([s.decode(x) for x in ids], pa.string()),
    ]


def _digest(s: Speculator, column, ids: list[bytes]) -> list:
    return [
        column,
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
        pa.array([hashlib.sha256(s.decode(x).encode()).hexdigest() for x in ids], pa.string()),
    ]


def _map(docs: DataFrame, vocabulary_path: str, schema: str, columns) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    spec = broadcast_spec(spark, vocabulary_path)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        s = speculator(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(columns(s, b.column(0), s.encode(b.column(1).to_pylist())), names)

    return ids_and_texts(docs).mapInArrow(run, schema)
