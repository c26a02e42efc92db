"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
MIXED = [
    (1, "the cat sat on the mat and looked at the long road home again today"),
    (2, None), (3, ""), (4, " \t\n"), (5, "one"), (None, "nobody's text"),
    (6, "the cat sat on the mat and looked at the long road home again today"),
    (7, "é ñ 中文 😀 <|endoftext|> tail\x0bend"), (8, "long " * 3000), (9, "a\x1cb  c\u00a0d ² ½ \u0378 ϒ"),
    (10, "x" * 5000 + "é" * 300),
]


def frame(spark, rows=MIXED):
    """Documents with extra columns whose names the operators use themselves."""
    made = [(d, t, "en", "s", None if t is None else len(t), 0, "b", 1) for d, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, block int, fingerprint string, n_tokens int")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def spans_removed(docs: dict[int, str], k: int = 13) -> dict[int, tuple]:
    words = {d: WORD.findall(t.encode()) for d, t in docs.items()}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out[d] = (len(w), sum(gone), digest(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def bytes_removed(docs: dict[int, str], k: int = 100) -> dict[int, tuple]:
    seen: set[bytes] = set()
    out = {}
    for d in sorted(docs):
        b = docs[d].encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - k + 1):
            if b[i : i + k] in seen:
                gone[i : i + k] = True
            seen.add(b[i : i + k])
        begins = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[d] = (len(b), int(gone.sum()), begins, digest(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def simhash(text: str) -> int:
    w = WORD.findall(text.encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def simhash_classes(docs: dict[int, str]) -> dict[int, tuple[str, int]]:
    ids = sorted(docs)
    f = np.array([simhash(docs[d]) for d in ids], np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return {d: (f"{int(f[i]):016x}", ids[find(i)]) for i, d in enumerate(ids)}


def shingle_likeness(a: str, b: str) -> float:
    def shingles(t):
        w = WORD.findall(t.encode())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0
