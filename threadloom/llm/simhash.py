"""SimHash near-dedup by covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import estimated_bytes, ids_and_texts, materialise, prepare, release, released
from .components import components

RADIUS = 3
SMALL = 24  # members of a bucket that are compared pair by pair
BUCKET_BYTES = 1 << 19


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks such that any `radius` bits miss at least one mask whole.

    Each bit gets a non-zero vector of radius + 1 bits; mask v has the bits whose vectors have an odd
    overlap with v. Vectors of `radius` bits can't span the space, so some v is orthogonal to them all.
    """
    size = 1 << (radius + 1)
    vector = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, size)]


def fingerprint(text: str, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; ASCII letters count as lower case."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = (stop - size)[: len(words) - width + 1].tolist()
    h = np.array([digest(joined[a:b], 42) for a, b in zip(start, stop[width - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (a long that holds its 64 bits) and the longs named in `more` of every row."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            own = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own), *b.columns[2:]], ["doc_id", "fingerprint", *more])
        release()

    schema = ", ".join(f"{c} long" for c in ("doc_id", "fingerprint", *more))
    return ids_and_texts(docs, more=more).mapInArrow(run, schema)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (root != root[root]).any():
            root = root[root]


def _hubs(x: np.ndarray, free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all members of a bucket within 3 bits, in time linear in its size.

    Members differ in the free bits only. Two within 3 bits meet at a point that one reaches by at
    most one flip and the other by at most two; all that reach such a point are tied to one of the
    first kind, so no pairs are listed.
    """
    one = np.array([0, *(1 << i for i in free)], np.uint64)
    point = (x[None, :] ^ one[:, None]).ravel()
    member = np.tile(np.arange(len(x)), len(one))
    order = np.argsort(point, kind="stable")
    point, member = point[order], member[order]
    new = np.concatenate([[True], point[1:] != point[:-1]])
    hub = member[np.flatnonzero(new)]
    root = _roots(len(x), member, hub[np.cumsum(new) - 1])
    points = point[new]
    for i, j in combinations(free, 2):
        at = x ^ np.uint64(1 << i | 1 << j)
        k = np.minimum(np.searchsorted(points, at), len(points) - 1)
        a = np.flatnonzero(points[k] == at)
        b = hub[k[a]]
        if (root[a] != root[b]).any():
            root = _roots(len(x), np.concatenate([np.arange(len(x)), a]), np.concatenate([root, b]))
    return np.arange(len(x)), root


def link_buckets(mask: np.ndarray, key: np.ndarray, x: np.ndarray, masks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that share a mask and its bits: as few as connect what is within 3 bits."""
    order = np.lexsort((x, key, mask))
    mask, key, x = mask[order], key[order], x[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(x)))
    left, right = [], []
    for h, n in zip(head[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        free = [i for i in range(64) if not masks[mask[h]] >> i & 1]
        a, b = _hubs(x[h : h + n], free)
        left.append(h + a)
        right.append(h + b)
    head, size = head[(size > 1) & (size <= SMALL)], size[(size > 1) & (size <= SMALL)]
    last = np.repeat(head + size, size)
    at = np.repeat(head - np.cumsum(size) + size, size) + np.arange(size.sum())
    for d in range(1, SMALL):
        ok = at + d < last
        if not ok.any():
            break
        a = at[ok]
        near = np.bitwise_count(x[a] ^ x[a + d]) <= RADIUS
        left.append(a[near])
        right.append(a[near] + d)
    if not left:
        return x[:0], x[:0]
    a, b = x[np.concatenate(left)], x[np.concatenate(right)]
    both = np.unique(np.concatenate([a, b]))
    root = both[_roots(len(both), np.searchsorted(both, a), np.searchsorted(both, b))]
    return both[both != root], root[both != root]


def link(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints -> links (a, b) whose components are those of all pairs within 3 bits.

    No fingerprints, or one, give no links; there are no null or repeated ones, as `near_duplicates` groups them.

    Each fingerprint enters one bucket for each of 15 masks. Buckets are dealt by their key, a copy
    group being one fingerprint already; a bucket holds distinct values that agree on over half of the
    bits, and its work is linear in them.
    """
    masks = covering_masks()
    buckets = max(128, 15 * estimated_bytes(nodes) // BUCKET_BYTES)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.explode(
        F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    )
    dealt = nodes.select("fingerprint", table.alias("t")).select(
        F.pmod(F.xxhash64("t.mask", "t.key"), F.lit(buckets)).alias("bucket"),
        F.col("t.mask").alias("mask"),
        F.col("t.key").alias("key"),
        "fingerprint",
    )

    def run(t: pa.Table) -> pa.Table:
        mask, key, x = (t.column(c).to_numpy() for c in ("mask", "key", "fingerprint"))
        a, b = link_buckets(mask.astype(np.int64), key, x.view(np.uint64), masks)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("bucket").applyInArrow(released(run), "a long, b long")


def _rooted(own: DataFrame, first: Column) -> DataFrame:
    """Each distinct fingerprint with its rows' aggregate `first` as `least` and the root of its component."""
    nodes = materialise(own.groupBy("fingerprint").agg(first.alias("least")))
    roots = components(link(nodes.select("fingerprint")))
    return nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Rows whose fingerprints differ in at most 3 bits are linked; component_id is the least doc_id
    reachable. No pair is missed. A text without words (null, empty, white space) has fingerprint zero
    and is linked like any other. Null ids are no component's least unless it has no other, and stay
    null. Repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored.
    """
    own = materialise(fingerprints(docs))
    rooted = _rooted(own, F.min("doc_id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fingerprint", "component_id")
    return own.join(classes, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns as they are: a row of its least id.

    Null ids rank last, so a component without any id keeps one row as well. Rows of one id are told
    apart by two 64-bit hashes of the whole row (maps aside), the lesser stays; rows alike are one.
    """
    whole = [x for c, t in docs.dtypes if "map<" not in t for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    row = tuple(f"{max(docs.columns, key=len)}_{i}" for i in (1, 2))  # no column has such a name
    keyed = docs.withColumns({c: F.xxhash64(F.lit(i), *whole) for i, c in enumerate(row)})
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *(F.col(f"`{c}`").alias(f"h{i}") for i, c in enumerate(row))))
    rooted = _rooted(materialise(fingerprints(keyed, row)), first)
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(*(F.col("least")[f"h{i}"].alias(c) for i, c in enumerate(row)))
    return keyed.join(kept, list(row), "left_semi").dropDuplicates(list(row)).drop(*row)
