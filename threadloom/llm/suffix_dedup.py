"""Suffix-array dedup over bytes by a run-length index and matching statistics.

Repetitive passages meet by anchors (see anchors.py). Where the paths of an anchor differ, a run-compressed
Burrows-Wheeler index of earlier paths is built and later paths are streamed against it: windows whose
matching statistic reaches k bytes are repeats, and the match's place is their source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .anchors import COVERED_PATH, COVERED_RUN, VERDICTS, Entries, Marked, Text, _heads, _join, _joined, _ranges, _table, find_repeats, verdict_rows
from .run_index import RunIndex
from .substring_dedup import _runs

ANCHOR_BYTES = 20
FEW_PATHS = 512  # anchors with more go by window hashes, which no group of copies makes one task's


def split_paths(k: int):
    """Which windows of k bytes of some paths are in an earlier path of the same group, and where."""

    def split(data: np.ndarray, first: np.ndarray, size: np.ndarray, group: np.ndarray):
        """Paths are given in order within their groups, as places in `data`; equal windows have one group.

        Returns runs of windows: path, offset, number, and the source's path and offset. Groups are halved:
        the first halves of all groups are indexed at once and the second halves streamed against them, then
        each half is halved again, with the windows not yet found alone. So an indexed window that a query
        meets is always in an earlier path of its group: in a later one it would have been found before.
        """
        n = len(first)
        start = np.flatnonzero(_heads(group))
        members = np.diff(np.append(start, n))
        rank, members = np.arange(n) - np.repeat(start, members), np.repeat(members, members)
        path, offset, count = np.arange(n), np.zeros(n, np.int64), size - k + 1  # runs of windows left
        found: list[tuple] = [tuple(np.zeros(0, np.int64) for _ in range(5))]
        for level in reversed(range(int(members.max(initial=1) - 1).bit_length())):
            bit = 1 << level
            second = (rank[path] & bit) != 0
            indexed = ~second & ((rank[path] | bit) >> level << level < members[path])
            if not second.any() or not indexed.any():
                continue
            by, there, length = path[indexed], offset[indexed], count[indexed] + k - 1
            index = RunIndex(data[_ranges(first[by] + there, length)], length)
            asked, begin, number = path[second], offset[second], count[second]
            at = np.concatenate([[0], np.cumsum(number + k - 1)])
            match, place = index.matching_statistics(data[_ranges(first[asked] + begin, number + k - 1)], at, k, k)
            window = _ranges(at[:-1], number)
            hit = match[window] >= k
            text, inner = index.whereabouts(np.where(hit, place[window], 0))
            of, o = np.repeat(asked, number), _ranges(begin, number)
            source, so = by[text], there[text] + inner
            # runs of windows found, whose sources follow each other too, and runs of the others
            cut = np.zeros(len(of), bool)
            cut[at[:-1] - np.arange(len(number)) * (k - 1)] = True
            step = (source[1:] == source[:-1]) & (so[1:] == so[:-1] + 1)
            cut[1:] |= (hit[1:] != hit[:-1]) | (hit[1:] & ~step)
            head = np.flatnonzero(cut)
            size_, yes = np.diff(np.append(head, len(of))), hit[head]
            found.append((of[head][yes], o[head][yes], size_[yes], source[head][yes], so[head][yes]))
            path = np.concatenate([path[~second], of[head][~yes]])
            offset = np.concatenate([offset[~second], o[head][~yes]])
            count = np.concatenate([count[~second], size_[~yes]])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return split


def decide_shard(k: int):
    """Verdicts of one shard: the paths of its anchors, from all blocks."""
    split = split_paths(k)

    def decide(table: pa.Table) -> pa.Table:
        e = Entries(table)
        size, _ = _join(table.column("size"), np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(table.column("text").to_pylist()), np.uint8)
        order = np.lexsort((*e.rank(), e.b, e.a))
        size, start = size[order], start[order]
        e.take(order)
        new = _heads(e.a, e.b)
        head = np.flatnonzero(new)  # the first of each path; others are covered as a whole
        same = head[np.cumsum(new) - 1] if len(head) else head
        out = [verdict_rows(e.block[~new], COVERED_PATH, e.b[~new], e.place[same[~new]])]
        if len(head):
            head = head[np.lexsort((e.place[head], e.doc[head], e.a[head]))]
            path, offset, count, by, there = split(data, start[head], size[head], e.a[head])
            own, source = head[path], e.place[head[by]] + there
            out.append(verdict_rows(e.block[own], COVERED_RUN, e.b[own], source, offset << 32 | count))
        return _table(_joined(*out), VERDICTS)

    return decide


def _emit(full: bool, carried: bool = False):
    def emit(text: Text, marked: Marked) -> pa.Table:
        total = np.concatenate([[0], np.cumsum(marked.mask)])
        begins = np.concatenate([[0], np.cumsum(np.bincount(_runs(marked.mask, text.at)[0], minlength=text.n))]) if text.n else np.zeros(1, np.int64)
        at, keep = text.at.tolist(), ~marked.mask
        kept = [text.data[a:b][keep[a:b]].tobytes() for a, b in zip(at, at[1:], strict=False)]
        out = {
            "doc_id": text.ids,
            "n_bytes": pa.array(np.diff(text.at), pa.int64()),
            "n_removed": pa.array(total[text.at[1:]] - total[text.at[:-1]], pa.int64()),
            "n_spans": pa.array(begins[text.at[1:]] - begins[text.at[:-1]], pa.int64()),
        }
        if full:
            left = {"text": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())}
            return pa.table(left | {"carried": text.table.column("carried")} if carried else out | left)
        return pa.table(out | {"kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())})

    return emit


def remove_repeated_bytes(docs: DataFrame, k: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and text (what is left) of every row.

    A byte goes if a string of k bytes that covers it also starts earlier: in a document of smaller
    doc_id or before it in the same one; rows of one id rank by a hash of the text. Bytes left of a
    character that was cut are dropped from `text`. Null or empty text: nothing to remove. Null ids rank last. An
    empty table gives an empty table; other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, text string"
    return find_repeats(docs, False, k, ANCHOR_BYTES, True, _emit(True), schema, FEW_PATHS, decide_shard(k), split_paths(k))


def digest_repeated_bytes(docs: DataFrame, k: int = 100) -> DataFrame:
    """remove_repeated_bytes with the digest of the bytes left in place of the text."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return find_repeats(docs, False, k, ANCHOR_BYTES, True, _emit(False), schema, FEW_PATHS, decide_shard(k), split_paths(k))


def shorten_documents(docs: DataFrame, k: int = 100) -> DataFrame:
    """All rows of `docs` with all columns: `text` without repeated bytes, `n_chars` (if there) its length.

    The cases are those of remove_repeated_bytes; a null text stays null.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # by number, so that no column's name can clash
    rest = F.struct(docs["text"].isNull().alias("none"), *(docs[c].alias(n) for c, n in names.items() if c != "text"))
    carried = docs.select(rest.alias("carried")).schema["carried"]
    schema = StructType([StructField("text", StringType()), carried])
    out = find_repeats(docs, False, k, ANCHOR_BYTES, True, _emit(True, True), schema, FEW_PATHS, decide_shard(k), split_paths(k), rest)
    text = F.when(~F.col("carried.none"), F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*(new.get(c, F.col("carried").getField(names[c])).alias(c) for c in docs.columns))
