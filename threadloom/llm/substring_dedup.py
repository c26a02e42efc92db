"""Substring dedup over words by De Bruijn compaction."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Marked, Text, find_paths, find_repeats

ANCHOR_WORDS = 4


def _runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a mask, cut at document starts."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], mask[:-1]]) if len(mask) else mask
    after = np.concatenate([mask[1:], [False]]) if len(mask) else mask
    return np.flatnonzero(mask & (~before | edge[:-1])), np.flatnonzero(mask & (~after | edge[1:])) + 1


def _kept(text: Text, gone: np.ndarray) -> list[bytes]:
    """Kept words of each document, joined by one space."""
    start, stop, n = text.start[~gone], text.stop[~gone], len(text.data)
    doc = text.doc_of(np.flatnonzero(~gone))
    more = np.concatenate([doc[1:] == doc[:-1], [False]]) if len(doc) else np.zeros(0, bool)
    out = np.append(text.data, np.uint8(32))
    out[stop[more]] = 32
    diff = np.bincount(start, minlength=n + 2) - np.bincount(stop + more, minlength=n + 2)
    mask = np.cumsum(diff)[:n] > 0
    at = text.bytes_at.tolist()
    return [out[a:b][mask[a:b]].tobytes() for a, b in zip(at, at[1:], strict=False)]


def _emit(full: bool):
    def emit(text: Text, marked: Marked) -> pa.Table:
        words = np.diff(text.at)
        total = np.concatenate([[0], np.cumsum(marked.mask)])
        removed = total[text.at[1:]] - total[text.at[:-1]]
        kept = _kept(text, marked.mask)
        out = {
            "doc_id": text.ids,
            "n_words": pa.array(words, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
        }
        if not full:
            return pa.table(out | {"kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())})
        a, b = _runs(marked.mask, text.at)
        by = np.searchsorted(text.at, a, side="right") - 1
        spans: list[list[dict]] = [[] for _ in words]
        order = np.argsort(marked.first, kind="stable")
        first, source = marked.first[order], marked.source[order]
        for d, x, y in zip(by.tolist(), a.tolist(), b.tolist(), strict=True):
            i, j = np.searchsorted(first, [x, y])
            own = {"start": x - int(text.at[d]), "stop": y - int(text.at[d]), "source": int(source[i:j].min())}
            spans[d].append(own)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("source", pa.int64())]))
        return pa.table(out | {"text": pa.array([x.decode() for x in kept]), "spans": pa.array(spans, kind)})

    return emit


def remove_repeated_spans(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words) and spans of every row.

    A word goes if a window of k words that covers it also starts in a document of smaller doc_id; a
    span is a run of such words, by position, with the least source document among its windows.
    Null or empty text: no words, nothing kept. Null ids rank after all others and not before each
    other; rows with one id are no sources for each other. An empty table gives an empty table; other
    columns are ignored.
    """
    schema = "doc_id long, n_words long, n_removed long, text string, spans array<struct<start:long,stop:long,source:long>>"
    return find_repeats(docs, True, k, ANCHOR_WORDS, False, _emit(True), schema)


def digest_repeated_spans(docs: DataFrame, k: int = 13) -> DataFrame:
    """remove_repeated_spans with the kept words' digest in place of the text and spans."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return find_repeats(docs, True, k, ANCHOR_WORDS, False, _emit(False), schema)


def repeated_paths(docs: DataFrame, k: int = 13) -> DataFrame:
    """The De Bruijn graph of repeated windows, compacted: doc_id, start, n_symbols, occurrences, in_degree, out_degree.

    Edges are windows of k words that come again in a document of greater id. A row is a maximal run of
    them through which all their occurrences go together, at its first place (least doc_id, then position):
    start and n_symbols count words, occurrences the places it comes at (of windows that the first document
    repeats itself only the first), the degrees the distinct words before its first and after its last node.
    Rows of one id are no repeats of each other; null ids rank last; an empty table gives an empty one.
    """
    return find_paths(docs, True, k, ANCHOR_WORDS)
