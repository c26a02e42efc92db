"""Quantile summaries of keys that lie whole in one partition, many keys at once.

The same summaries, merges and answers as in `quantiles`, for rows sorted by key and x: ranks are running sums
there, so no key is shuffled again. Keys that a partition's ends cut, and keys longer than a worker should hold, are
passed on as they came.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Rows that a worker gathers; a key of as many is passed on.
CHUNK_ROWS = 1 << 17
RESULT = "i int, n long, target long, exact_x long, points long, answer long, n_below long, n_upto long, rank_error long, within boolean"


def finisher(by: list[str], batch: str, answers: Callable[..., dict[str, np.ndarray]], chunk: int = CHUNK_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows (by, batch, x, times) sorted by (by, x): rows of `answers` (by, batch, RESULT; x and
    times null) for whole keys, the rows themselves (RESULT null) for all others."""

    names = [*by, batch, *(c.split()[0] for c in RESULT.split(", ")), "x", "times"]

    def made(like: pa.Table, columns: dict) -> list[pa.RecordBatch]:
        kinds = {f.name: f.type for f in like.schema} | {"i": pa.int32(), "within": pa.bool_()}
        rows = len(columns[batch])
        arrays = []
        for c in names:
            kind = kinds.get(c, pa.int64())
            v = columns.get(c)
            arrays.append(pa.nulls(rows, kind) if v is None else v if isinstance(v, pa.ChunkedArray) else pa.array(v, kind))
        return pa.table(arrays, names=names).to_batches()

    def passed(t: pa.Table) -> list[pa.RecordBatch]:
        return made(t, {c: t[c] for c in t.column_names})

    def finished(t: pa.Table, start: np.ndarray) -> list[pa.RecordBatch]:
        if not len(start):
            return []
        key = np.repeat(np.arange(len(start)), np.diff(start, append=len(t)))
        got = answers(key, *(t[c].to_numpy() for c in (batch, "x", "times")))
        own = t.select(by).take(pa.array(start[got.pop("key")]))
        return made(t, {c: own[c] for c in by} | {batch if k == "batch" else k: v for k, v in got.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows, cut = 0, True  # cut: the first key kept isn't whole
        for b in batches:
            kept.append(b)
            rows += b.num_rows
            if rows < chunk:
                continue
            t = pa.Table.from_batches(kept)
            start = _starts(*(_codes(t[c]) for c in by))
            last = int(start[-1])
            if not last:  # a long key: its last row stays to tell where it ends
                last, cut = rows - 1, True
                yield from passed(t.slice(0, last))
            else:
                head = int(start[1]) if cut else 0
                yield from passed(t.slice(0, head))
                yield from finished(t.slice(head, last - head), start[int(cut) : -1] - head)
                cut = False
            kept, rows = t.slice(last).to_batches(), rows - last
        if rows:
            t = pa.Table.from_batches(kept)
            start = _starts(*(_codes(t[c]) for c in by))
            last = int(start[-1])
            head = int(start[1]) if cut and last else 0
            yield from passed(t.slice(0, head))
            if last:
                yield from finished(t.slice(head, last - head), start[int(cut) : -1] - head)
            yield from passed(t.slice(last))

    return run


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers, alike for alike values and for nulls."""
    return pa.concat_arrays(column.chunks).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows that are alike in all columns begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _ranks(start: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """below, upto, n, place and distinct of `quantiles.exact_ranks`, for runs of distinct rows in their order."""
    size = np.diff(start, append=len(times))
    upto = np.cumsum(times)
    upto -= np.repeat(upto[start] - times[start], size)
    return upto - times, upto, np.repeat(np.add.reduceat(times, start), size), np.arange(1, len(times) + 1) - np.repeat(start, size), np.repeat(size, size)


def _spaced(low: np.ndarray, high: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    return high * n // total > low * n // total


def answers(key: np.ndarray, batch: np.ndarray, x: np.ndarray, times: np.ndarray, *, parts: int, allowed: int, least: int, points: int, least_points: int, most: int, whole: int) -> dict[str, np.ndarray]:
    """key, batch and RESULT for rows of whole keys, sorted by key (a number) and x, distinct by key, batch and x."""
    kinds, kind = np.unique(batch, return_inverse=True)
    tie = _starts(key, x)  # the rows of all batches together
    tie_of, tie_key, tie_x, tie_times = np.repeat(np.arange(len(tie)), np.diff(tie, append=len(x))), key[tie], x[tie], np.add.reduceat(times, tie)
    true_below, true_upto, *_ = _ranks(_starts(tie_key), tie_times)

    order = np.argsort(key * len(kinds) + kind, kind="stable")
    own = _starts(key[order], kind[order])
    below, upto, n, place, distinct = _ranks(own, times[order])
    held = _spaced(below, upto, n, points) | _spaced(place - 1, place, distinct, least_points) | (below == 0)
    at, below, upto, n = order[held], below[held], upto[held], n[held]
    start = _starts(key[at], kind[at])
    found = [_answered(start, key[at], batch[at], n, x[at], below, upto, below, upto, own, x[order], times[order], parts, least)]

    first = np.zeros(len(at), bool)
    first[start] = True
    ceiling = np.where(np.roll(first, -1), n, np.roll(below, -1))
    by_tie = np.argsort(tie_of[at], kind="stable")
    merged = _starts(tie_of[at][by_tie])
    total = lambda c: np.add.reduceat(c[by_tie], merged)
    point = tie_of[at][by_tie][merged]
    keys = _starts(tie_key[point])
    rows = lambda c: np.repeat(np.add.reduceat(c, keys), np.diff(keys, append=len(point)))
    _, low, _, place, count = _ranks(keys, total(upto - np.where(first, 0, np.roll(upto, 1))))
    high = _ranks(keys, total(ceiling - np.where(first, below, np.roll(ceiling, 1))))[1] + rows(total(np.where(first, below, 0)))
    n = rows(total(np.where(first, n, 0)))
    middle = low + total(below - upto) + high + total(upto - ceiling)
    ends = (place == 1) | (place == count)
    held = (count <= most) | ends | _spaced(np.roll(middle, 1), middle, 2 * n, most - least_points - 2) | _spaced(place - 1, place, count, least_points)
    below_max, point = (high + total(below - ceiling))[held], point[held]
    own_key = tie_key[point]
    found.append(_answered(_starts(own_key), own_key, np.full(len(point), whole), n[held], tie_x[point], below_max, low[held], true_below[point], true_upto[point], _starts(tie_key), tie_x, tie_times, parts, least))

    out = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
    out["rank_error"] = np.maximum(0, np.maximum(out["n_below"] + 1 - out["target"], out["target"] - out["n_upto"]))
    return out | {"within": 1000 * out["rank_error"] <= allowed * out["n"]}


def _answered(start, key, batch, n, x, below_max, upto_min, n_below, n_upto, row_start, row_x, row_times, parts, least) -> dict[str, np.ndarray]:
    """`quantiles.estimate` and exact x of summaries, runs of points from `start` on; their rows are runs from `row_start` on."""
    size = np.diff(start, append=len(x))
    run = np.repeat(np.arange(len(start)), size)
    upto = np.cumsum(row_times)
    found = []
    for i in range(1, parts):
        target = -(-i * n // parts)
        off = np.maximum(0, np.maximum(below_max + 1 - target, target - upto_min))
        best = np.flatnonzero(off == np.repeat(np.minimum.reduceat(off, start), size))
        best = best[_starts(run[best])]  # the least x of several
        exact = row_x[np.searchsorted(upto, upto[row_start] - row_times[row_start] + target[start])]
        made = {"key": key[start], "batch": batch[start], "i": np.full(len(start), i), "n": n[start], "target": target[start], "exact_x": exact, "points": size, "answer": x[best], "n_below": n_below[best], "n_upto": n_upto[best]}
        found.append({k: v[n[start] >= least] for k, v in made.items()})
    return {c: np.concatenate([f[c] for f in found]) for c in found[0]}
