"""Best-fit packing of tokenized documents by length patterns."""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, materialise, prepare, release
from .tokens import broadcast_spec, byte_level

ROWS_A_BLOCK = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, vocabulary_path: str, room: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of at most room tokens: a document's ids and end_id; of a longer one the first is shorter.

    Null or empty text: end_id alone. Null ids stay null, repeated rows give repeated rows, an empty table
    an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    spec = broadcast_spec(spark, vocabulary_path)

    def run(batches):
        v = byte_level(spec.value)
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(v.ids(text), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % room or room, len(ids) + 1, room)] if len(ids) > room else [0, len(ids)]
                data = ids.tobytes()
                for k, (x, y) in enumerate(pairwise(cuts)):
                    doc.append(d)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(data[4 * x : 4 * y]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        release()

    return ids_and_texts(docs).mapInArrow(run, PIECES)


def enumerate_patterns(lengths: np.ndarray, room: int) -> np.ndarray:
    """Patterns of one to three of the lengths that fill a sequence whole; unused places are 0."""
    have = np.zeros(room + 1, bool)
    have[lengths] = True
    out = [[room, 0, 0]] if have[room] else []
    out += [[a, room - a, 0] for a in range(-(-room // 2), room) if have[a] and have[room - a]]
    for a in lengths[lengths >= -(-room // 3)].tolist():
        b = np.arange(-(-(room - a) // 2), min(a, room - a - 1) + 1)
        b = b[have[b] & have[room - a - b]]
        out += np.stack([np.full(len(b), a), b, room - a - b], 1).tolist()
    return np.array(out, np.int64).reshape(-1, 3)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: how often to repeat each pattern."""
    n, room = len(patterns), len(histogram) - 1
    used = patterns > 0
    weight = 1 / np.sqrt(np.maximum(histogram, 1.0))  # rare lengths count as much as common ones

    def lengths_of(x):
        return np.bincount(patterns[used], np.broadcast_to(x[:, None], patterns.shape)[used], room + 1) * weight

    def back(r):
        r = r * weight
        r[0] = 0
        return r[patterns].sum(1)

    v = np.ones(n)
    for _ in range(12):  # largest eigenvalue, for the step
        v = back(lengths_of(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(n)
    t, goal = 1.0, histogram * weight
    for _ in range(steps):
        new = np.maximum(0, y - back(lengths_of(y) - goal) / (1.05 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan_sequences(histogram: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths, repeats) for every kind of sequence; all pieces of the histogram are placed.

    The work grows with the number of lengths (at most the room), not with the number of pieces.
    """
    room = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[list[int], int]] = []
    lengths = np.flatnonzero(left)
    patterns = enumerate_patterns(lengths[lengths > 0], room)
    if len(patterns):
        counts = np.floor(fit_counts(patterns, left.astype(float)) + 0.5).astype(np.int64)
        for j in np.argsort(-counts, kind="stable").tolist():
            own = [p for p in patterns[j].tolist() if p]
            n = min([int(counts[j]), *(int(left[p]) // own.count(p) for p in own)])
            if n <= 0:
                continue
            for p in own:
                left[p] -= n
            plan.append((own, n))
    return plan + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over a histogram; alike sequences are handled as one."""
    room = len(left) - 1
    bins: dict[int, list[list]] = {}  # free place -> [lengths, repeats]
    for size in range(room, 0, -1):
        n = int(left[size])
        while n:
            free = next((f for f in range(size, room) if bins.get(f)), None)
            if free is None:
                each = room // size  # equal pieces side by side
                if n >= each:
                    bins.setdefault(room - each * size, []).append([[size] * each, n // each])
                    n %= each
                else:
                    bins.setdefault(room - n * size, []).append([[size] * n, 1])
                    n = 0
                continue
            kind = bins[free][-1]
            each = min(free // size, n)
            take = min(kind[1], n // each)
            kind[1] -= take
            if not kind[1]:
                bins[free].pop()
            bins.setdefault(free - each * size, []).append([kind[0] + [size] * each, take])
            n -= take * each
    return [(own, n) for kinds in bins.values() for own, n in kinds if n]


def _slots(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Runs of ranks: for each length, ranks from `first` on take place `offset` of sequences from `sequence` on."""
    rows, base, taken = [], 0, {}
    for own, n in plan:
        offset = 0
        for size in own:
            first = taken.get(size, 0)
            rows.append((size << 44 | first, base, offset))
            taken[size] = first + n
            offset += size
        base += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def pack_documents(docs: DataFrame, vocabulary_path: str, room: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    The histogram of lengths (at most `room` numbers) goes to the driver; patterns of few lengths are
    repeated as non-negative least squares says, the rest goes by best fit. Each piece's rank among
    those of its length, counted in blocks so that no length is sorted in one task, names its place.

    Null or empty text: one piece that holds end_id alone. A null doc_id stays null. Repeated rows are
    packed each. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = cut_documents(docs, vocabulary_path, room, end_id)
    pieces = materialise(cut.withColumn("salt", F.monotonically_increasing_id()))  # tells like rows apart
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(room + 1, np.int64)
    for k, n in counts.items():
        histogram[k] = n
    slots = spark.sparkContext.broadcast(_slots(plan_sequences(histogram)))
    blocks = max(64, int(histogram.sum()) // ROWS_A_BLOCK)
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("salt"), F.lit(blocks)).cast("int"))
    before = (
        blocked.groupBy("length", "block")
        .agg(F.count("*").alias("n"))
        .select(
            "length",
            "block",
            (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"),
        )
    )
    own = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32", "salt")
    ranked = (
        blocked.withColumn("own", F.row_number().over(own) - 1)
        .join(before, ["length", "block"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))
    )

    def place(batches):
        key, sequence, offset = slots.value
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            i = np.searchsorted(key, size << 44 | rank, side="right") - 1
            first = key[i] & ((1 << 44) - 1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence[i] + rank - first), pa.array(offset[i])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
