"""How text filters interact: what each removes in every order of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, materialise, prepare

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
AUDIT = (
    "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)
PARTS_AT_ONCE = 200


def own_failures(text: Column) -> Column:
    """Bits 0 to 3: too few words (A), too repetitive (B), too many capitals (C), marks of code or tables (D)."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = (
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals > 5 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    )
    mask = F.lit(0)
    for k, fails in enumerate(tests):
        mask = mask + F.when(fails, 1 << k).otherwise(0)
    return mask


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and how many documents have it: n, good (labels: quality 1) and toxic (toxic 1).

    Bit 4 (E) is set if a smaller doc_id has the same text. Copies within a part are counted before any
    shuffle; what meets by text or by id after that are rows of a hash, an id and a count.
    """
    rows = ids_and_texts(docs, more=(F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"),))
    text = F.col("text")
    judged = rows.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("h"), own_failures(text).alias("own"))
    cells = materialise(judged.groupBy("h", "doc_id", "part", "own").agg(F.count("*").alias("n")))
    first = cells.groupBy("h").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    told = labels.groupBy(labels["doc_id"].cast("long").alias("id")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("good"), F.max((labels["toxic"] == 1).cast("int")).alias("toxic")
    )
    # rows without an id have no label and no smaller id; dealt by their text, they don't meet in one task
    told = told.where("id IS NOT NULL").withColumn("known", F.lit(True))
    keyed = cells.join(first.withColumn("is_first", F.lit(True)), ["h", "doc_id"], "left").select(
        "part", "n", (F.col("own") + F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), 16).otherwise(0)).alias("mask"),
        F.coalesce("doc_id", F.xxhash64("h")).alias("id"), F.col("doc_id").isNotNull().alias("known"),
    )
    labelled = keyed.join(told, ["id", "known"], "left")
    times = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return labelled.groupBy("part", "mask").agg(F.sum("n").alias("n"), times("good"), times("toxic"))


def plain_changes(n: int) -> Iterator[tuple[list[int], int]]:
    """All orders of n things, each made of the one before by swapping neighbours, and where (-1: the first)."""
    order, moves = list(range(n)), [-1] * n
    yield order, -1
    while True:
        for x in range(n - 1, -1, -1):  # the greatest thing that can move on past a smaller one
            i = order.index(x)
            j = i + moves[x]
            if 0 <= j < n and order[j] < x:
                break
        else:
            return
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            moves[y] = -moves[y]
        yield order, min(i, j)


def audit_orders(cells: np.ndarray, filters: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Every order's name, its steps and the filters' Shapley sums.

    cells: for each part and mask the numbers of documents, good and toxic ones (parts x 2^k x 3). Steps:
    parts x orders x k x (filter, kept, removed, redundant, unique, good lost, toxic lost). Neighbouring
    orders differ by a swap, so two steps are counted from the cells anew and the others stay.
    """
    k = len(filters)
    parts = len(cells)
    mask = np.arange(1 << k)
    fails = np.stack([cells[:, (mask >> f & 1) == 1, 0].sum(1) for f in range(k)], 1)
    only = np.stack([cells[:, 1 << f, 0] for f in range(k)], 1)
    total = cells[:, :, 0].sum(1)
    now = np.zeros((parts, k, 7), np.int64)
    shapley = np.zeros((parts, k), np.int64)
    names, seen = [], []

    def count(order: list[int], step: int) -> None:
        f, before = order[step], sum(1 << x for x in order[:step])
        lost = cells[:, ((mask >> f & 1) == 1) & (mask & before == 0)].sum(1)
        left = now[:, step - 1, 1] if step else total
        now[:, step, 0] = f
        now[:, step, 1] = left - lost[:, 0]
        now[:, step, 2] = lost[:, 0]
        now[:, step, 3] = fails[:, f] - lost[:, 0]
        now[:, step, 4] = only[:, f]
        now[:, step, 5:] = lost[:, 1:]

    for order, at in plain_changes(k):
        for step in range(k) if at < 0 else (at, at + 1):
            count(order, step)
        names.append("".join(filters[f] for f in order))
        seen.append(now.copy())
        shapley[:, order] += now[:, :, 2]
    return names, np.stack(seen, 1), shapley


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and the counts of AUDIT: 600 rows for each part (source).

    Documents become cells (part, mask of failed filters, at most 32 a part); all orders are then walked
    over the cells by swaps of neighbours. Parts are spread over the tasks.

    Null source: part "". Null or empty text: no words, so it fails A alone (and E as a copy). A null doc_id
    has no label and no smaller id, and isn't smaller than others. Repeated rows count each, and of one id
    none is a copy of the other. Several labels of one document: any that says 1. Empty documents: no rows;
    empty labels: none lost. Other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    of_part = failure_cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, PARTS_AT_ONCE):
                yield _audited(b.slice(at, PARTS_AT_ONCE))

    return of_part.mapInArrow(run, AUDIT)


def _audited(parts: pa.RecordBatch) -> pa.RecordBatch:
    cells = np.zeros((parts.num_rows, 1 << len(FILTERS), 3), np.int64)
    for i, own in enumerate(parts.column(1).to_pylist()):
        for c in own:
            cells[i, c["mask"]] = c["n"], c["good"], c["toxic"]
    names, steps, shapley = audit_orders(cells)
    n, orders, k, _ = steps.shape
    flat = steps.reshape(-1, 7)
    filters = np.array(list(FILTERS))
    part = np.repeat(np.arange(n), orders * k)
    return pa.RecordBatch.from_arrays(
        [
            parts.column(0).take(pa.array(part)), pa.array(np.tile(np.repeat(np.array(names), k), n)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * orders)),
            pa.array(filters[flat[:, 0]]), *(pa.array(flat[:, c]) for c in range(1, 7)), pa.array(shapley[part, flat[:, 0]]),
        ],
        ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    )
