"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare

TREES = 8
SAMPLE_ROWS = 20_000  # the trees are fitted on at most about so many rows
LEAF_ROWS = 16  # of the sample
RECALL = 0.98  # of the sample's own nearest neighbours, that as many leaves must hold as a query searches
CALIBRATION_ROWS = 64  # of the sample, for which that is measured
CELL_LEAVES = 64  # neighbouring leaves that are searched together
CELL_ROWS = 40_000


class Forest:
    """Balanced trees of hyperplanes; a leaf is (tree, number)."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.log2(max(1, len(sample) / LEAF_ROWS))))
        inner = (1 << self.depth) - 1
        self.normal = np.zeros((trees, inner, sample.shape[1]))
        self.at = np.zeros((trees, inner))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for n in range(inner):
                own = np.flatnonzero(node == n)
                v = self._direction(sample[own], rng)
                side = sample[own] @ v
                self.normal[t, n], self.at[t, n] = v, np.median(side) if len(own) else 0.0
                node[own] = 2 * n + 1 + (side > self.at[t, n])

    @staticmethod
    def _direction(rows: np.ndarray, rng) -> np.ndarray:
        """Between the means of two groups around random rows; any direction if these coincide."""
        v = np.zeros(rows.shape[1])
        if len(rows) > 1:
            some = rows[rng.integers(0, len(rows), 200)]
            a, b = rows[rng.choice(len(rows), 2, replace=False)]
            for _ in range(3):
                near = ((some - a) ** 2).sum(1) < ((some - b) ** 2).sum(1)
                if near.any() and not near.all():
                    a, b = some[near].mean(0), some[~near].mean(0)
            v = a - b
        if not np.linalg.norm(v) > 0:
            v = rng.normal(size=rows.shape[1])
        return v / np.linalg.norm(v)

    @property
    def trees(self) -> int:
        return len(self.at)

    def leaves(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        """The leaf of every row in every tree, or in the first ones."""
        out = np.empty((trees or self.trees, len(x)), np.int64)
        for t in range(len(out)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normal[t][node]) > self.at[t][node])
            out[t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, q: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The `most` most promising leaves of all trees, by one queue: least sum of squared crossed margins first."""
        margin = self.normal @ q - self.at
        inner = (1 << self.depth) - 1
        heap = [(0.0, t, 0) for t in range(self.trees)]
        out: list[tuple[int, int]] = []
        while heap and len(out) < most:
            d, t, n = heapq.heappop(heap)
            while n < inner:
                m = margin[t, n]
                heapq.heappush(heap, (d + m * m, t, 2 * n + 2 - int(m > 0)))
                n = 2 * n + 1 + int(m > 0)
            out.append((t, n - inner))
        return out

    def effort(self, sample: np.ndarray, ids: np.ndarray, k: int) -> int:
        """How many leaves a query has to search: as few as hold RECALL of the k nearest ids of some sample rows.

        Data with structure need few, data without any a large share. A larger table has nearer
        neighbours, which lie in earlier leaves, so the sample's number is on the safe side.
        """
        some = np.random.default_rng(11).permutation(len(sample))[:CALIBRATION_ROWS]
        leaf, needed = self.leaves(sample), []
        for i in some.tolist():
            d = ((sample - sample[i]) ** 2).sum(1)
            order = np.argsort(d, kind="stable")
            order = order[ids[order] != ids[i]]
            near = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]  # of each id the nearest row
            place = np.empty((self.trees, 1 << self.depth), np.int64)
            t, n = np.array(self.search(sample[i], self.trees << self.depth)).T
            place[t, n] = np.arange(len(t))
            needed += place[np.arange(self.trees)[:, None], leaf[:, near]].min(0).tolist()
        return int(np.quantile(needed, RECALL, method="higher")) + 1 if needed else 1


def _sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part: finite, not zero, of the most usual length."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (usual[0]["d"] if usual else 0))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose id is divisible by `every`.

    score is the Euclidean distance in double precision on the original vectors; ties go to the
    smaller vec_id and a row is no candidate of its own. Of equal vectors only the k + 1 least ids can
    be in a result, so no more enter the index, each once. Trees are fitted on a bounded sample, and how many
    leaves a query searches is measured there (Forest.effort); every row is then put into its leaf of
    every tree. Leaves are searched in cells; a cell with many rows is
    split, and its queries go to all parts, so no group grows with the table. A query that holds fewer than k
    ids after its leaves (rows of one id may fill them) goes on through all leaves of a tree, so its result is exact.

    Rows without an id, null or zero vectors and vectors with null or non-finite components take no
    part; nor do vectors of another length than the most usual. Rows of one id are apart as candidates
    but one result each (the nearest). Fewer candidates than k give fewer rows; an empty table none.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    first = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = _sound(vectors, id_col, vector_col)
    index = materialise(rows.dropDuplicates(["vec_id", "v"]).withColumn("n", first).where(F.col("n") <= k + 1).drop("n"))
    n = index.count()
    if not n:
        return spark.createDataFrame([], schema)
    share = -(-n // SAMPLE_ROWS)
    sample = index.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).orderBy(F.xxhash64("vec_id", F.lit(1))).limit(2 * SAMPLE_ROWS)
    rows_ = sample.collect() or [index.first()]
    fitted, own = np.array([r["v"] for r in rows_]), np.array([r["vec_id"] for r in rows_])
    forest = spark.sparkContext.broadcast(Forest(fitted))
    depth = forest.value.depth
    most = forest.value.effort(fitted, own, k)
    cells = max(1, (1 << depth) // CELL_LEAVES)
    salts = max(1, n * TREES // (TREES * cells * CELL_ROWS))

    def place(batches, trees: int):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            leaf = forest.value.leaves(x, trees)
            at = np.tile(np.arange(len(x)), trees)
            tree = np.repeat(np.arange(trees), len(x))
            salt = at % salts  # any part will do, as queries go to all
            cell = (tree * cells + leaf.ravel() // CELL_LEAVES) * salts + salt
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(leaf.ravel().astype(np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))],
                ["cell", "leaf", "vec_id", "v"],
            )

    def ask(batches, wanted):
        for b in batches:
            out: list[tuple] = []
            for i, (q, v) in enumerate(zip(b.column(0).to_pylist(), _matrix(b.column(1)), strict=True)):
                by: dict[int, list[int]] = {}
                for t, leaf in wanted(v):
                    by.setdefault(t * cells + leaf // CELL_LEAVES, []).append(leaf)
                out += [(c * salts + s, sorted(x), q, i) for c, x in by.items() for s in range(salts)]
            if out:
                cell, leaf, q, i = map(list, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int64()), pa.array(leaf, pa.list_(pa.int32())), pa.array(q, pa.int64()), b.column(1).take(pa.array(i))],
                    ["cell", "leaves", "query_id", "q"],
                )

    def rerank(own: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if own.num_rows and asked.num_rows:
            ids, x = own.column("vec_id").to_numpy(), _matrix(own.column("v"))
            leaf = own.column("leaf").to_numpy()
            repeated = len(np.unique(ids)) < len(ids)
            for q, v, wanted in zip(
                asked.column("query_id").to_pylist(), _matrix(asked.column("q")), asked.column("leaves").to_pylist(), strict=True
            ):
                at = np.flatnonzero(np.isin(leaf, wanted) & (ids != q))
                d = np.sqrt(((x[at] - v) ** 2).sum(1))
                if repeated:  # of one id the nearest row, so that no id takes two places
                    order = np.argsort(d, kind="stable")
                    order = order[np.unique(ids[at[order]], return_index=True)[1]]
                    at, d = at[order], d[order]
                if len(at) > k:
                    near = d <= np.partition(d, k - 1)[k - 1]
                    at, d = at[near], d[near]
                found[0] += [q] * len(at)
                found[1] += ids[at].tolist()
                found[2] += d.tolist()
        return pa.table(
            {"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())}
        )

    def ranked(queries: DataFrame, trees: int, wanted) -> DataFrame:
        """The k nearest of each query among the rows of the leaves that `wanted` gives for its vector."""
        leaves = index.mapInArrow(lambda x: place(x, trees), "cell long, leaf int, vec_id long, v array<double>")
        asked = queries.mapInArrow(lambda x: ask(x, wanted), "cell long, leaves array<int>, query_id long, q array<double>")
        found = leaves.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(rerank, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return (
            found.groupBy("query_id", "vec_id")
            .agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(order).cast("int"))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )

    queries = index_queries(rows, every)
    found = materialise(ranked(queries, TREES, lambda v: forest.value.search(v, most)))
    held = found.groupBy("query_id").agg(F.count("*").alias("held"))
    enough = min(k, index.select("vec_id").distinct().count() - 1)
    short = queries.join(held, queries["vec_id"] == held["query_id"], "left").where(F.coalesce("held", F.lit(0)) < enough).select("vec_id", "v")
    short = materialise(short)
    if short.isEmpty():
        return found
    # these go on to the last leaf: one tree holds every row
    rest = ranked(short, 1, lambda v: [(0, leaf) for leaf in range(1 << depth)])
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)


def index_queries(rows: DataFrame, every: int) -> DataFrame:
    """The query rows; of one id, one."""
    return rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v")


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)
