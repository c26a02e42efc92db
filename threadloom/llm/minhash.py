"""MinHash document fingerprints over word shingles."""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Rolling, mixed, split_words, word_hashes
from .common import estimated_bytes, ids_and_texts, prepare, staged

U = np.uint64
WIDTH = 5
PERMUTATIONS = 128
SLOT_BYTES = 2 << 20
MOST_SLOTS = 1 << 20  # what the driver holds; beyond it slots grow, which a task reads document by document
ROWS = 4  # minima a band
STEP = 1 << 15  # shingles at once, so that a permutation's arrays stay in cache
NULL_ID = -(1 << 63)

_rng = np.random.default_rng(5)
MULTIPLY = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=U) * U(2) + U(1)
ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=U) * U(2)


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles and each text's first; fewer words than `width` make one shingle."""
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, stop = split_words(data, offs)
    at = np.searchsorted(start, offs)
    words = word_hashes(data, start, stop)
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    total = np.cumsum(count)
    first = np.repeat(at[:-1] - (total - count), count) + np.arange(total[-1] if len(total) else 0)
    last = np.minimum(first + width, np.repeat(at[1:], count))
    r = Rolling(words)
    return r.spans(first, last), np.concatenate([[0], total])


def sketches(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Signatures, and the shingle sets they are of.

    A signature is a row of 16-bit digests of the minima, one for each permutation x -> a x + b modulo 2^64,
    a odd. A text without words has the greatest value throughout.
    """
    h, at = shingles(texts)
    out = np.full((len(texts), PERMUTATIONS), 0xFFFF, np.uint16)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    low = np.full((len(texts), PERMUTATIONS), ~U(0))
    for k in range(0, len(h), STEP):
        x, d = h[k : k + STEP], doc[k : k + STEP]
        head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        own = d[head]
        buffer = np.empty_like(x)
        for p in range(PERMUTATIONS):
            np.multiply(x, MULTIPLY[p], out=buffer)
            np.add(buffer, ADD[p], out=buffer)
            low[own, p] = np.minimum(low[own, p], np.minimum.reduceat(buffer, head))
    has = np.diff(at) > 0
    out[has] = (mixed(low[has]) >> U(48)).astype(np.uint16)  # minima are small, so mixed first
    return out, [_set(h[x:y]) for x, y in zip(at, at[1:], strict=False)]


def _set(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def set_likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard index of two sorted sets; 1 if both are empty."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def _hex(s: np.ndarray) -> list[str]:
    return [x.astype(">u2").tobytes().hex() for x in s]


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _keyed(docs: DataFrame) -> DataFrame:
    """The order of documents: id descending, null last; rows of one id by a hash of the text, then the text."""
    order = F.bitwise_not(F.xxhash64("text").bitwiseXOR(F.lit(NULL_ID)))  # descending, like the ids
    return docs.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("place", order)


def _slots(keyed: DataFrame):
    """Which slot a row is in, and for each slot the first key of the next.

    The bounds come from a sample of 16 ids for each slot; an id with more rows than a slot has as many
    slots to itself as it needs. The driver holds 17 numbers for each of at most MOST_SLOTS slots.
    """
    slots = int(min(MOST_SLOTS, max(64, estimated_bytes(keyed) // SLOT_BYTES)))
    ids = keyed.select("id")
    n = ids.count()
    sample = ids.sample(min(1.0, 16 * slots / max(n, 1)), seed=1).toPandas()["id"].to_numpy()
    bounds, times = np.unique(np.sort(sample)[:: max(1, len(sample) // slots)], return_counts=True)
    own = np.where(times > 1, times, 0)  # slots of that id alone
    base = np.cumsum(own + 1) - own  # those come first (slots are numbered like ids), then that of the ids above

    @F.pandas_udf("int")
    def slot(id_, place):
        import pandas as pd

        x = id_.to_numpy()
        at = np.searchsorted(bounds, x, side="right") - 1
        out = np.where(at < 0, 0, (base + own)[np.maximum(at, 0)]) if len(bounds) else np.zeros(len(x), np.int64)
        if own.any():
            among = (at >= 0) & (bounds[np.maximum(at, 0)] == x) & (own[np.maximum(at, 0)] > 0)
            at = at[among]
            share = (place.to_numpy()[among].astype(np.float64) + 2.0**63) / 2.0**64
            out[among] = base[at] + np.minimum((share * own[at]).astype(np.int64), own[at] - 1)
        return pd.Series(out.astype(np.int32))

    first = keyed.select(slot("id", "place").alias("slot"), F.struct("id", "place").alias("key")).groupBy("slot").agg(F.max("key").alias("key"))
    most = {r["slot"]: (r["key"]["id"], r["key"]["place"]) for r in first.collect()}
    down = sorted(most, reverse=True)
    return slot, [(*most[b], a) for a, b in zip(down, [*down[1:], *down[:1]], strict=True)]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row; further,
    for its edited text and the next document: how many signature bands it shares with it (bands_edited,
    bands_next) and the Jaccard index of the shingle sets (jaccard_edited, jaccard_next).

    Documents follow each other by descending doc_id, the first after the last; rows of one id by a hash of
    the text, then the text, a null id after all others. Rows are dealt into slots of neighbouring ids, each of
    which also gets the first document of the slot below it, so one shuffle brings every document its successor.
    Likeness is the share of equal minima, which estimates the Jaccard index; two texts without words are
    alike (1). A single row is its own successor. Null text is empty. An empty table gives an empty table;
    other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    keyed = _keyed(ids_and_texts(docs))
    slot, heads = _slots(keyed)
    # 20 bytes a slot and MOST_SLOTS slots at most: 20 MB whatever the input
    guests = spark.createDataFrame(heads or [(0, 0, -1)], "id long, place long, slot int")
    met = keyed.join(F.broadcast(guests), ["id", "place"]).groupBy("slot", "id", "place").agg(F.min("text").alias("text"))
    rows = keyed.withColumn("slot", slot("id", "place")).withColumn("guest", F.lit(False)).unionByName(
        met.withColumn("guest", F.lit(True)), allowMissingColumns=True
    )
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema += ", bands_edited int, jaccard_edited double, bands_next int, jaccard_next double"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("guest", "ascending"), ("id", "descending"), ("place", "descending"), ("text", "ascending")])
        n = table.num_rows - sum(table.column("guest").to_pylist())
        texts = table.column("text").slice(0, n + 1).to_pylist()
        out: list[list] = [[] for _ in range(10)]
        for a, b in pairwise(_cuts(texts, n)):
            part = texts[a : b + 1]
            if len(part) == b - a:  # the only slot's own first document follows its last
                part.append(texts[0])
            new = [edited(x, y) for x, y in pairwise(part)]
            s, sets = sketches([x.encode() for x in part])
            e, edited_sets = sketches([x.encode() for x in new])
            keys, edited_keys = band_keys(s), band_keys(e)
            out[0] += [len(x) for x in part[:-1]]
            out[1] += [hashlib.sha256(x.encode()).hexdigest() for x in new]
            out[2] += _hex(s[:-1])
            out[3] += _hex(e)
            out[4] += (s[:-1] == e).mean(1).tolist()
            out[5] += (s[:-1] == s[1:]).mean(1).tolist()
            out[6] += (keys[:-1] == edited_keys).sum(1).tolist()
            out[7] += [set_likeness(x, y) for x, y in zip(sets, edited_sets, strict=False)]
            out[8] += (keys[:-1] == keys[1:]).sum(1).tolist()
            out[9] += [set_likeness(x, y) for x, y in pairwise(sets)]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 2, *[pa.int32(), pa.float64()] * 2]
        names = [x.split()[0] for x in schema.split(", ")]
        cols = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
        return pa.table([table.column("doc_id").slice(0, n), *cols], names=names)

    return rows.groupBy("slot").applyInArrow(run, schema)


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS minima of each signature."""
    values = s.reshape(len(s), -1, ROWS).astype(U)
    key = np.zeros(values.shape[:2], U)
    for r in range(ROWS):
        key = mixed(key + values[:, :, r] + U(r + 1))
    return key.view(np.int64)


def similar_documents(docs: DataFrame, every: int = 50, threshold: float = 0.8) -> DataFrame:
    """query_id, doc_id, jaccard: for each document whose id is divisible by `every`, those at least so alike.

    Signature bands of the queries are joined with those of all documents, and the Jaccard index of the
    five-word shingle sets (as 64-bit hashes) of each pair that shares a band is computed. Equal texts are one:
    query_id is the least such id of a text, doc_id the least id of another text. With 32 bands of 4
    minima a pair of index 0.8 is missed once in 10 million times. Texts without words have no shingles
    and are like nothing; rows without an id are ignored.
    """
    prepare(docs.sparkSession)
    own = ids_and_texts(docs).where("doc_id IS NOT NULL")
    asked = F.min(F.when(F.col("doc_id") % every == 0, F.col("doc_id"))).alias("query_id")
    texts = own.groupBy("text").agg(F.min("doc_id").alias("doc_id"), asked).select("doc_id", "text", "query_id")

    def run(batches):
        for b in batches:
            raw = [t.encode() for t in b.column(1).to_pylist()]
            s, sets = sketches(raw)
            keys = [k if len(x) else k[:0] for k, x in zip(band_keys(s), sets, strict=True)]
            out = [pa.array(keys, pa.list_(pa.int64())), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *out], ["doc_id", "query_id", "bands", "shingles"])

    made = staged(texts.mapInArrow(run, "doc_id long, query_id long, bands array<long>, shingles binary"))
    banded = lambda df, name: df.select(name, F.posexplode("bands").alias("band", "key"))
    queries = made.where("query_id IS NOT NULL")
    pairs = banded(queries.withColumnRenamed("doc_id", "asked"), "asked").join(banded(made, "doc_id"), ["band", "key"]).where("asked <> doc_id")
    pairs = pairs.select("asked", "doc_id").distinct()

    @F.pandas_udf("double")
    def jaccard(a, b):
        import pandas as pd

        return pd.Series([set_likeness(np.frombuffer(x, U), np.frombuffer(y, U)) for x, y in zip(a, b, strict=True)], dtype=float)

    left = queries.select(F.col("doc_id").alias("asked"), "query_id", F.col("shingles").alias("a"))
    right = made.select("doc_id", F.col("shingles").alias("b"))
    found = pairs.join(left, "asked").join(right, "doc_id").select("query_id", "doc_id", jaccard("a", "b").alias("jaccard"))
    return found.where(F.col("jaccard") >= threshold)


def _cuts(texts: list[str], n: int) -> list[int]:
    """Runs of documents of about a quarter MB."""
    cuts, size = [0], 0
    for i in range(n):
        size += len(texts[i])
        if size > 250_000:
            cuts.append(i + 1)
            size = 0
    return cuts if cuts[-1] == n else [*cuts, n]
