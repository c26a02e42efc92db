"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

The lexicon voters are mined from all labelled rows that aren't held out, in two folds. The label model
of a row sees only voters that the other fold's rows gave, and the given label as one more voter whose
accuracy it has to estimate, so it can tell labels that the texts contradict.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BYTE, Rolling, mixed
from .common import ids_and_texts, materialise, pack, prepare, release, released, unpack
from .minhash import shingles

U = np.uint64
SAMPLE_ROWS = 12_000  # labelled rows that the label model and the classifier are fitted on, at most
FOLDS = 2
GRAMS = (4, 5, 6)  # bytes
BITS = 20
LEVELS = 3
FEATURES = 1 << (BITS + 2)
VOTERS = 400  # lexicon voters of a lexicon, the most telling ones; grams of the same documents are one voter
CHUNKS = 64
FAN_IN = 64
ID_BITS = 1 << 25  # of the bitmap by which unlabelled texts leave early; a full one only lets more pass
LEAST_SUPPORT = 4
LEAST_SHARE = 0.6  # of a voter's documents that are toxic
LEAST_GAIN = 20.0  # log-likelihood ratio of a voter against chance
PATTERNS = ("no lexicon voter", "three lexicon voters", "shouting", "exclamations")

_LOWER = np.full(256, 32, np.uint8)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text leaves 0 modulo 5; rows without an id are never learned from."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def lowered(texts: list[str]) -> list[bytes]:
    """Texts in lower case, letters outside ASCII included."""
    return [t.lower().encode() for t in texts]


def grams(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once: a feature is a hashed gram of the bounds and lower-case letters of a
    word, and in how many distinct words of the document it occurs at least (1 to LEVELS).

    `wanted` marks the hashed grams to be found, all if None.
    """
    found = [np.zeros(0, np.int64)]
    for lo, hi in _runs(texts):
        data = _LOWER[np.frombuffer(b" " + b"  ".join(texts[lo:hi]) + b" ", np.uint8)]
        end = np.cumsum([len(t) + 2 for t in texts[lo:hi]])
        r = Rolling(BYTE[data])
        solid = data != 32
        start = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
        stop = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        doc = np.searchsorted(end, start, side="right")
        word = r.spans(start, stop)
        order = np.lexsort((word, doc))
        new = np.ones(len(order), bool)
        new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        one = np.sort(order[new])
        start, stop, doc = start[one], stop[one], doc[one]
        for n in GRAMS:
            count = np.maximum(stop - start + 3 - n, 0)
            total = np.cumsum(count)
            at = np.repeat(start - 1 - (total - count), count) + np.arange(total[-1] if len(total) else 0)
            h = (r.h[at + n] - r.h[at]) * r.down[at]
            h = ((h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9 + 2 * n) >> U(64 - BITS)).astype(np.int64)
            pair = (np.repeat(doc, count) + lo) << BITS | h
            word_of = np.repeat(np.arange(len(start)), count)
            if wanted is not None:
                pair, word_of = pair[wanted[h]], word_of[wanted[h]]
            # a gram twice in one word counts once
            once = np.lexsort((word_of, pair))
            pair, word_of = pair[once], word_of[once]
            keep = np.ones(len(pair), bool)
            keep[1:] = (pair[1:] != pair[:-1]) | (word_of[1:] != word_of[:-1])
            pair, times = np.unique(pair[keep], return_counts=True)
            for level in range(LEVELS):
                found.append(pair[times > level] << 2 | level)
    feature = np.sort(np.concatenate(found))
    feature = feature[np.concatenate([[True], feature[1:] != feature[:-1]])] if len(feature) else feature
    return feature >> (BITS + 2), feature & ((1 << (BITS + 2)) - 1)


def _runs(texts: list[bytes], size: int = 1 << 18):
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total > size:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def patterns(texts: list[str], lexicon_hits: np.ndarray) -> np.ndarray:
    """The pattern voters' votes."""
    out = np.zeros((len(texts), len(PATTERNS)))
    out[:, 0], out[:, 1] = lexicon_hits == 0, lexicon_hits >= 3
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        upper = int(((data >= 65) & (data <= 90)).sum())
        out[i, 2] = upper > 0.3 * max(len(data), 1)
        out[i, 3] = t.count("!") > 0.01 * len(t)
    return out


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posterior probability of label 1 of each row of a 0/1 vote matrix.

    A generative model by expectation maximisation: each voter fires at a rate of its own for each class. The known label is a voter too, that always votes, with unknown
    rates of being 1 in each class. Silence is evidence too. Correlations of the voters within the classes are
    estimated as well; a voter's evidence is divided by the number of voters that say the same.
    """
    p = 0.1 + 0.8 * known
    weight = np.ones(votes.shape[1])
    for turn in range(rounds):
        before = p
        prior = np.clip(p.mean(), 1e-3, 0.999)
        rate = [(w @ votes + 0.5) / (w.sum() + 1) for w in (1 - p, p)]
        if turn % 4 == 0:
            weight = 1 / _agreement(votes, p, rate)
        fire = np.log(rate[1]) - np.log(rate[0])
        silent = np.log1p(-rate[1]) - np.log1p(-rate[0])
        told = [float((w @ known + 0.5) / (w.sum() + 1)) for w in (1 - p, p)]
        label = np.where(known > 0, np.log(told[1] / told[0]), np.log((1 - told[1]) / (1 - told[0])))
        logit = votes @ (weight * (fire - silent)) + weight @ silent + label + np.log(prior / (1 - prior))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if turn > 8 and np.abs(p - before).max() < 1e-4:
            break
    return p


def _agreement(votes: np.ndarray, p: np.ndarray, rate: list[np.ndarray]) -> np.ndarray:
    """For each voter, the sum of its squared correlations with all voters within the classes."""
    total = np.zeros((votes.shape[1],) * 2)
    for w, r in ((1 - p, rate[0]), (p, rate[1])):
        x = (votes - r) * np.sqrt(w)[:, None]
        cov = x.T @ x / max(w.sum(), 1e-9)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        total += (cov / np.outer(sd, sd)) ** 2 / 2
    np.fill_diagonal(total, 1.0)
    return np.maximum(total.sum(1), 1.0)


def linear_classifier(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (target - s) - penalty * w
        if np.abs(gradient).max() < 1e-6:
            break
        step = np.linalg.solve((x * np.maximum(s * (1 - s), 1e-6)[:, None]).T @ x + np.diag(penalty), gradient)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return w


class Model:
    """A learned scorer: its lexicon voters (hashed grams) and the classifier's weights."""

    def __init__(self, voters: np.ndarray, weights: np.ndarray):
        self.voters, self.weights = voters, weights

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.voters)))
        if len(self.voters):
            wanted = np.zeros(1 << BITS, bool)
            wanted[self.voters >> 2] = True
            doc, gram = grams(lowered(texts), wanted)
            at = np.minimum(np.searchsorted(self.voters, gram), len(self.voters) - 1)
            mine = self.voters[at] == gram
            out[doc[mine], at[mine]] = 1
        return np.hstack([out, patterns(texts, out.sum(1))])

    def score(self, texts: list[str]) -> np.ndarray:
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed doc_ids: whatever their number, the driver gets at most ID_BITS / 64 words."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    word = ids.select(place.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    found = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(ID_BITS // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic and fold of the labelled rows that aren't held out, one of each family of copies.

    A family shares its least five-word shingle; of its rows of one label the one of the least id (then
    text) stays. Folds are of families. Which rows stay doesn't depend on the partitioning. Texts whose
    hashed id has no label leave before the shuffle.
    """
    spark = docs.sparkSession
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    usable = own.where(F.col("toxic").isin(0, 1) & (F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 != 0))
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sent = spark.sparkContext.broadcast(np.packbits(_bits(one)))  # ID_BITS / 8 bytes

    def family(batches):
        known = sent.value
        for b in batches:
            at = b.column(2).to_numpy()
            b = b.filter(pa.array((known[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            least = []
            raw = [t.encode() for t in b.column(1).to_pylist()]
            for lo, hi in _runs(raw, 1 << 20):
                h, at = shingles(raw[lo:hi])
                least += [int(h[x:y].min() >> U(1)) if y > x else 0 for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(least, pa.int64())], ["doc_id", "text", "family"])
        release()

    texts = ids_and_texts(docs).where("doc_id IS NOT NULL").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS)))
    known = texts.mapInArrow(family, "doc_id long, text string, family long").join(one.hint("merge"), "doc_id")
    kept = known.groupBy("family", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    fold = F.pmod(F.xxhash64("family"), F.lit(FOLDS)).cast("int").alias("fold")
    return materialise(kept.select("row.doc_id", "row.text", "toxic", fold))


def _count(rows: DataFrame) -> DataFrame:
    """gram, clean and toxic of each fold (n0, n1, ...) and `documents` (a sum of hashes of its documents) of the
    frequent features.

    A task sums its rows in arrays of fixed size, which leave it slice by slice (all at once they would be held three times
    over, and once more by the executor) and are then added up by CHUNKS slices, FAN_IN at a time.
    """
    kinds = {f"n{i}": np.int32 for i in range(2 * FOLDS)} | {"documents": np.uint16}

    def count(batches):
        n = np.zeros((2 * FOLDS, FEATURES), np.int32)
        where = np.zeros(FEATURES, np.uint16)
        any_ = False
        for b in batches:
            own, group = b.column(0).to_numpy().astype(U), 2 * b.column(3).to_numpy() + b.column(2).to_numpy()
            name = mixed(own + U(1)).astype(np.uint16)
            texts = lowered(b.column(1).to_pylist())
            for lo, hi in _runs(texts):  # the features of a whole batch would take too much memory
                doc, gram = grams(texts[lo:hi])
                if not len(doc):
                    continue
                any_ = True
                order = np.argsort(gram, kind="stable")
                doc, gram = doc[order] + lo, gram[order]
                head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                where[gram[head]] += np.add.reduceat(name[doc], head)
                for i in range(2 * FOLDS):
                    n[i, gram[head]] += np.add.reduceat((group[doc] == i).astype(np.int32), head)
        if any_:
            part = TaskContext.get().partitionId()
            for k in range(CHUNKS):
                own = slice(k * FEATURES // CHUNKS, (k + 1) * FEATURES // CHUNKS)
                packed = [pa.array([pack(x[own])], pa.binary()) for x in (*n, where)]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), *packed], ["part", "chunk", *kinds])
        del n, where
        release()

    def total(t: pa.Table) -> list[np.ndarray]:
        out = []
        for c, kind in kinds.items():
            out.append(np.zeros(FEATURES // CHUNKS, kind))
            for x in t.column(c):
                out[-1] += unpack(x.as_py(), kind)
        return out

    def add(t: pa.Table) -> pa.Table:
        own = {"part": pa.array([t.column("part")[0].as_py() // FAN_IN], pa.int32()), "chunk": pa.array([t.column("chunk")[0].as_py()], pa.int32())}
        return pa.table(own | {c: pa.array([pack(x)], pa.binary()) for c, x in zip(kinds, total(t), strict=True)})

    def frequent(t: pa.Table) -> pa.Table:
        *n, where = (x.astype(np.int64) for x in total(t))
        clean, toxic = sum(n[0::2]), sum(n[1::2])
        keep = np.flatnonzero((toxic >= LEAST_SUPPORT) & (toxic >= LEAST_SHARE / 2 * (toxic + clean)))
        base = t.column("chunk")[0].as_py() * (FEATURES // CHUNKS)
        return pa.table({"gram": keep + base} | {c: x[keep] for c, x in zip(kinds, (*n, where), strict=True)})

    schema = "part int, chunk int, " + ", ".join(f"{c} binary" for c in kinds)
    made = rows.mapInArrow(count, schema)
    tasks = rows.rdd.getNumPartitions()
    while tasks > FAN_IN:
        made = made.groupBy("chunk", F.floor(F.col("part") / FAN_IN).alias("to")).applyInArrow(released(add), schema)
        tasks = -(-tasks // FAN_IN)
    return made.groupBy("chunk").applyInArrow(released(frequent), "gram long, " + ", ".join(f"{c} long" for c in kinds))


def _lexicon(counted: DataFrame, folds: list[int], share: float) -> np.ndarray:
    """Features whose documents in these folds are mostly toxic: the most telling ones, at most VOTERS, sorted.

    Of features that occur in the very same documents one is enough.
    """
    clean, toxic = (sum((F.col(f"n{2 * f + k}") for f in folds), F.lit(0)) for k in (0, 1))
    n = clean + toxic
    part = F.greatest(clean, F.lit(1e-9))
    gain = 2 * (toxic * F.log(toxic / (n * share)) + part * F.log(part / (n * (1 - share))))
    able = counted.where((toxic >= LEAST_SUPPORT) & (toxic >= LEAST_SHARE * n)).withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
    each = able.groupBy(*(c for c in counted.columns if c != "gram")).agg(F.min("gram").alias("gram"), F.max("gain").alias("gain"))
    return np.array(sorted(r["gram"] for r in each.orderBy(F.desc("gain"), "gram").limit(VOTERS).collect()), np.int64)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits voters (on all labelled rows not held out), label model and classifier (on a bounded sample of them)."""
    prepare(docs.sparkSession)
    rows = _learnable(docs, labels)
    share = float(np.clip(rows.agg(F.avg("toxic")).first()[0] or 0.5, 0.01, 0.99))
    counted = materialise(_count(rows))
    every = list(range(FOLDS))
    model = Model(_lexicon(counted, every, share), np.zeros(1))
    others = [_lexicon(counted, [g for g in every if g != f], share) for f in every]
    voters = np.unique(np.concatenate([model.voters, *others]))
    sent = docs.sparkSession.sparkContext.broadcast(Model(voters, np.zeros(1)))  # at most 3 VOTERS grams

    def votes(batches):
        for b in batches:
            x = sent.value.features(b.column(1).to_pylist())
            fired = pa.array([np.flatnonzero(r) for r in x], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), fired], ["doc_id", "toxic", "fold", "fired"])
        release()

    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE_ROWS)
    voted = sample.mapInArrow(votes, "doc_id long, toxic int, fold int, fired array<int>").collect()
    voted.sort(key=lambda r: (r["doc_id"], r["toxic"]))  # sums in one order, so that scores are always the same
    x = np.zeros((len(voted), len(voters) + len(PATTERNS)))
    for i, r in enumerate(voted):
        x[i, r["fired"]] = 1
    known = np.array([r["toxic"] for r in voted], float)
    fold = np.array([r["fold"] for r in voted])

    def seen(lexicon: np.ndarray) -> np.ndarray:
        """Votes of this lexicon and of the patterns that go with it."""
        own = x[:, np.searchsorted(voters, lexicon)]
        hits = own.sum(1)
        shared = x[:, len(voters) :].copy()
        shared[:, 0], shared[:, 1] = hits == 0, hits >= 3
        return np.hstack([own, shared])

    mine = seen(model.voters)
    if not len(voted) or known.min() == known.max():  # nothing to tell apart
        model.weights = np.append(np.zeros(mine.shape[1]), 8.0 if len(voted) and known.max() == 1 else -8.0)
        return model
    target = known.copy()
    for f, lexicon in enumerate(others):
        if (fold == f).any():
            target[fold == f] = label_model(seen(lexicon)[fold == f], known[fold == f])
    model.weights = linear_classifier(mine, target)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; see score_documents."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most VOTERS grams and weights

    def run(batches):
        for b in batches:
            s = sent.value.score(b.column(1).to_pylist())
            out = [pa.array([held_out(d) for d in b.column(0).to_pylist()]), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], ["doc_id", "held_out", "score", "predicted"])
        release()

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5) of every row.

    Scores depend on texts alone, and don't on the partitioning. Lexicon voters are hashed grams mined from the
    learning rows, joined by pattern voters; the label model's posteriors train the classifier that scores. Null or empty
    texts are scored like texts in which no voter fires. A null doc_id stays null and counts as held
    out. Labels that are null, not 0 or 1, or without a document are ignored; of several for one id the
    greatest counts. Without both labels to learn from, all rows get one score. Repeated rows give
    repeated rows; empty tables an empty table; other columns are ignored.
    """
    return score(docs, learn(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, all columns as they are.

    Null and empty texts are scored as texts without voters, rows without an id like others; repeated rows
    stay or go together, and an empty table stays empty. Labels are those of score_documents.

    The scorer runs where the rows are, so nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        low = pd.Series(sent.value.score([t or "" for t in texts]) < 0.5)
        release()
        return low

    return docs.where(clean(docs["text"].cast("string")))
