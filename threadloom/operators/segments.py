"""Full-text segments: sorted postings that each ingest adds to, read by terms, merged by size.

A segment has blocks of postings: one for each term and span of SPAN_IDS row ids, with the numbers that
a search needs before it reads the postings themselves. Blocks are sorted by term in slices (folders), of
which a small table tells the first and last term, so a search reads the slices of its terms and
beginnings only. A row that is replaced stays in the older segments; the newer one has its old postings
as removals, which cancel them wherever they are met, in counts as well as in postings. What a batch writes
is as large as the batch; segments of like size are merged, so that there are few.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..archive import Archive, Pointer
from ..functions.text import split, stem
from ..plans.fulltext import Phrase
from ..schema import SEGMENTS
from ..storage import staged

SPAN_IDS = 1024
MERGE_AT = 8  # so many segments of like size become one
PIECE_ROWS = 500  # that a task takes up at once, of however large a batch
SOME_WORDS, MOST_WORDS = 250_000, 1_000_000  # that a task holds when it makes blocks: at the end of a span, and of a row
MOST_TERMS = 200_000  # that a task remembers
SHORT_TEXT, MOST_TEXTS = 100, 100_000  # characters of a text whose terms a task remembers (names come often), and how many
WEIGHTS = (8, 128)  # rows of a block from which on it is dealt with those like it only
POSTINGS = "term string, rowid long, n int, col int, positions array<int>"
HEADS = "term string, span long, removed boolean, n_rows int, words long, top_times int, least_n int, newest long"
PACKED = f"{HEADS}, places array<smallint>, n array<int>, col array<tinyint>, ends array<int>, positions array<int>"


@dataclass(frozen=True)
class Wanted:
    """Terms that a search needs: whole ones and beginnings."""

    whole: frozenset[str]
    begins: tuple[str, ...]

    @classmethod
    def of(cls, phrases: list[Phrase]) -> Wanted:
        whole = {t for p in phrases for t in (p.terms[:-1] if p.prefix else p.terms)}
        return cls(frozenset(whole), tuple(sorted({p.terms[-1] for p in phrases if p.prefix and p.terms})))

    def has(self, term: str) -> bool:
        return term in self.whole or term.startswith(self.begins) if self.begins else term in self.whole

    def condition(self) -> Column:
        c = F.col("term").isin(sorted(self.whole)) if self.whole else F.lit(False)
        for x in self.begins:
            c = c | F.col("term").startswith(x)
        return c

    def in_slice(self) -> Column:
        """Whether terms between first_term and last_term can be wanted."""
        c = F.lit(False)
        for t in sorted(self.whole):
            c = c | ((F.col("first_term") <= t) & (F.col("last_term") >= t))
        for x in self.begins:
            c = c | ((F.col("last_term") >= x) & ((F.col("first_term") <= x) | F.col("first_term").startswith(x)))
        return c


def postings_of(rows: DataFrame, columns: tuple[str, ...], stemmed: bool, wanted: Wanted | None = None, lengths: bool = False) -> DataFrame:
    """POSTINGS of a table of rowid and text columns, all or only the wanted terms'.

    lengths: and for each row one of a null term that has its number of words.
    """
    texts = rows.select("rowid", *(F.coalesce(c, F.lit("")).alias(c) for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}  # of the folded word's term, -1 if it isn't wanted
        terms: dict[str, int] = {}
        for b in (whole.slice(k, PIECE_ROWS) for whole in batches for k in range(0, whole.num_rows, PIECE_ROWS)):
            size = b.num_rows
            if len(number) > 500_000:
                number, terms = {}, {}
            codes: list[int] = []
            counts = np.zeros((size, len(columns)), np.int64)
            column_texts = [b.column(k + 1).to_pylist() for k in range(len(columns))]
            for i in range(size):
                for k in range(len(columns)):
                    own = [w for w in split(column_texts[k][i]) if w]
                    counts[i, k] = len(own)
                    for w in own:
                        if (c := number.get(w)) is None:
                            t = stem(w) if stemmed else w
                            c = number[w] = -1 if wanted is not None and not wanted.has(t) else terms.setdefault(t, len(terms))
                        codes.append(c)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            n = counts.sum(1)
            flat = counts.ravel()
            slot = np.repeat(np.arange(len(flat)), flat)  # row and column of each word
            at = np.arange(len(slot)) - np.repeat(np.cumsum(flat) - flat, flat)
            code = np.array(codes, np.int64)
            keep = np.flatnonzero(code >= 0)
            keep = keep[np.lexsort((at[keep], slot[keep], code[keep]))]
            code, slot, at = code[keep], slot[keep], at[keep]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (slot[1:] != slot[:-1])
            first = np.flatnonzero(new)
            names = list(terms)
            row, column = slot[first] // len(columns), slot[first] % len(columns)
            none = np.zeros(size if lengths else 0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[c] for c in code[first].tolist()] + [None] * len(none), pa.string()),
                    pa.array(np.concatenate([ids[row], ids[: len(none)]])),
                    pa.array(np.concatenate([n[row], n[: len(none)]]).astype(np.int32)),
                    pa.array(np.concatenate([column, none - 1]).astype(np.int32)),
                    pa.ListArray.from_arrays(np.concatenate([first, none + len(at), [len(at)]]).astype(np.int32), pa.array(at.astype(np.int32))),
                ],
                ["term", "rowid", "n", "col", "positions"],
            )

    return texts.mapInArrow(run, POSTINGS)


# ------------------------------------------------------------------ writing


class _Terms(dict):
    """The number of each folded word's term, in the order that they come."""

    def __init__(self):
        self.names: list[str] = []
        self.known: dict[str, int] = {}
        self.texts: dict[str, list[int]] = {}

    def of(self, text: str) -> list[int]:
        """The terms of a text in order."""
        if (own := self.texts.get(text)) is None:
            own = [self[w] for w in split(text) if w]
            if len(text) <= SHORT_TEXT:
                if len(self.texts) >= MOST_TEXTS:
                    self.texts.clear()
                self.texts[text] = own
        return own

    def __missing__(self, word: str) -> int:
        t = stem(word)
        if (k := self.known.get(t)) is None:
            k = self.known[t] = len(self.names)
            self.names.append(t)
        self[word] = k
        return k


class _Held:
    """Rows in order of (removed, span, rowid), of which blocks are made once there are enough words."""

    def __init__(self, ids_a_span: int):
        self.ids_a_span, self.terms = ids_a_span, _Terms()
        self.clear()

    def clear(self) -> None:
        self.codes: list[int] = []
        self.rows: list[tuple[bool, int, int | None, int]] = []  # removed, rowid, at, words
        self.slots: list[tuple[int, int, int]] = []  # row, column, words
        self.told = False  # whether the row at hand is one of the table, not only an upload's text
        self.begun = (0, 0)  # codes and slots before it
        if len(self.terms) > MOST_TERMS:
            self.terms = _Terms()

    def begin(self, removed: bool, rowid: int) -> None:
        self.begun, self.told = (len(self.codes), len(self.slots)), False
        self.rows.append((removed, rowid, None, 0))

    def add(self, texts: list[str | None], at: int | None, told: bool) -> None:
        """More columns of the row at hand."""
        removed, rowid, was, n = self.rows[-1]
        for k, text in enumerate(texts):
            if text and (own := self.terms.of(text)):
                self.codes += own
                self.slots.append((len(self.rows) - 1, k, len(own)))
                n += len(own)
        self.rows[-1] = (removed, rowid, at if was is None else was, n)
        self.told = self.told or told

    def end(self) -> None:
        """The row at hand is complete; texts of a message that there isn't go."""
        if self.rows and not self.told:
            self.rows.pop()
            del self.codes[self.begun[0] :], self.slots[self.begun[1] :]
        self.told = True

    def blocks(self) -> pa.RecordBatch:
        """PACKED blocks of all rows held, which are held no longer."""
        size = len(self.slots)
        of_row, of_column, words = (np.array(self.slots, np.int64).reshape(size, 3).T if size else np.zeros((3, 0), np.int64)).copy()
        code = np.array(self.codes, np.int32)
        removed = np.array([r[0] for r in self.rows], bool)
        rowid, n = (np.array([r[k] for r in self.rows], np.int64) for k in (1, 3))
        at = np.array([np.iinfo(np.int64).min if r[2] is None else r[2] for r in self.rows], np.int64)
        span = rowid // self.ids_a_span
        names = self.terms.names
        self.clear()
        slot = np.repeat(np.arange(size, dtype=np.int32), words)
        place = (np.arange(len(code)) - np.repeat(np.cumsum(words) - words, words)).astype(np.int32)
        by_term = np.argsort(code, kind="stable")  # words come in order of rows, columns and places
        code, slot, place = code[by_term], slot[by_term], place[by_term]
        del by_term
        first = _starts(code, slot)  # of each entry, in code
        ends = np.append(first[1:], len(code))
        term, row, column = code[first], of_row[slot[first]], of_column[slot[first]]
        times = ends - first
        block = _starts(term, span[row], removed[row])  # of each block, in entries
        row_of = _starts(term, row)  # of each row of a block, in entries
        in_block = np.searchsorted(row_of, block)
        add, most, least = np.add.reduceat, np.maximum.reduceat, np.minimum.reduceat
        none = not len(block)
        newest = np.zeros(0, np.int64) if none else most(at[row], block)
        top = np.zeros(0, np.int64) if none else most(add(times, row_of), in_block)
        offsets = np.append(block, len(term))
        lists = lambda kind, values, edges=offsets: pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(values.astype(kind)))
        at_block = np.append(first[block], len(code))
        inside = ends - np.repeat(at_block[:-1], np.diff(offsets))
        columns = [
            pa.array([names[c] for c in term[block].tolist()], pa.string()),
            pa.array(span[row[block]]),
            pa.array(removed[row[block]]),
            pa.array(np.diff(np.append(in_block, len(row_of))).astype(np.int32)),
            pa.array(np.diff(at_block)),
            pa.array(top.astype(np.int32)),
            pa.array((top if none else least(n[row], block)).astype(np.int32)),
            pa.array(newest, mask=newest == np.iinfo(np.int64).min),
            lists(np.int16, (rowid - span * self.ids_a_span)[row]),
            lists(np.int32, n[row]),
            lists(np.int8, column),
            lists(np.int32, inside),
            lists(np.int32, place, at_block),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PACKED.split(", ")])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where any of some columns differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def packed_blocks(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """PACKED blocks of a table of rowid, text columns, time (at), `removed` and `told`, staged.

    A row may come in several, each with some of its columns, of which one at least has to be told: so uploads' texts
    meet their messages here, without a join that would shuffle the texts once more. Texts are shuffled once, by
    span, and postings as whole blocks only. A task holds at most MOST_WORDS words and those of one row; a span of
    more has several blocks of a term, each with rows of its own.
    """
    ids_a_span = SPAN_IDS
    span = F.floor(F.col("rowid") / ids_a_span).alias("_span")
    texts = rows.select(span, "rowid", "removed", "told", F.unix_micros("at").alias("at"), *columns)
    dealt = texts.repartition("_span").sortWithinPartitions("removed", "_span", "rowid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = _Held(ids_a_span), None
        for b in (whole.slice(k, PIECE_ROWS) for whole in batches for k in range(0, whole.num_rows, PIECE_ROWS)):
            spans, ids, removed, told, at, *texts = (c.to_pylist() for c in b.columns)
            for i, key in enumerate(zip(removed, spans, ids, strict=True)):
                if key != last:
                    held.end()
                    if len(held.codes) >= (SOME_WORDS if last is None or key[:2] != last[:2] else MOST_WORDS):
                        yield held.blocks()
                    held.begin(removed[i], ids[i])
                    last = key
                held.add([t[i] for t in texts], at[i], told[i])
        held.end()
        if held.codes:
            yield held.blocks()

    made = dealt.mapInArrow(run, PACKED)
    weight = sum(((F.col("n_rows") >= w).cast("int") for w in WEIGHTS), F.lit(0))
    return staged(made.withColumn("weight", weight), ("weight",), compression="zstd")


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks in ranges of terms and spans. Ranges have like numbers of blocks, so those of few rows and of many are dealt
    apart: else all of the frequent terms' would be in one or two ranges, however many there are."""
    if "weight" not in blocks.columns:
        return blocks.repartitionByRange("term", "span")
    own = [blocks.where(F.col("weight") == w).drop("weight").repartitionByRange("term", "span") for w in range(len(WEIGHTS) + 1)]
    return functools.reduce(DataFrame.unionAll, own)


def _unpacked(blocks: DataFrame) -> DataFrame:
    """Packed blocks with their entries as they are stored."""
    begin = lambda i: F.when(i > 0, F.get("ends", i - 1)).otherwise(0)

    def entry(place: Column, i: Column) -> Column:
        times = F.get("ends", i) - begin(i)
        return F.struct(
            (F.col("span") * SPAN_IDS + place).alias("rowid"), F.get("n", i).alias("n"), F.get("col", i).cast("int").alias("col"),
            times.alias("times"), F.slice("positions", begin(i) + 1, times).alias("positions"),
        )

    own = [c.split()[0] for c in HEADS.split(", ")]
    return blocks.select("slice", *own[:-1], F.timestamp_micros("newest").alias("newest"), F.transform("places", entry).alias("entries"))


def blocks_of(postings: DataFrame) -> DataFrame:
    """Blocks of POSTINGS that say whether they are `removed`, and when their row is from (`at`)."""
    entry = F.struct("rowid", "n", "col", F.size("positions").alias("times"), "positions")
    spanned = postings.withColumn("span", F.floor(F.col("rowid") / SPAN_IDS))
    grouped = spanned.groupBy("term", "span", "removed").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.max("at").alias("newest"), F.sum(F.size("positions")).alias("words")
    )
    state = lambda row, now, most: F.struct(row.alias("row"), now.alias("now"), most.alias("most"))

    def step(s: Column, e: Column) -> Column:
        """A row's entries follow each other, one for each column; their times add up."""
        now = F.when(s["row"] == e["rowid"], s["now"] + e["times"]).otherwise(e["times"])
        return state(e["rowid"], now, F.greatest(s["most"], now))

    total = F.aggregate("entries", state(F.lit(None).cast("long"), F.lit(0), F.lit(0)), step)
    told = grouped.withColumn("_t", total)
    return told.select(
        "term", "span", "removed", F.size(F.array_distinct("entries.rowid")).alias("n_rows"), "words", F.col("_t.most").alias("top_times"), F.array_min("entries.n").alias("least_n"), "newest", "entries"
    )


def write_segment(archive: Archive, kind: str, blocks: DataFrame, rows: int, seq: int, facts: DataFrame | None = None) -> Pointer:
    """The folders of a new segment: `blocks` of the kind (message, topic; packed or not), how many rows more there are, and
    their facts."""
    seg = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
    folder = {t: f"{kind}_{t}/seg={seg}" for t in ("blocks", "slices", "totals", "facts")}
    dealt = _dealt(blocks).withColumn("slice", F.spark_partition_id()).sortWithinPartitions("slice", "term", "span")
    sorted_ = _unpacked(dealt) if "ends" in dealt.columns else dealt
    sorted_.write.partitionBy("slice").option("compression", "zstd").parquet(f"{archive.root}/{folder['blocks']}")
    spark = archive.spark
    read = spark.read.schema(SEGMENTS[f"{kind}_blocks"]).option("basePath", f"{archive.root}/{kind}_blocks").parquet(f"{archive.root}/{folder['blocks']}")
    slices = read.groupBy("slice").agg(F.min("term").alias("first_term"), F.max("term").alias("last_term"))
    slices.coalesce(1).write.parquet(f"{archive.root}/{folder['slices']}")
    signed = lambda c: F.coalesce(F.sum(F.when(F.col("removed"), -F.col(c)).otherwise(F.col(c))), F.lit(0))
    size, removals = F.count("*").alias("size"), F.count_if("removed").alias("removals")
    totals = read.agg(F.lit(rows).cast("long").alias("rows"), signed("words").cast("long").alias("words"), size, removals)
    totals.write.parquet(f"{archive.root}/{folder['totals']}")
    if facts is not None:
        facts.repartitionByRange("rowid").sortWithinPartitions("rowid").write.parquet(f"{archive.root}/{folder['facts']}")
    else:
        del folder["facts"]
    return {path.split("/")[0]: {seg: path} for path in folder.values()}


def next_sequence(archive: Archive) -> int:
    return 1 + max((int(seg[:8]) for t in SEGMENTS for seg in archive.pointer.get(t, {})), default=0)


def merged_postings(flat: DataFrame) -> DataFrame:
    """Of flat entries (with seg, removed, at) of neighbouring segments what is left of them: an entry that a later
    one removes cancels with its removal; removals of entries in older segments stay."""
    own = Window.partitionBy("term", "rowid", "col").orderBy("seg", F.desc("removed"))
    numbered = flat.select("*", F.row_number().over(own).alias("_k"), F.lead("seg").over(own).alias("_next"))
    return numbered.where(F.when(F.col("removed"), F.col("_k") == 1).otherwise(F.col("_next").isNull())).drop("_k", "_next")


def _tier(size: int) -> int:
    """The number of digits to the base MERGE_AT."""
    n = 0
    while size > 0:
        size, n = size // MERGE_AT, n + 1
    return n


def due_for_merge(sizes: list[int]) -> int:
    """How many of the newest segments to merge, by their sizes from old to new (0: none): once MERGE_AT of them are of
    one tier, these and the smaller ones after them. A row is so written again once a tier."""
    tiers = [_tier(s) for s in sizes]
    for t in sorted(set(tiers)):
        n = 0
        while n < len(tiers) and tiers[len(tiers) - 1 - n] <= t:
            n += 1
        if tiers[len(tiers) - n :].count(t) >= MERGE_AT:
            return n
    return 0


def merge_segments(archive: Archive, kind: str) -> Archive:
    """The archive after the merge that is due, if any; the lock is held. Work and bytes are those of the merged ones."""
    told = {r["seg"]: r for r in archive.segments(f"{kind}_totals").collect()}  # a row for each segment
    segs = sorted(told)
    n = due_for_merge([told[s]["size"] for s in segs])
    if n < 2:
        return archive
    some = segs[-n:]
    blocks = archive.segments(f"{kind}_blocks", some)
    flat = blocks.select("seg", "removed", "term", F.col("newest").alias("at"), F.explode("entries").alias("e")).select("seg", "removed", "term", "at", "e.*")
    left = merged_postings(flat)  # an entry counts as being as new as the newest of its block, which keeps bounds bounds
    facts = None
    if f"{kind}_facts" in archive.pointer:
        every = archive.segments(f"{kind}_facts", some)
        last = every.groupBy("rowid").agg(F.max("seg").alias("seg"))
        facts = every.join(last, ["rowid", "seg"], "left_semi").drop("seg")
    added = write_segment(archive, kind, blocks_of(left), sum(told[s]["rows"] for s in some), int(some[-1][:8]), facts)
    return archive.commit({}, locked=True, added=added, dropped=[f"{t}/{s}" for t in SEGMENTS if t.startswith(f"{kind}_") for s in some])


# ------------------------------------------------------------------ reading


class Segments:
    """The stored postings of an archive's messages or topics, as they were when it was opened."""

    def __init__(self, archive: Archive, kind: str):
        self.archive, self.kind = archive, kind
        self._totals: tuple[int, int, int] | None = None
        self._slices: dict[Wanted, dict[str, list[int]]] = {}

    def totals(self) -> tuple[int, int, int]:
        """Rows, words and removals: a row for each segment is read."""
        if self._totals is None:
            found = self.archive.segments(f"{self.kind}_totals").collect()
            self._totals = tuple(sum(r[c] for r in found) for c in ("rows", "words", "removals"))
        return self._totals

    def slices(self, wanted: Wanted) -> dict[str, list[int]]:
        """Of each segment the slices that can have the wanted terms."""
        if wanted not in self._slices:
            own: dict[str, list[int]] = {}
            for r in self.archive.segments(f"{self.kind}_slices").where(wanted.in_slice()).select("seg", "slice").collect():
                own.setdefault(r["seg"], []).append(r["slice"])
            self._slices[wanted] = own
        return self._slices[wanted]

    def blocks(self, wanted: Wanted) -> DataFrame:
        """The blocks of the wanted terms: only folders of the slices that can have them are read."""
        own = self.slices(wanted)
        place = F.lit(False)
        for seg, slices in own.items():
            place = place | ((F.col("seg") == seg) & F.col("slice").isin(sorted(slices)))
        return self.archive.segments(f"{self.kind}_blocks", sorted(own)).where(place).where(wanted.condition())

    def flat(self, blocks: DataFrame, positions: bool) -> DataFrame:
        """seg, term, rowid, n, col, times (and positions) of the blocks' entries that no later segment removes."""
        fields = [f"e.{c}" for c in ("rowid", "n", "col", "times", *(("positions",) if positions else ()))]
        every = blocks.select("seg", "term", "removed", F.explode("entries").alias("e")).select("seg", "term", "removed", *fields)
        if not self.totals()[2]:
            return every.drop("removed")
        own = Window.partitionBy("rowid", "term")
        gone = F.max(F.when(F.col("removed"), F.col("seg"))).over(own)
        live = every.repartition("rowid").withColumn("_gone", gone).where(~F.col("removed") & (F.col("_gone").isNull() | (F.col("seg") >= F.col("_gone"))))
        return live.drop("_gone", "removed")

    def facts(self) -> DataFrame:
        return self.archive.segments(f"{self.kind}_facts").select("rowid", "seg", "at", "stream_id", "topic_id", "sender_id")
