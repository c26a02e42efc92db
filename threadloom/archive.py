"""An archive: named tables, each version of a table (or of a part of one) a folder of Parquet behind one pointer file."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .deploy import ship
from .schema import DERIVED, GONE, SCHEMAS, SEGMENTS
from .sources.lock import SharedLock, WriterLock

#: tables kept in parts, by the message id in this column
PARTED = {
    "messages": "id", "message_mentions": "message_id", "message_attachments": "message_id",
    "part_rollups": "first_message_id",
}
#: which rows of older layers are gone, by the table that says so and the column that it names them by
GONE_BY = {
    "messages": ("message_gone", "id"), "message_mentions": ("message_gone", "message_id"),
    "message_attachments": ("message_gone", "message_id"), "part_rollups": ("rollup_gone", "topic_id"),
}
PART_IDS = 1 << 20
LAYER = "_layer"
KEEP_SECONDS = 24 * 3600
WHOLE = "*"
Pointer = dict[str, dict[str, str]]  # table -> part, or part+layer -> folder


class ConflictError(RuntimeError):
    """The archive was changed since it was opened."""


def part_of(column: str):
    return F.floor(F.col(column) / PART_IDS)


def _place(key: str) -> tuple[int, int]:
    """Part and layer of a key of the pointer."""
    part, _, layer = key.partition("+")
    return int(part), int(layer or 0)


def _key(part: int | str, layer: int) -> str:
    return f"{part}+{layer}" if layer else str(part)


class Archive:
    """Tables as DataFrames; `root` is the folder they are kept in, if any.

    A write makes new folders and then swaps the pointer file, so readers see the whole old state or
    the whole new one, and a run that fails in between leaves the old one. Messages and their children
    are kept in parts of 2^20 ids. A write may replace some parts, or lay rows on top of them: a part then has
    layers, and a small table of removals names the rows of older layers that a newer one replaces. Readers
    leave these out by an anti-join of the parts that have removals; the others are read as they are. `compact`
    makes layers of like size one. Folders
    that neither the present state nor the one before it names are removed once they are KEEP_SECONDS old,
    so that long readers can end.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], root: str | None = None, pointer: Pointer | None = None):
        self.spark, self.root, self.pointer = spark, root, pointer or {}
        self.tables = {n: _shaped(spark, n, tables.get(n)) for n in SCHEMAS}
        self.tables |= {n: _shaped(spark, n, tables[n]) for n in DERIVED if n in tables}

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Archive:
        """The archive's present state; a new folder is an empty archive, with empty indexes."""
        ship(spark)
        pointer = _Store(spark, root).read()
        tables = {n: _live(spark, root, n, pointer, p) for n, p in pointer.items() if p and n in SCHEMAS | DERIVED}
        if not pointer.get("messages"):
            tables |= {n: _shaped(spark, n, None) for n in DERIVED}
        # what some part of the messages lacks yet is as if there were none
        partial = [n for n in DERIVED if not _parts(pointer, "messages") <= _parts(pointer, n)]
        tables = {n: df for n, df in tables.items() if n not in partial}
        return cls(spark, tables, root, pointer)

    def parts(self, table: str) -> list[int]:
        """The parts there are of a table that is kept in parts."""
        return sorted(_parts(self.pointer, table))

    def has(self, *derived: str) -> bool:
        """Whether these derived tables are kept."""
        return all(n in self.tables for n in derived)

    @property
    def indexed(self) -> bool:
        """Whether there are full-text segments, or nothing yet that they would index."""
        return self.root is not None and (not self.pointer.get("messages") or "message_totals" in self.pointer)

    def segments(self, table: str, only: Sequence[str] | None = None) -> DataFrame:
        """A table of the full-text segments (or of some of them), by one folder for each segment."""
        folders = [f for seg, f in sorted(self.pointer.get(table, {}).items()) if only is None or seg in only]
        if not folders:
            return self.spark.createDataFrame([], SEGMENTS[table])
        read = self.spark.read.option("basePath", f"{self.root}/{table}").schema(SEGMENTS[table])
        return read.parquet(*(f"{self.root}/{f}" for f in folders))

    def some_parts(self, table: str, parts: Sequence[int], other: bool = False) -> DataFrame:
        """The rows of these parts of a table kept in parts (or of all others); only their folders are read."""
        if self.root is None:
            inside = part_of(PARTED[table]).isin([int(p) for p in parts])
            return self.tables[table].where(~inside if other else inside)
        own = {int(p) for p in parts}
        keys = [k for k in self.pointer.get(table, {}) if (_place(k)[0] in own) != other]
        return _shaped(self.spark, table, _live(self.spark, self.root, table, self.pointer, keys) if keys else None)

    def commit(
        self, changed: dict[str, DataFrame], parts: Sequence[int] | None = None, locked: bool = False,
        added: Pointer | None = None, dropped: Sequence[str] = (), gone: dict[str, DataFrame] | None = None,
    ) -> Archive:
        """Writes new versions of tables and swaps the pointer, under the writer lock.

        parts: of tables kept in parts, `changed` has all rows of these parts, and the others stay.
        gone: of tables kept in parts, `changed` has rows to lay on top, and these removals (part, id) say which older
        ones they replace, by tables of schema.GONE.
        added: folders of new full-text segments or layers, already written; dropped: "table/key" of those that go.
        ConflictError if another write came in between.
        """
        if self.root is None:
            raise ValueError("this archive has no folder")
        store = _Store(self.spark, self.root)
        lock = None if locked else store.lock().acquire()
        try:
            if store.read() != self.pointer:
                raise ConflictError(self.root)
            new = {n: dict(p) for n, p in self.pointer.items()}
            # a part that is replaced is as new as the newest layer, so that no removal so far is about it
            layer = _newest(self.pointer) + (gone is not None)
            for name, df in (gone or {}).items():
                new[name] = new.get(name, {}) | self._put(store, name, df, layer)
            for name, df in changed.items():
                folder = f"{name}/{uuid.uuid4().hex}"
                rows = _shaped(self.spark, name, df)
                if name not in PARTED:
                    rows.write.parquet(f"{self.root}/{folder}")
                    new[name] = {WHOLE: folder}
                    continue
                made = self._put(store, name, rows, layer)
                if gone is not None:
                    new[name] = new.get(name, {}) | made
                    continue
                new[name] = _but(new.get(name, {}), parts) | made
            for name in GONE if gone is None else ():
                if all(t in changed for t, (by, _) in GONE_BY.items() if by == name):
                    new[name] = _but(new.get(name, {}), parts)
            for old in dropped:
                table, seg = old.split("/")
                new.get(table, {}).pop(seg, None)
            for name, own in (added or {}).items():
                new[name] = new.get(name, {}) | own
            store.check_lock()
            store.write(new)
            store.clear({f for pointer in (self.pointer, new) for p in pointer.values() for f in p.values()})
        finally:
            if lock:
                lock.release()
        return Archive.open(self.spark, self.root)

    def _put(self, store: _Store, name: str, rows: DataFrame, layer: int) -> dict[str, str]:
        """Rows of a table kept in parts written as this layer, in order of ids: the folder of each part."""
        folder = f"{name}/{uuid.uuid4().hex}"
        if name in GONE:
            rows, order = rows.select("part", F.lit(layer).cast("long").alias("layer"), "id"), "id"
            rows = rows.withColumn("of", F.col("part"))
        else:
            order = PARTED[name]
            rows = rows.withColumn(LAYER, F.lit(layer).cast("long")).withColumn("of", part_of(order))
        rows.sortWithinPartitions("of", order).withColumnRenamed("of", "part_").write.option("compression", "zstd").partitionBy("part_").parquet(f"{self.root}/{folder}")
        return {_key(x.removeprefix("part_="), layer): f"{folder}/{x}" for x in store.names(folder) if x.startswith("part_=")}

    def compact(self, parts: Sequence[int], due: Callable[[list[int]], int]) -> Archive:
        """The archive with newest layers of these parts made one where that is due; the writer lock is held.

        due: of the sizes in bytes of a part's layers, from old to new, how many of the newest to merge (below 2:
        none). Rows that newer ones of them replace go; removals go once no older layer is left that they are about.
        """
        store, archive = _Store(self.spark, self.root), self
        for by in GONE:
            tables = [t for t in PARTED if GONE_BY[t][0] == by]
            added: Pointer = {}
            dropped: list[str] = []
            for part in parts:
                own = sorted((_place(k)[1], f) for k, f in archive.pointer.get(tables[0], {}).items() if _place(k)[0] == part)
                n = due([store.size(f) for _, f in own])
                if n < 2:
                    continue
                whole, newest = n == len(own), _newest(archive.pointer)
                inside = lambda t: [k for k in archive.pointer.get(t, {}) if _place(k)[0] == part and (whole or _place(k)[1] >= own[-n][0])]  # noqa: B023, E731
                for t in (*tables, by):
                    if not (keys := inside(t)):
                        continue
                    dropped += [f"{t}/{k}" for k in keys]
                    if t != by:
                        rows = _shaped(self.spark, t, _live(self.spark, self.root, t, archive.pointer, keys))
                    elif whole:
                        continue
                    else:
                        rows = self.spark.read.schema(GONE[by]).parquet(*(f"{self.root}/{archive.pointer[by][k]}" for k in keys))
                        rows = rows.select("part", "id").distinct()
                    added[t] = added.get(t, {}) | archive._put(store, t, rows, newest)
            if dropped:
                archive = archive.commit({}, locked=True, added=added, dropped=dropped)
        return archive

    def register(self, prefix: str = "") -> None:
        """Every table as a temporary view."""
        for n in SCHEMAS:
            self.tables[n].createOrReplaceTempView(prefix + n)

    def sql(self, query: str, **views: DataFrame) -> DataFrame:
        """Any query over the tables, and over more tables under names of one's own (say, a search's hits).

        Views can't be written, so this reads only."""
        first = query.lstrip(" \t\r\n(").split(None, 1)
        if not first or first[0].upper() not in ("SELECT", "WITH", "VALUES", "FROM", "EXPLAIN", "DESCRIBE", "SHOW"):
            raise ValueError("only queries are taken")
        self.register()
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(query)

    def check(self) -> dict[str, bool]:
        """Whether each table can be read: a row of all its columns."""
        return {n: _readable(self.tables[n]) for n in SCHEMAS}

    def size_in_bytes(self) -> int:
        if self.root is None:
            return 0
        store = _Store(self.spark, self.root)
        return sum(store.size(f) for p in self.pointer.values() for f in p.values())

    def lock(self) -> WriterLock | SharedLock:
        return _Store(self.spark, self.root).lock()


class _Store:
    """The pointer file and folders, by the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self) -> Pointer:
        file = self._path("tables.json")
        if not self.fs.exists(file):
            return {}
        stream = self.fs.open(file)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, pointer: Pointer) -> None:
        """A new file takes the old one's place in one step."""
        fresh, file = self._path(f"tables.{uuid.uuid4().hex}"), self._path("tables.json")
        out = self.fs.create(fresh, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        qualified = self.fs.makeQualified(file)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.conf)
        context.rename(self.fs.makeQualified(fresh), qualified, how)

    def clear(self, keep: set[str]) -> None:
        """Removes old table folders (and parts in them) that `keep` doesn't name."""
        whole = {"/".join(f.split("/")[:2]) for f in keep}
        old = 1000 * (time.time() - KEEP_SECONDS)
        made = lambda f: self.fs.getFileStatus(self._path(f)).getModificationTime()
        for table in (*SCHEMAS, *DERIVED, *GONE, *SEGMENTS):
            if not self.fs.exists(self._path(table)):
                continue
            for folder in (f"{table}/{x}" for x in self.names(table)):
                if made(folder) > old:
                    continue
                if folder not in whole:
                    self.fs.delete(self._path(folder), True)
                    continue
                for part in (f"{folder}/{x}" for x in self.names(folder) if x.startswith(("part=", "part_="))):
                    if part not in keep:
                        self.fs.delete(self._path(part), True)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))]

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self._path(folder)).getLength()

    def check_lock(self) -> None:
        """Refuses a writer whose lease on a shared file system was taken over while it wrote."""
        if own := SharedLock.held.get(self._path("writer.lock").toString()):
            own.check()

    def lock(self) -> WriterLock | SharedLock:
        """Beside the tables: an advisory lock if these are in local files, else a file that only one can create."""
        if self.fs.getScheme() == "file":
            return WriterLock(Path(self._path("").toUri().getPath(), "writer.lock"))
        return SharedLock(self.fs, self._path("writer.lock"))


def _readable(df: DataFrame) -> bool:
    try:
        df.limit(1).collect()
    except Exception:  # whatever keeps Spark from reading it
        return False
    return True


def _parts(pointer: Pointer, table: str) -> set[int]:
    return {_place(k)[0] for k in pointer.get(table, {})}


def _newest(pointer: Pointer) -> int:
    return max((_place(k)[1] for t in (*PARTED, *GONE) for k in pointer.get(t, {})), default=0)


def _but(own: dict[str, str], parts: Sequence[int] | None) -> dict[str, str]:
    """What stays of a table's folders if these parts (None: all) are replaced."""
    replaced = set(parts or ())
    return {} if parts is None else {k: f for k, f in own.items() if _place(k)[0] not in replaced}


def _read(spark: SparkSession, root: str, name: str, folders: list[str], layer: bool = False) -> DataFrame:
    """Folders of any version of a table; columns that an older one lacks are null."""
    schema = (SCHEMAS | DERIVED)[name]
    if layer:
        schema = StructType([*schema.fields, StructField(LAYER, LongType())])
    return spark.read.schema(schema).parquet(*(f"{root}/{f}" for f in folders))


def _live(spark: SparkSession, root: str, name: str, pointer: Pointer, keys: Iterable[str]) -> DataFrame:
    """The rows of these layers that no newer layer replaces; parts without removals are read as they are."""
    own = pointer[name]
    if name not in GONE_BY:
        return _read(spark, root, name, [own[k] for k in keys])
    by, key = GONE_BY[name]
    hit = _parts(pointer, by)
    plain, over = ([own[k] for k in keys if (_place(k)[0] in hit) == x] for x in (False, True))
    if not over:
        return _read(spark, root, name, plain)
    parts = {_place(k)[0] for k in keys}
    gone = spark.read.schema(GONE[by]).parquet(*(f"{root}/{f}" for k, f in pointer[by].items() if _place(k)[0] in parts))
    gone = gone.select(*(F.col(c).alias(f"_gone_{c}") for c in gone.columns))
    same = (F.col(key) == F.col("_gone_id")) & (part_of(PARTED[name]) == F.col("_gone_part"))
    older = F.coalesce(LAYER, F.lit(0)) < F.col("_gone_layer")
    rows = _read(spark, root, name, over, layer=True).join(gone, same & older, "left_anti").drop(LAYER)
    return rows.unionByName(_read(spark, root, name, plain)) if plain else rows


def _shaped(spark: SparkSession, name: str, df: DataFrame | None) -> DataFrame:
    """The table's columns in order; ones that are missing are null."""
    schema = (SCHEMAS | DERIVED)[name]
    if df is None:  # known to be empty when queries are planned, so that joins with it go
        return spark.range(0).where("false").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
    have = set(df.columns)
    return df.select(
        *(
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )
