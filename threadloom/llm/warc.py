"""WARC archives: written by tasks, one gzip member for each record, and read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import fresh_folder
from .common import materialise, prepare

SPLIT_BYTES = 16 << 20
FILE_BYTES = 1 << 30
CHUNK = 1 << 20
PROBE = 64 << 10  # of a candidate member, read to see whether it begins a record
# fixed values of the formats
MAGIC = b"\x1f\x8b\x08"
GZIP = 31  # zlib's window bits for a gzip member
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

FILES = "path string, size long, records long"
RECORDS = (
    "path string, range_start long, start long, stop long, record_id string, record_type string, target_uri string, record_date string,"
    " refers_to string, payload_digest string, payload_bytes long, digest_holds boolean, payload binary"
)
VISIBLE = "".join(map(chr, range(33, 127)))
DAMAGED = "damaged"  # the type of a row that stands for bytes that aren't a record


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def opened(place: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a local path or a URI."""
    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)


# ------------------------------------------------------------------ writing


def record(kind: str, record_id: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    """One record as a gzip member of its own."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, holder: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit of the holder's, which keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = quote(url or "", safe=VISIBLE)
    headers = [("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if target:
        headers.append(("WARC-Target-URI", target))
    if holder is None:
        return record("response", record_name(page_id), http + payload, headers)
    return record("revisit", record_name(page_id), http, [*headers, ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_name(holder))])


def with_holders(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and holder: the largest page_id of an equal payload, null if that is the page's own.

    Payloads are compared by their SHA-256. Pages that revisit another are found by narrow rows of id and hash;
    the payloads are shuffled once, by hash and id, so that a hot payload is spread by its pages.
    """
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("h", F.unhex(F.sha2("payload", 256)))
    ids = materialise(rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "h"))
    groups = ids.groupBy("h").agg(F.max("page_id").alias("holder"), F.min("page_id").alias("_least"), F.count(F.lit(1)).alias("_n"), F.count("page_id").alias("_known"))
    shared = groups.where("holder IS NOT NULL AND (_least < holder OR _known < _n)").select("h", "holder")
    revisits = ids.distinct().join(shared.hint("merge"), "h").where("page_id IS NULL OR page_id < holder")
    # pages without an id meet by their hash alone
    key = lambda df, *more: df.select(F.col("h").alias("_h"), F.coalesce("page_id", F.lit(-1).cast("long")).alias("_id"), F.col("page_id").isNull().alias("_none"), *more)
    right = key(revisits, "holder").hint("shuffle_hash")
    same = (F.col("h") == F.col("_h")) & (F.coalesce("page_id", F.lit(-1).cast("long")) == F.col("_id")) & (F.col("page_id").isNull() == F.col("_none"))
    return rows.join(right, same, "left").select("page_id", "url", "payload", "holder")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages as records in .warc.gz files below `folder`, which all executors share; the files (FILES) are returned.

    Each task writes files of its own under new names. A file counts only if it is in the table returned, which
    has those of one attempt of each task; what a lost attempt left behind is in no table.
    Of equal payloads of at least `least_bytes` the page with the largest page_id is a response, the others
    revisit it. Null html: empty. Repeated rows of one id are records each, of the same kind. Pages without an
    id revisit an equal one that has an id, else they are responses. An empty table makes no file.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        out, path, size, count = None, "", 0, 0
        done = []
        for b in batches:
            for page_id, url, payload, holder in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(path, compression=None)  # records are compressed one by one
                    head = record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"format: WARC File Format 1.0\r\n", [("WARC-Date", date), ("Content-Type", "application/warc-fields")])
                    out.write(head)
                    size, count = len(head), 1
                data = page_record(page_id, url, payload, holder, date)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, count))
        for path, size, count in done:
            yield pa.RecordBatch.from_pylist([{"path": f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}", "size": size, "records": count}], pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return materialise(with_holders(pages, least_bytes).mapInArrow(run, FILES))


# ------------------------------------------------------------------ reading


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of all .warc.gz files below a folder; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select("path", F.col("length").alias("size"))


def byte_ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    """path, size, range_start, range_stop and known (null: not known): the files cut into ranges."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    cut = files.where("size > 0").select("path", "size", starts.alias("range_start"))
    return cut.withColumn("range_stop", F.least(F.col("range_start") + split_bytes, "size")).withColumn("known", F.lit(None).cast("long"))


class Member:
    """One gzip member, inflated as it is read."""

    def __init__(self, file, start: int):
        self.file, self.at = file, start
        self.inflate = zlib.decompressobj(GZIP)

    def read(self, least: int | None = None) -> bytes:
        """Inflated bytes: some `least` or more while there are any (all, if None)."""
        out, have = [], 0
        while not self.inflate.eof and (least is None or have < least):
            self.file.seek(self.at)
            data = self.file.read(PROBE if least is not None else CHUNK)
            if not data:
                raise zlib.error("the member is cut short")
            got = self.inflate.decompress(data)
            self.at += len(data) - len(self.inflate.unused_data)
            out.append(got)
            have += len(got)
        return b"".join(out)


def headers_of(head: bytes) -> dict[str, str]:
    """Lower-case names and values of header lines; the first line isn't one."""
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def begins_record(file, at: int) -> bool:
    """Whether a gzip member at this place begins with the headers of a record."""
    try:
        head = Member(file, at).read(12)
        if not head.startswith(b"WARC/1.") and not head.startswith(b"WARC/0."):
            return False
        m = Member(file, at)
        head = m.read(PROBE)
        while b"\r\n\r\n" not in head and not m.inflate.eof and len(head) < CHUNK:
            head += m.read(PROBE)
    except zlib.error:
        return False
    found = headers_of(head.partition(b"\r\n\r\n")[0])
    return b"\r\n\r\n" in head and "warc-type" in found and found.get("content-length", "").isdigit()


def next_member(file, at: int, stop: int) -> int | None:
    """The first place from `at` on and before `stop` where a record's member begins."""
    while at < stop:
        file.seek(at)
        data = file.read(CHUNK + len(MAGIC) - 1)
        i = data.find(MAGIC)
        while i >= 0 and at + i < stop:
            if begins_record(file, at + i):
                return at + i
            i = data.find(MAGIC, i + 1)
        if len(data) < CHUNK + len(MAGIC) - 1:
            return None
        at += CHUNK
    return None


def parse_record(data: bytes, want_payload: bool) -> tuple:
    """What RECORDS has of an inflated member after its place."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    h = headers_of(head)
    size = int(h["content-length"]) if h.get("content-length", "").isdigit() else -1
    if not mark or not head.startswith(b"WARC/") or size < 0 or len(rest) < size:
        raise zlib.error("the member isn't a record")
    block, kind = rest[:size], h.get("warc-type", "")
    told, length, holds, payload = h.get("warc-payload-digest"), size, None, block
    if h.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if kind == "revisit":
            own = headers_of(http).get("content-length", "")
            length = int(own) if own.isdigit() else None
    if kind != "revisit":
        digest = base32_sha1(payload)
        holds = told in (None, f"sha1:{digest}") or not told.startswith("sha1:")
        told = told or f"sha1:{digest}"
    return (
        h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), told,
        length, holds, payload if want_payload else None,
    )


def records_in_range(file, size: int, start: int, stop: int, known: int | None, want_payload: bool) -> Iterator[tuple]:
    """(start, stop, ...) of the records that start in a range. Where a record can't be read, a DAMAGED row up to
    the next one that can."""
    at = known if known is not None else start if start == 0 else next_member(file, start, stop)
    while at is not None and at < stop:
        m = Member(file, at)
        try:
            row = parse_record(m.read(), want_payload)
            end = m.at
        except zlib.error:
            end = next_member(file, at + 1, size) or size
            row = (None, DAMAGED, None, None, None, None, end - at, None, None)
        yield at, end, *row
        at = end


def _read_ranges(ranges: DataFrame, want_payload: bool) -> DataFrame:
    spark = ranges.sparkSession
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, RECORDS.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                system, path = opened(r["path"])
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for x in records_in_range(file, r["size"], r["range_start"], r["range_stop"], r["known"], want_payload):
                        rows.append(dict(zip(names, (r["path"], r["range_start"], *x), strict=True)))
                        held += len(x[-1] or b"")
                        if len(rows) >= 1000 or held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = ranges.count()  # the tasks' number; rows of a path and two numbers
    tasks = max(spark.sparkContext.defaultParallelism, n // 4)
    return ranges.select("path", "size", "range_start", "range_stop", "known").repartition(tasks).mapInArrow(run, RECORDS)


def disagreeing_ranges(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    """Ranges whose first record doesn't begin where the records before it ended, with that place as `known`; also
    the range where a file's records end too early. One row for each range of a file comes together."""
    ends = rows.groupBy("path", "range_start").agg(F.min("start").alias("first"), F.max("stop").alias("end"))
    file = Window.partitionBy("path").orderBy("range_start")
    every = ranges.select("path", "size", "range_start", "range_stop").join(ends, ["path", "range_start"], "left")
    due = F.coalesce(F.max("end").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = every.withColumn("due", due).where("due >= range_start")  # else an earlier range lacks records
    here = F.col("due") < F.col("range_stop")
    wrong = F.when(here, ~F.col("first").eqNullSafe(F.col("due"))).otherwise(F.col("first").isNotNull())
    return told.where(wrong).select("path", "size", "range_start", "range_stop", F.col("due").alias("known"))


def read_archives(files: DataFrame, want_payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """RECORDS of all records in gzip'd WARC files (path, size), staged.

    Tasks read byte ranges: they look for gzip magic, take a candidate as a member if it inflates to a record's
    headers, and own the records that start in their range. That is a guess for each range's first record
    only (a payload may hold an archive itself), so the ranges of a file are compared: where one doesn't begin
    where the records before it ended, it is read again from there, until all agree. Bytes that are no record
    become a row of type DAMAGED. Empty files and tables give no rows.
    """
    prepare(files.sparkSession)
    ranges = materialise(byte_ranges(files, split_bytes))
    rows = materialise(_read_ranges(ranges, want_payload))
    while not (again := materialise(disagreeing_ranges(ranges, rows))).isEmpty():
        right = rows.join(again.select("path", "range_start"), ["path", "range_start"], "left_anti").select(*rows.columns)
        rows = materialise(right.unionByName(_read_ranges(again, want_payload)))
    return rows


def archived_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, written as archives and read back."""
    files = write_archives(pages, fresh_folder(pages.sparkSession), least_bytes)
    rows = read_archives(files, want_payload=False).where("record_type <> 'warcinfo'")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    whole = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return rows.select(
        whole("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type",
        whole("refers_to").alias("refers_to"), "digest_holds",
    )
