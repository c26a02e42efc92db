"""Ingest: batches of server messages into an archive, once or as a stream."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..archive import PARTED, Archive, part_of
from ..functions import columns as C
from ..operators import fulltext as T
from ..operators import upsert as U
from ..operators.segments import due_for_merge
from ..schema import SCHEMAS
from ..storage import staged


def prepare(batch: DataFrame, as_of: datetime, org_id: int = 1) -> DataFrame:
    """Server messages in the archive's terms; direct messages get the stream and topic of their own."""
    direct = F.col("type") == "private"
    edited = F.when(F.col("edit_timestamp") > 0, F.timestamp_seconds("edit_timestamp"))
    return batch.select(
        "id",
        F.lit(org_id).cast("long").alias("org_id"),
        F.when(direct, F.lit(U.DIRECT_ID)).otherwise(F.col("stream_id")).cast("long").alias("stream_id"),
        F.when(direct, F.lit(U.DIRECT_TOPIC)).otherwise(U.topic_name(F.col("topic"), F.col("subject"))).alias("topic_name"),
        "sender_id",
        "sender_full_name",
        "content",
        F.timestamp_seconds("timestamp").alias("timestamp"),
        edited.alias("edit_timestamp"),
        F.coalesce(F.when(F.col("reactions") != "", F.col("reactions")), F.lit("[]")).alias("reactions"),
        F.coalesce("is_me_message", F.lit(False)).alias("is_me_message"),
    )


def ingest(archive: Archive, batch: DataFrame, as_of: datetime, since: datetime | None = None, org_id: int = 1, locked: bool = False) -> Archive:
    """One batch of server messages (landing.MESSAGE) committed: senders, topics, messages, children,
    rollups of the topics that gained or lost messages, bookmarks.

    Messages before `since` are dropped, but for their senders. All of it becomes visible at once, so a
    run that fails can be run again; a batch that comes twice changes nothing. Messages and their children are
    laid on top of the parts that their ids lie in, with removals of the rows they replace, and so are the
    rollups of their topics, so what is written grows with the batch. Of those parts the span of the batch's ids is read,
    and times of all messages only for topics that an edited or moved message was in. Full-text
    segments get one more, as large as the batch. An archive without them (an older one) gets them from `rebuild`.
    """
    rows = staged(prepare(batch, as_of, org_id))
    senders = rows.select(
        F.col("sender_id").alias("id"), "org_id", F.lit("").alias("email"), F.col("sender_full_name").alias("full_name"),
        F.lit(False).alias("is_bot"), F.lit("").alias("avatar_url"), C.instant(as_of).alias("synced_at"),
    )
    users = U.merge_senders(archive.users, senders)
    if since is not None:
        rows = rows.where(F.col("timestamp") >= C.instant(since))
    seen = rows.select("org_id", "stream_id", F.col("topic_name").alias("name"))
    topics = staged(U.assign_topics(archive.topics, seen, as_of))
    ids = topics.select("stream_id", F.col("name").alias("topic_name"), F.col("id").alias("topic_id"))
    newest = U.latest_of_repeated(rows.where("stream_id IS NOT NULL"), ["id"], U.last_edit())
    derived = staged(U.derive(newest.join(ids, ["stream_id", "topic_name"])).drop("topic_name", "sender_full_name"))
    spans = rows.groupBy(part_of("id").alias("part")).agg(F.min("id").alias("least"), F.max("id").alias("most")).collect()
    parts = [r["part"] for r in spans]
    own = derived.select("id").distinct()
    before = {n: staged(_known(archive, n, spans, own)) for n in ("messages", "message_attachments")}
    old = Archive(archive.spark, {n: df for n, df in before.items() if not df.isEmpty()})  # joins with empty ones go
    tables = U.upsert_messages(old, derived, unique=True)
    messages = staged(tables.pop("messages"))
    replaced = old.messages.select("id").union(old.message_attachments.select("message_id")).distinct()
    gone = {"message_gone": replaced.select(part_of("id").alias("part"), "id")}
    # topics that gained or lost messages
    lost = staged(old.messages.select("topic_id").distinct())
    touched = staged(derived.select("topic_id").union(lost).distinct())
    times = ("id", "topic_id", "timestamp")
    left = archive.some_parts("messages", parts).select(*times).join(own, "id", "left_anti")
    if archive.has("part_rollups"):
        known = archive.some_parts("part_rollups", parts).join(touched, "topic_id", "left_semi")
        gone["rollup_gone"] = known.select(part_of(PARTED["part_rollups"]).alias("part"), F.col("topic_id").alias("id"))
        grown = known.unionByName(U.rollup_parts(messages, part_of("id"))).join(lost, "topic_id", "left_anti")
        by_part = U.merged_rollups(grown, part_of(PARTED["part_rollups"]).alias("part")).drop("part")
        if not lost.isEmpty():
            again = left.union(messages.select(*times)).join(lost, "topic_id", "left_semi")
            by_part = by_part.unionByName(U.rollup_parts(again, part_of("id")))
        by_part = staged(by_part)
        refreshed = U.refresh_topics(topics, archive.some_parts("part_rollups", parts, other=True).unionByName(by_part), touched)
        tables["part_rollups"] = by_part
    else:
        others = archive.some_parts("messages", parts, other=True).select(*times)
        refreshed = U.recompute_topics(topics, others.union(left).union(messages.select(*times)), touched)
    added = None
    if archive.indexed:
        changed = Archive(archive.spark, {"messages": messages, "message_attachments": tables["message_attachments"], "topics": topics, "users": users})
        added = T.segment_of(archive, changed, old, topics.join(archive.topics.select("id"), "id", "left_anti"))
    direct = archive.spark.createDataFrame([(U.DIRECT_ID, org_id, U.DIRECT_STREAM)], "id long, org_id long, name string")
    new_direct = direct.join(rows.where(F.col("stream_id") == U.DIRECT_ID).select("stream_id").distinct(), F.col("id") == F.col("stream_id"), "left_semi")
    marks = rows.groupBy("org_id", "stream_id").agg(F.max("id").alias("last_message_id")).withColumn("synced_at", C.instant(as_of))
    before = archive.sync_state.select("org_id", "stream_id", F.col("last_message_id").alias("was"))
    marks = marks.join(before, ["org_id", "stream_id"], "left").select(
        "org_id", "stream_id", F.greatest("last_message_id", F.coalesce("was", F.lit(0))).alias("last_message_id"), "synced_at"
    )
    known = archive.streams.join(new_direct.select("id"), "id", "left_anti")
    archive = archive.commit(
        tables
        | {
            "messages": messages,
            "users": users,
            "topics": refreshed,
            "streams": known.unionByName(new_direct, allowMissingColumns=True),
            "sync_state": U.upsert("sync_state", archive.sync_state, marks),
        },
        parts,
        locked,
        added,
        gone=gone,
    )
    if locked:
        return _merged(archive, parts)
    with archive.lock():
        return _merged(Archive.open(archive.spark, archive.root), parts)


def _known(archive: Archive, table: str, spans: list[Row], own: DataFrame) -> DataFrame:
    """The rows of the messages `own`; files are read only where the batch's ids (spans of each part) may lie."""
    near = F.lit(False)
    for s in spans:
        near = near | F.col(PARTED[table]).between(s["least"], s["most"])
    ids = own.withColumnRenamed("id", PARTED[table])
    return archive.some_parts(table, [s["part"] for s in spans]).where(near).join(ids, PARTED[table], "left_semi")


def _merged(archive: Archive, parts: list[int]) -> Archive:
    """The archive with layers of these parts and full-text segments merged where there are many of like size."""
    archive = archive.compact(parts, due_for_merge)
    return T.merge_due(archive) if archive.indexed else archive


def run_stream(source: DataFrame, root: str, checkpoint: str, as_of: datetime, since: datetime | None = None) -> StreamingQuery:
    """Each micro-batch of new messages ingested into the archive at `root`, until none are left."""

    def one(batch: DataFrame, _: int) -> None:
        ingest(Archive.open(batch.sparkSession, root), batch, as_of, since)

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuild(archive: Archive, batch: int = 0, progress: Callable[[int, int], None] | None = None) -> Archive:
    """Mentions and uploads of all messages there are now derived again, then the full-text segments, under the writer lock.

    batch: so many parts of the messages (all, if below 1) are written and committed at a time, so that a
    run that ends early keeps what it did; progress(parts done, of how many) is told after each.
    """
    with archive.lock():
        archive = Archive.open(archive.spark, archive.root)
        parts = archive.parts("messages")
        size = batch if batch > 0 else max(1, len(parts))
        for k in range(0, len(parts), size):
            some = parts[k : k + size]
            own = Archive(archive.spark, {n: archive.tables[n] for n in SCHEMAS} | {n: archive.some_parts(n, some) for n in PARTED if n in SCHEMAS})
            tables = {n: staged(df) for n, df in U.rebuild_derived(own).items()}
            tables["part_rollups"] = U.rollup_parts(own.messages, part_of("id"))
            archive = archive.commit(tables, some, locked=True)
            if progress:
                progress(min(k + size, len(parts)), len(parts))
        return T.rebuild_index(archive)
