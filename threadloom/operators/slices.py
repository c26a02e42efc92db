"""Filtered listings of an archive: messages, topics, attachments, counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..archive import Archive
from ..functions import columns as C

ALL = -1


@dataclass(frozen=True)
class MessageFilter:
    """What of the messages is wanted; unset parts don't filter. Times are RFC 3339 or YYYY-MM-DD.

    limit: 0 for 200, ALL for no limit. last: the newest so many, for which limit doesn't count.
    """

    stream: str = ""
    topic: str = ""
    sender: str = ""
    since: str = ""
    until: str = ""
    days: int = 0
    hours: int = 0
    last: int = 0
    limit: int = 0

    def narrow(self) -> MessageFilter:
        """Itself, if it narrows the archive at all or says ALL, and has no negative numbers."""
        if not any((self.stream, self.topic, self.sender, self.since, self.until, self.days, self.hours, self.last)) and self.limit != ALL:
            raise ValueError("give at least one of stream, topic, sender, since, until, days, hours, last, or limit=ALL")
        for name in ("days", "hours", "last"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is negative")
        if self.limit < ALL:
            raise ValueError("limit is negative")
        return self

    def times(self, as_of: datetime) -> tuple[datetime | None, datetime | None]:
        """The later of the two lower bounds, and the upper one."""
        since = C.time_bound(self.since, False) if self.since else None
        until = C.time_bound(self.until, True) if self.until else None
        if self.days > 0 or self.hours > 0:
            window = as_of.replace(microsecond=0) - timedelta(days=self.days, hours=self.hours)
            since = window if since is None else max(since, window)
        return since, until


def _named(df: DataFrame, key: str, name: str, value: str = "", of: str = "name") -> DataFrame:
    out = df.select(F.col("id").alias(key), F.col(of).alias(name))
    return out.where(F.col(name) == value) if value else out


def messages(archive: Archive, f: MessageFilter, as_of: datetime) -> DataFrame:
    """message_id, stream_name, topic_name, sender_name, timestamp, content, oldest first, ties by id.

    The bounds reach the scan of the messages; names are matched on the small tables, whose joins the
    planner chooses.
    """
    since, until = f.times(as_of)
    m = archive.messages.select("id", "stream_id", "topic_id", "sender_id", "timestamp", "content_text")
    if since is not None:
        m = m.where(F.col("timestamp") >= C.instant(since))
    if until is not None:
        m = m.where(F.col("timestamp") <= C.instant(until))
    users = _named(archive.users, "sender_id", "sender_name", of="full_name")
    if f.sender:
        users = users.where(C.contains_like(F.col("sender_name"), f.sender))
    rows = (
        m.join(_named(archive.streams, "stream_id", "stream_name", f.stream), "stream_id")
        .join(_named(archive.topics, "topic_id", "topic_name", f.topic), "topic_id")
        .join(users, "sender_id")
    )
    if f.last > 0:
        rows = rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(f.last)
    elif f.limit != ALL:
        rows = rows.orderBy("timestamp", "id").limit(f.limit or 200)
    return rows.orderBy("timestamp", "id").select(
        F.col("id").alias("message_id"),
        "stream_name",
        "topic_name",
        F.coalesce("sender_name", F.lit("")).alias("sender_name"),
        C.rfc3339(F.col("timestamp")).alias("timestamp"),
        F.col("content_text").alias("content"),
    )


def topics(archive: Archive, stream: str = "", unresolved: bool = False, limit: int = 100) -> DataFrame:
    """Topics by their last message, newest first, those without one last; ties by id."""
    t = archive.topics.where(~F.col("resolved")) if unresolved else archive.topics
    text = lambda c: F.coalesce(C.rfc3339(F.col(c)), F.lit("")).alias(c)
    return (
        t.withColumnRenamed("name", "topic_name")
        .join(_named(archive.streams, "stream_id", "stream_name", stream), "stream_id")
        .orderBy(F.desc_nulls_last("last_message_at"), "id")
        .limit(limit if limit > 0 else 100)
        .select("stream_name", "topic_name", "resolved", "message_count", text("last_message_at"), text("first_message_at"))
    )


def status_is(status: Column, wanted: str) -> Column | None:
    """Whether an upload's media status is the wanted one; what failed is pending again."""
    if wanted in ("", "all"):
        return None
    if wanted == "pending":
        return status.isNull() | status.isin("", "error")
    if wanted in ("fetched", "error"):
        return status == wanted
    raise ValueError(f"unknown attachment status {wanted!r}")


def attachments(archive: Archive, stream: str = "", topic: str = "", status: str = "", limit: int = 0) -> DataFrame:
    """Uploads with their stream's, topic's and sender's names, newest first, ties by greater id; limit below 1: all.

    The stream and topic are the upload's own, the sender its message's.
    """
    a = archive.message_attachments
    wanted = status_is(F.col("media_status"), status)
    if wanted is not None:
        a = a.where(wanted)
    sent = archive.messages.select(F.col("id").alias("message_id"), "sender_id")
    rows = (
        a.join(sent, "message_id")
        .join(_named(archive.streams, "stream_id", "stream_name", stream), "stream_id")
        .join(_named(archive.topics, "topic_id", "topic_name", topic), "topic_id")
        .join(_named(archive.users, "sender_id", "sender_name", of="full_name"), "sender_id", "left")
        .orderBy(F.desc("timestamp"), F.desc("id"))
    )
    if limit > 0:
        rows = rows.limit(limit)
    text = ["sender_name", "file_name", "title", "content_type", "media_path", "media_status", "media_content_type", "media_error"]
    return rows.select(
        "id", "message_id", "stream_name", "topic_name", "url",
        *(F.coalesce(c, F.lit("")).alias(c) for c in text),
        C.rfc3339(F.col("timestamp")).alias("timestamp"),
        F.coalesce(C.rfc3339(F.col("media_fetched_at")), F.lit("")).alias("media_fetched_at"),
        F.coalesce("media_bytes", F.lit(0)).alias("media_bytes"),
    )


def stats(archive: Archive) -> DataFrame:
    """One row: streams, topics, users, messages, size_in_bytes."""
    one = [getattr(archive, n).agg(F.count("*").alias(n)) for n in ("streams", "topics", "users", "messages")]
    out = one[0]
    for other in one[1:]:
        out = out.crossJoin(other)  # single rows
    return out.withColumn("size_in_bytes", F.lit(archive.size_in_bytes()).cast("long"))


def choose_streams(streams: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), asked: Sequence[str] = ()) -> DataFrame:
    """Streams to ingest, by name in any case: excluded ones never; asked ones replace the included."""
    plain = lambda names: sorted({n.strip().lower() for n in names} - {""})
    out = streams.where(~F.lower("name").isin(plain(exclude))) if plain(exclude) else streams
    wanted = plain(asked or include)
    return out.where(F.lower("name").isin(wanted)) if wanted else out


def snapshot(archive: Archive, through_id: int | None = None) -> DataFrame:
    """One row: the greatest message id (0 without messages), all messages, and those up to an id."""
    through = F.lit(True) if through_id is None else F.col("id") <= through_id
    return archive.messages.agg(
        F.coalesce(F.max("id"), F.lit(0)).alias("greatest_id"), F.count("*").alias("messages"), F.count_if(through).alias("through")
    )


def tsv(df: DataFrame) -> str:
    """A small result as tab-separated lines under a heading; null is <nil>."""
    def text(v) -> str:
        return "<nil>" if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    return "\n".join(["\t".join(df.columns), *("\t".join(map(text, r)) for r in df.collect())])


def message_lines(rows: DataFrame) -> str:
    """Messages as text, with their number."""
    found = rows.collect()
    if not found:
        return "No messages found."
    at = lambda r: r["timestamp"].replace("T", " ").removesuffix("Z")
    lines = [f"[{at(r)}] #{r['stream_name']} > {r['topic_name']} | {r['sender_name']}\n  {r['content']}\n" for r in found]
    return "\n".join([*lines, f"({len(found)} messages)"])
