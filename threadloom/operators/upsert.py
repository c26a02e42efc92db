"""Keyed upserts, derived rows and rollups."""

from __future__ import annotations

import functools
from datetime import datetime
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..archive import Archive
from ..functions import columns as C
from ..functions.html import parse_html
from ..schema import KEYS
from ..storage import staged

NO_TOPIC = "(no topic)"
DIRECT_ID, DIRECT_STREAM, DIRECT_TOPIC = 0, "direct-messages", "direct messages"
MEDIA = ("media_path", "media_status", "media_fetched_at", "media_content_type", "media_bytes", "media_error")


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of the rows of each key the one that comes last; combined before the shuffle, so hot keys are cheap."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), order)
    return rows.groupBy(*keys).agg(packed.alias("_row")).select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns))


def latest_of_repeated(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """As `latest`, for rows that are read twice; only keys that have several rows are sorted and combined."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    many = staged(counts.where("_n > 1").drop("_n"))
    if many.isEmpty():
        return rows
    again = lambda how: rows.join(many, functools.reduce(and_, (rows[k].eqNullSafe(many[k]) for k in keys)), how)
    return again("left_anti").unionByName(latest(again("left_semi"), keys, order))


def upsert(table: str, old: DataFrame, new: DataFrame, order: Column | None = None, kept: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """New rows in place of old ones of the same key; `order` picks among new ones of one key, unless they are `unique`.

    Columns in `kept` stay as they were where the key was known.
    """
    keys = KEYS[table]
    one = new if unique else latest(new, keys, order) if order is not None else new.dropDuplicates(keys)
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*(F.col(k).alias(f"_a_{k}") for k in keys), F.struct(*rest).alias("_old"))
    b = one.select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.struct(*rest).alias("_new"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}"))
    both = a.join(b, same, "full")
    stays = F.col("_new").isNull()

    def value(c: str) -> Column:
        was, now = F.col("_old")[c], F.col("_new")[c]
        return F.when(stays | F.col("_old").isNotNull(), was).otherwise(now) if c in kept else F.when(stays, was).otherwise(now)

    return both.select(*((F.coalesce(f"_a_{c}", f"_b_{c}") if c in keys else value(c)).alias(c) for c in old.columns))


def merge_senders(users: DataFrame, senders: DataFrame) -> DataFrame:
    """Users with what messages say of their senders.

    The name is always taken; mail address, picture and bot flag only if they say something.
    """
    last = latest(senders, ["id"], F.struct(*(c for c in senders.columns if c != "id")))
    o, n = users.alias("o"), last.alias("n")
    said = lambda c: F.coalesce(F.when(F.col(f"n.{c}") != "", F.col(f"n.{c}")), F.col(f"o.{c}"), F.col(f"n.{c}"))
    new = F.col("n.id").isNotNull()
    return o.join(n, F.col("o.id") == F.col("n.id"), "full").select(
        F.coalesce("o.id", "n.id").alias("id"),
        F.coalesce("o.org_id", "n.org_id").alias("org_id"),
        said("email").alias("email"),
        F.when(new, F.col("n.full_name")).otherwise(F.col("o.full_name")).alias("full_name"),
        F.coalesce(F.when(F.col("n.is_bot"), True), F.col("o.is_bot"), F.col("n.is_bot")).alias("is_bot"),
        said("avatar_url").alias("avatar_url"),
        F.coalesce("n.synced_at", "o.synced_at").alias("synced_at"),
    )


def topic_name(name: Column, subject: Column | None = None) -> Column:
    named = [F.when(c != "", c) for c in (name, subject) if c is not None]
    return F.coalesce(*named, F.lit(NO_TOPIC))


def assign_topics(topics: DataFrame, seen: DataFrame, as_of: datetime) -> DataFrame:
    """The topic table with the (org_id, stream_id, name) seen: known ids stay, new ones follow the greatest.

    Names of one stream are numbered in order; numbers of streams begin after those of the streams
    before, so no task has to see all new topics.
    """
    seen = seen.select("org_id", "stream_id", topic_name(F.col("name")).alias("name")).distinct()
    known = topics.select("stream_id", "name")
    new = seen.join(known, ["stream_id", "name"], "left_anti")
    counts = new.groupBy("stream_id").agg(F.count("*").alias("n"))
    # one row for each stream
    before = counts.withColumn("base", F.sum("n").over(Window.orderBy("stream_id").rowsBetween(Window.unboundedPreceding, -1)))
    top = topics.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("name"))
    fresh = (
        new.withColumn("number", number)
        .join(before.select("stream_id", F.coalesce("base", F.lit(0)).alias("base")), "stream_id")
        .crossJoin(F.broadcast(top))
        .select((F.col("top") + F.col("base") + F.col("number")).alias("id"), "org_id", "stream_id", "name")
    )
    again = seen.select("stream_id", "name", F.lit(True).alias("_seen"))
    flagged = topics.join(again, ["stream_id", "name"], "left").withColumn(
        "resolved", F.when(F.col("_seen"), C.is_resolved(F.col("name"))).otherwise(F.col("resolved"))
    ).drop("_seen")
    added = fresh.withColumn("resolved", C.is_resolved(F.col("name"))).withColumn("message_count", F.lit(0).cast("long")).withColumn("synced_at", C.instant(as_of))
    return flagged.unionByName(added, allowMissingColumns=True).select(*topics.columns)


def set_resolved(topics: DataFrame, topic_id: int, resolved: bool) -> DataFrame:
    return topics.withColumn("resolved", F.when(F.col("id") == topic_id, F.lit(resolved)).otherwise(F.col("resolved")))


def rollup(messages: DataFrame) -> DataFrame:
    """Counts and first and last ids and times of each topic that has messages."""
    return messages.groupBy("topic_id").agg(
        F.count("*").alias("message_count"),
        F.min("id").alias("first_message_id"),
        F.max("id").alias("last_message_id"),
        F.min("timestamp").alias("first_message_at"),
        F.max("timestamp").alias("last_message_at"),
    )


def rollup_parts(messages: DataFrame, part) -> DataFrame:
    """rollup of each part of the messages by itself."""
    numbered = messages.select("id", "topic_id", "timestamp", part.alias("part"))
    return numbered.groupBy("part", "topic_id").agg(
        F.count("*").alias("message_count"),
        F.min("id").alias("first_message_id"),
        F.max("id").alias("last_message_id"),
        F.min("timestamp").alias("first_message_at"),
        F.max("timestamp").alias("last_message_at"),
    ).drop("part")


def merged_rollups(rollups: DataFrame, *by: str | Column) -> DataFrame:
    """One rollup of each topic (and `by`) from those of several parts of the messages."""
    return rollups.groupBy(*by, "topic_id").agg(
        F.sum("message_count").alias("message_count"),
        *(F.min(c).alias(c) for c in ("first_message_id", "first_message_at")),
        *(F.max(c).alias(c) for c in ("last_message_id", "last_message_at")),
    )


def with_rollups(topics: DataFrame, rollups: DataFrame) -> DataFrame:
    """The topics with these counts and first and last ids and times; topics that have none get 0 and nulls."""
    own = [c for c in rollups.columns if c != "topic_id"]
    out = topics.drop(*own).join(rollups.withColumnRenamed("topic_id", "id"), "id", "left")
    return out.withColumn("message_count", F.coalesce("message_count", F.lit(0).cast("long"))).select(*topics.columns)


def recompute_topics(topics: DataFrame, messages: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The topic table with rollups anew, of all topics or of those with a topic_id in `only`.

    Topics without messages have 0 and nulls. Three columns of the messages are read.
    """
    m = messages.select("id", "topic_id", "timestamp")
    if only is None:
        return with_rollups(topics, rollup(m))
    return _replaced(topics, rollup(m.join(only, "topic_id", "left_semi")), only)


def refresh_topics(topics: DataFrame, rollups: DataFrame, only: DataFrame) -> DataFrame:
    """recompute_topics of the topics in `only` from rollups of the messages' parts, without the messages."""
    return _replaced(topics, merged_rollups(rollups.join(only, "topic_id", "left_semi")), only)


def _replaced(topics: DataFrame, rollups: DataFrame, only: DataFrame) -> DataFrame:
    ids = only.select(F.col("topic_id").alias("id"))
    fresh = with_rollups(topics.join(ids, "id", "left_semi").select(*topics.columns), rollups)
    return topics.join(ids, "id", "left_anti").select(*topics.columns).union(fresh)


def derive(messages: DataFrame) -> DataFrame:
    """Messages with what their rendered text holds: content_text, flags, mentions and uploads."""
    parsed = messages.withColumn("_p", parse_html(F.coalesce("content", F.lit(""))))
    html = F.coalesce("content", F.lit(""))
    return (
        parsed.withColumn("content_text", F.col("_p.text"))
        .withColumn("has_link", C.has_link(html, F.col("_p.text")))
        .withColumn("has_image", C.has_image(html))
        .withColumn("has_attachment", C.has_attachment(html, F.col("_p.uploads")))
        .withColumn("mentions", F.col("_p.mentions"))
        .withColumn("uploads", F.col("_p.uploads"))
        .drop("_p")
    )


def mention_rows(derived: DataFrame) -> DataFrame:
    base = derived.select(F.col("id").alias("message_id"), "org_id", "stream_id", "topic_id", "timestamp", F.explode("mentions").alias("m"))
    user = F.when(F.col("m.user_id") != 0, F.col("m.user_id"))
    out = base.select("message_id", "org_id", "stream_id", "topic_id", user.alias("mentioned_user_id"),
                      F.col("m.name").alias("mentioned_name"), F.col("m.kind").alias("mention_kind"), "timestamp")
    return out.dropDuplicates(KEYS["message_mentions"])


def upload_rows(derived: DataFrame) -> DataFrame:
    """Uploads of messages; an upload's id is a hash of its message and URL, so it is the same in every run."""
    base = derived.select(F.col("id").alias("message_id"), "org_id", "stream_id", "topic_id", "timestamp", F.explode("uploads").alias("u"))
    return base.select(
        F.xxhash64("message_id", "u.url").alias("id"), "message_id", "org_id", "stream_id", "topic_id", "u.url", "u.file_name", "u.title",
        "u.content_type", F.col("u.text").alias("text_content"), "u.indexed", "timestamp",
    )


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Children of the parents (message_id) replaced by new ones; `kept` columns go over by (message, URL)."""
    rest = old.join(parents, "message_id", "left_anti")
    if kept:
        before = old.join(parents, "message_id", "left_semi").select("message_id", "url", *kept)
        new = new.drop(*kept).join(before, ["message_id", "url"], "left")
    return rest.unionByName(new, allowMissingColumns=True).select(*old.columns)


def last_edit() -> Column:
    """By what the last of a message's versions is told."""
    return F.struct(F.coalesce("edit_timestamp", "timestamp"), F.xxhash64("content"))


def upsert_messages(archive: Archive, derived: DataFrame, unique: bool = False) -> dict[str, DataFrame]:
    """The message tables after a batch from `derive`; of one id the last edit counts, unless ids are `unique`.

    A message's mentions and uploads are replaced; what is known of an upload's media stays.
    """
    newest = derived if unique else latest(derived, ["id"], last_edit())
    parents = newest.select(F.col("id").alias("message_id"))
    return {
        "messages": upsert("messages", archive.messages, newest.select(*archive.messages.columns), kept=("org_id",), unique=True),
        "message_mentions": replace_children(archive.message_mentions, mention_rows(newest), parents),
        "message_attachments": replace_children(archive.message_attachments, upload_rows(newest), parents, MEDIA),
    }


def rebuild_derived(archive: Archive, through_id: int | None = None) -> dict[str, DataFrame]:
    """Mentions and uploads of all messages (up to an id) derived again; twice gives the same."""
    m = archive.messages if through_id is None else archive.messages.where(F.col("id") <= through_id)
    derived = derive(m)
    parents = m.select(F.col("id").alias("message_id"))
    return {
        "message_mentions": replace_children(archive.message_mentions, mention_rows(derived), parents),
        "message_attachments": replace_children(archive.message_attachments, upload_rows(derived), parents, MEDIA),
    }


def update_media(uploads: DataFrame, updates: DataFrame) -> DataFrame:
    """Media columns by upload id; blank texts become null."""
    blank = {"media_path", "media_status", "media_content_type", "media_error"}
    u = updates.select(F.col("id").alias("_id"), *((C.blank_to_null(F.col(c)) if c in blank else F.col(c)).alias(f"_{c}") for c in MEDIA))
    joined = uploads.join(u, uploads["id"] == u["_id"], "left")
    own = {c: F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(uploads[c]) for c in MEDIA}
    return joined.select(*((own[c] if c in own else uploads[c]).alias(c) for c in uploads.columns))


def bookmark(archive: Archive, stream_id: int, org_id: int = 1) -> int:
    """The last message id ingested of a stream, 0 if none."""
    s = archive.sync_state.where((F.col("org_id") == org_id) & (F.col("stream_id") == stream_id))
    return s.agg(F.coalesce(F.max("last_message_id"), F.lit(0))).first()[0]


def ensure_user(users: DataFrame, user_id: int, name: str, org_id: int = 1) -> DataFrame:
    """The user table with this user; id 0 stands for none and changes nothing."""
    if user_id == 0:
        return users
    row = users.sparkSession.createDataFrame([(user_id, org_id, "", name, False, "")], "id long, org_id long, email string, full_name string, is_bot boolean, avatar_url string")
    return merge_senders(users, row.withColumn("synced_at", F.lit(None).cast("timestamp")))


def ensure_stream(streams: DataFrame, stream_id: int, name: str, org_id: int = 1) -> DataFrame:
    """The stream table with this stream under this name; id 0 is an error."""
    if stream_id == 0:
        raise ValueError("a stream needs an id")
    row = streams.sparkSession.createDataFrame([(stream_id, org_id, name)], "id long, org_id long, name string")
    new = streams.limit(0).unionByName(row, allowMissingColumns=True)
    return upsert("streams", streams, new, kept=("org_id",))
