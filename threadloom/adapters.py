"""Archives made of the test tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .archive import Archive
from .functions import columns as C
from .operators.fulltext import rebuild_index
from .operators.upsert import recompute_topics
from .storage import fresh_folder, spread

AS_OF = datetime(2024, 3, 1, tzinfo=UTC)
MODEL = "table"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _numbered(df: DataFrame, *by: str) -> DataFrame:
    """Small dimension tables: ids in order."""
    return df.withColumn("id", F.row_number().over(Window.orderBy(*by)).cast("long"))


def events_archive(spark: SparkSession, folder: str) -> Archive:
    """Events as messages: a stream for each type, a topic for each type and group of ten users."""
    e = table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "props", F.floor(F.col("user_id") / 10).alias("g")
    )
    streams = _numbered(e.select(F.col("event_type").alias("name")).distinct(), "name")
    name = F.concat(F.when(F.col("g") % 3 == 0, "✔ ").otherwise(""), F.lit("group "), F.col("g").cast("string"))
    topics = _numbered(
        e.select("event_type", name.alias("name")).distinct().join(
            F.broadcast(streams.select(F.col("name").alias("event_type"), F.col("id").alias("stream_id"))), "event_type"
        ),
        "stream_id", "name",
    ).select("id", "stream_id", "name", C.is_resolved(F.col("name")).alias("resolved"))
    keys = topics.join(streams.select(F.col("id").alias("stream_id"), F.col("name").alias("event_type")), "stream_id").select(
        F.col("id").alias("topic_id"), "stream_id", "event_type", F.col("name").alias("topic_name")
    )
    messages = e.withColumn("topic_name", name).join(keys, ["event_type", "topic_name"]).select(
        F.col("event_id").alias("id"), "stream_id", "topic_id", F.col("user_id").alias("sender_id"),
        F.col("props").alias("content"), F.col("props").alias("content_text"), F.col("ts").alias("timestamp"),
    )
    users = e.select("user_id").distinct().select(F.col("user_id").alias("id"), F.concat(F.lit("User_"), F.col("user_id").cast("string")).alias("full_name"))
    return _with_rollups(spark, streams, topics, messages, users)


def documents_archive(spark: SparkSession, folder: str) -> Archive:
    """Documents as messages: a stream for each language, a topic for each language and source.

    One message comes every five minutes; every fifth has an upload, of which some are fetched or
    failed. Embeddings are the topics' vectors where the numbers agree.
    """
    d = spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "text", "lang", "source", F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("n"))
    streams = _numbered(d.select(F.col("lang").alias("name")).distinct(), "name")
    name = F.concat(F.when(F.col("n") % 3 == 0, "✔ ").otherwise(""), "source")
    topics = _numbered(
        d.select("lang", name.alias("name")).distinct().join(
            F.broadcast(streams.select(F.col("name").alias("lang"), F.col("id").alias("stream_id"))), "lang"
        ),
        "stream_id", "name",
    ).select("id", "stream_id", "name", C.is_resolved(F.col("name")).alias("resolved"))
    keys = topics.join(streams.select(F.col("id").alias("stream_id"), F.col("name").alias("lang")), "stream_id").select(
        F.col("id").alias("topic_id"), "stream_id", "lang", F.col("name").alias("topic_name")
    )
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 300)
    messages = d.withColumn("topic_name", name).join(keys, ["lang", "topic_name"]).select(
        F.col("doc_id").alias("id"), "stream_id", "topic_id", F.col("n").alias("sender_id"), F.col("text").alias("content"),
        F.col("text").alias("content_text"), at.alias("timestamp"),
    )
    users = d.select("n").distinct().select(F.col("n").alias("id"), F.concat(F.lit("Sender "), F.col("n").cast("string")).alias("full_name"))
    m = messages.where(F.col("id") % 5 == 0)
    status = F.element_at(F.array(F.lit(None), F.lit("fetched"), F.lit("error")), (F.col("id") % 3 + 1).cast("int"))
    uploads = m.select(
        F.col("id"), F.col("id").alias("message_id"), "stream_id", "topic_id",
        F.concat(F.lit("/user_uploads/1/"), F.col("id").cast("string"), F.lit("/notes.txt")).alias("url"), F.lit("notes.txt").alias("file_name"),
        F.lit("notes").alias("title"), F.lit("text/plain").alias("content_type"), F.concat(F.lit("note "), F.col("id").cast("string")).alias("text_content"),
        (F.col("id") % 2 == 0).alias("indexed"), "timestamp", status.alias("media_status"),
    )
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("topic_id"), F.lit(MODEL).alias("model"), F.lit("local").alias("provider"), F.size("embedding").alias("dimension"),
        F.col("embedding").alias("vector"),
    )
    return _with_rollups(spark, streams, topics, messages, users, message_attachments=uploads, topic_embeddings=vectors)


_STORED: dict[tuple[str, str], str] = {}


def stored_documents(spark: SparkSession, folder: str) -> Archive:
    """documents_archive in the shared folder, with its full-text segments: written once in an application, then opened."""
    key = (spark.sparkContext.applicationId, folder)
    if key in _STORED:
        archive = Archive.open(spark, _STORED[key])
        if archive.pointer:  # else someone has cleared the shared folder
            return archive
    made = documents_archive(spark, folder)
    archive = Archive.open(spark, fresh_folder(spark)).commit({n: made.tables[n] for n in ("streams", "topics", "users", "messages", "message_attachments")})
    with archive.lock():
        archive = rebuild_index(archive)
    _STORED[key] = archive.root
    return archive


def _with_rollups(spark: SparkSession, streams, topics, messages, users, **more) -> Archive:
    bare = Archive(spark, {"topics": topics, "messages": messages})
    rolled = recompute_topics(bare.topics, bare.messages)
    return Archive(spark, {"streams": streams, "topics": rolled, "messages": messages, "users": users} | more)


def vectors_archive(spark: SparkSession, folder: str, lacking: bool = False) -> Archive:
    """Embeddings as topics with vectors: a stream for each label, every fourth topic resolved.

    lacking: a tenth of the topics have no vector, for what has to do with missing ones.
    """
    e = table(spark, folder, "embeddings")
    streams = e.select(F.col("label").cast("long").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("name")).distinct()
    topics = e.select(
        F.col("vec_id").alias("id"), F.col("label").cast("long").alias("stream_id"), F.concat(F.lit("topic "), F.col("vec_id").cast("string")).alias("name"),
        (F.col("vec_id") % 4 == 0).alias("resolved"), (F.col("vec_id") % 7).alias("message_count"),
    )
    vectors = (e.where(F.col("vec_id") % 10 != 3) if lacking else e).select(
        F.col("vec_id").alias("topic_id"), F.lit(MODEL).alias("model"), F.lit("local").alias("provider"), F.size("embedding").alias("dimension"),
        F.col("embedding").alias("vector"),
    )
    return Archive(spark, {"streams": streams, "topics": topics, "topic_embeddings": vectors})
