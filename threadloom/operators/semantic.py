"""Topic vectors: what lacks one, the texts they are made of, search by cosine."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..archive import Archive
from ..functions import columns as C
from ..functions.vectors import Vectorizer, dot, embed_column
from .upsert import upsert


class DimensionMismatchError(ValueError):
    """Stored vectors of a model and new ones differ in length."""


def topics_without_vector(archive: Archive, model: str, limit: int = 0) -> DataFrame:
    """topic_id of topics that have no vector of the model, by id; limit below 1: all."""
    have = archive.topic_embeddings.where(F.col("model") == model).select("topic_id")
    out = archive.topics.select(F.col("id").alias("topic_id")).join(have, "topic_id", "left_anti").orderBy("topic_id")
    return out.limit(limit) if limit > 0 else out


def topic_texts(archive: Archive, sample: int = 50, only: DataFrame | None = None) -> DataFrame:
    """topic_id and text: a heading and those of the topic's first messages (by id) that have any text.

    The first messages are picked before the shuffle where that cuts it, so a topic with most of the
    messages is no hot task.
    """
    n = sample if sample > 0 else 50
    m = archive.messages.select("id", "topic_id", "content_text")
    t = archive.topics.select(F.col("id").alias("topic_id"), "stream_id", "name")
    if only is not None:
        m, t = m.join(only, "topic_id", "left_semi"), t.join(only, "topic_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("topic_id").orderBy("id"))
    lines = (
        m.withColumn("n", first)
        .where(F.col("n") <= n)
        .where(F.col("content_text") != "")
        .groupBy("topic_id")
        .agg(F.array_sort(F.collect_list(F.struct("id", "content_text"))).alias("m"))
        .select("topic_id", F.col("m.content_text").alias("lines"))
    )
    streams = archive.streams.select(F.col("id").alias("stream_id"), F.col("name").alias("stream_name"))
    head = F.concat(F.lit("#"), "stream_name", F.lit(" > "), "name")
    body = F.coalesce("lines", F.array().cast("array<string>"))
    return (
        t.join(streams, "stream_id")
        .join(lines, "topic_id", "left")
        .select("topic_id", F.array_join(F.concat(F.array(head), body), "\n").alias("text"))
    )


def vector_stats(archive: Archive, model: str) -> DataFrame:
    """model, provider, dimension, vectors: a row for each group, most vectors first."""
    e = archive.topic_embeddings.where(F.col("model") == model)
    groups = e.groupBy("model", "provider", "dimension").agg(F.count("*").alias("vectors"))
    return groups.orderBy(F.desc("vectors"), "dimension", "provider")


def coverage(archive: Archive, model: str) -> DataFrame:
    """One row: total topics, embedded and missing ones."""
    have = archive.topic_embeddings.where(F.col("model") == model).agg(F.count("*").alias("embedded"))
    total = archive.topics.agg(F.count("*").alias("total"))
    return total.crossJoin(have).withColumn("missing", F.col("total") - F.col("embedded"))


def vectors_of(archive: Archive, model: str) -> DataFrame:
    """topic_id, vector of a model, by topic."""
    return archive.topic_embeddings.where(F.col("model") == model).select("topic_id", "vector").orderBy("topic_id")


def vector_of(archive: Archive, topic_id: int, model: str) -> list[float]:
    """One stored vector; LookupError without it."""
    row = archive.topic_embeddings.where((F.col("topic_id") == topic_id) & (F.col("model") == model)).select("vector").first()
    if row is None:
        raise LookupError(f"topic {topic_id} has no vector of {model!r}")
    return row["vector"]


def topic_meta(archive: Archive, topic_id: int) -> DataFrame:
    """One topic's id, names, resolution, count and last time."""
    s = archive.streams.select(F.col("id").alias("stream_id"), F.col("name").alias("stream_name"))
    t = archive.topics.where(F.col("id") == topic_id).join(s, "stream_id")
    last = F.coalesce(C.rfc3339(F.col("last_message_at")), F.lit("")).alias("last_message_at")
    return t.select(F.col("id").alias("topic_id"), "stream_name", F.col("name").alias("topic_name"), "resolved", "message_count", last)


def store_vectors(archive: Archive, new: DataFrame, provider: str, as_of: datetime) -> DataFrame:
    """The vector table with (topic_id, model, vector) rows in place of older ones; an empty vector is an error."""
    size = F.coalesce(F.size("vector"), F.lit(0))
    checked = F.when(size > 0, F.col("vector")).otherwise(F.raise_error(F.lit("empty vector")).cast("array<float>"))
    rows = new.select("topic_id", "model", F.lit(provider).alias("provider"), size.cast("int").alias("dimension"),
                      checked.alias("vector"), C.instant(as_of).alias("indexed_at"))
    return upsert("topic_embeddings", archive.topic_embeddings, rows)


def delete_vectors(archive: Archive, model: str) -> DataFrame:
    return archive.topic_embeddings.where(F.col("model") != model)


def _check_dimension(archive: Archive, model: str, dim: int) -> None:
    if dim > 0:
        e = archive.topic_embeddings.where(F.col("model") == model)
        low, high = e.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if low is not None and (low != dim or high != dim):
            raise DimensionMismatchError(f"vectors of {model!r} have {low} to {high} components, new ones {dim}; embed again with force")


def filtered_vectors(archive: Archive, model: str, stream: str = "", unresolved: bool = False) -> DataFrame:
    """Vectors of the model with their topics' data, filtered before anything is ranked."""
    t = archive.topics.where(~F.col("resolved")) if unresolved else archive.topics
    s = archive.streams.select(F.col("id").alias("stream_id"), F.col("name").alias("stream_name"))
    if stream:
        s = s.where(F.col("stream_name") == stream)
    meta = t.select(F.col("id").alias("topic_id"), "stream_id", F.col("name").alias("topic_name"), "resolved", "message_count", "last_message_at")
    own = archive.topic_embeddings.where(F.col("model") == model).select("topic_id", "vector")
    last = F.coalesce(C.rfc3339(F.col("last_message_at")), F.lit(""))
    return own.join(meta, "topic_id").join(s, "stream_id").withColumn("last_message_at", last).drop("stream_id")


def nearest_topics(archive: Archive, model: str, query: list[float], stream: str = "", unresolved: bool = False, limit: int = 20) -> DataFrame:
    """Topics by the product of their vector and the query's; best first, ties by id."""
    rows = filtered_vectors(archive, model, stream, unresolved)
    return (
        rows.withColumn("score", dot(F.col("vector"), query))
        .drop("vector")
        .orderBy(F.desc("score"), "topic_id")
        .limit(limit if limit > 0 else 20)
        .select("topic_id", "stream_name", "topic_name", "resolved", "message_count", "last_message_at", "score")
    )


def semantic_topics(archive: Archive, vectorizer: Vectorizer, query: str, stream: str = "", unresolved: bool = False, limit: int = 20) -> DataFrame:
    """nearest_topics of a text. Without vectors of the model, or with others' lengths, an error."""
    if vector_stats(archive, vectorizer.model).first() is None:
        raise LookupError(f"no vectors of {vectorizer.model!r}; embed the topics first")
    q = vectorizer.embed([query])[0]
    _check_dimension(archive, vectorizer.model, len(q))
    return nearest_topics(archive, vectorizer.model, [float(x) for x in q], stream, unresolved, limit)


@dataclass(frozen=True)
class EmbedOptions:
    enabled: bool = False
    provider: str = "local"
    sample: int = 50
    limit: int = 0
    force: bool = False


def embed_topics(archive: Archive, vectorizer: Vectorizer, options: EmbedOptions, as_of: datetime) -> tuple[DataFrame, int]:
    """The vector table with vectors for topics that had none, and how many those are.

    force drops the model's vectors first. A length that differs from the stored one is an error
    before anything is changed.
    """
    if not options.enabled:
        raise RuntimeError("embeddings are switched off")
    model = vectorizer.model
    if options.force:
        archive = Archive(archive.spark, archive.tables | {"topic_embeddings": delete_vectors(archive, model)}, archive.root)
    _check_dimension(archive, model, vectorizer.dim or len(vectorizer.embed(["x"])[0]))
    todo = topics_without_vector(archive, model, options.limit)
    n = todo.count()
    new = embed_column(topic_texts(archive, options.sample, todo), "text", vectorizer).select(
        "topic_id",
        F.lit(model).alias("model"),
        F.lit(options.provider).alias("provider"),
        F.size("vector").alias("dimension"),
        "vector",
        C.instant(as_of).alias("indexed_at"),
    )
    return upsert("topic_embeddings", archive.topic_embeddings, new), n
