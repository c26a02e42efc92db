"""Commands over an archive: python -m threadloom COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import Archive
from .functions import columns as C
from .functions.vectors import HashVectorizer, Vectorizer, model_server
from .operators import fulltext as T
from .operators import semantic as V
from .operators import slices as S
from .operators import upsert as U
from .sources import config, landing, media, rest
from .storage import staged
from .streaming import ingest as I


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadloom")
    p.add_argument("--config", default="~/.threadloom/config.toml")
    p.add_argument("--archive", help="folder of the archive")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: str, **valued) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for f in flags:
            c.add_argument(f"--{f}", action="store_true")
        for n, default in valued.items():
            kind = type(default) if default is not None else str
            c.add_argument(f"--{n.replace('_', '-')}", type=kind, default=default)
        return c

    add("init", url="", from_json="", channel="")
    add("doctor")
    add("sync", "full", "with-media", "quiet", landing="", since="", streams="")
    add("search", "resolved", stream="", limit=20).add_argument("query")
    add("topics", "unresolved", "semantic", stream="", limit=0, search="")
    add("stats")
    add("sql").add_argument("query")
    add("messages", "all", stream="", topic="", sender="", since="", until="", days=0, hours=0, last=0, limit=200)
    add("attachments", stream="", topic="", status="", limit=100)
    add("attachments-fetch", "force", limit=0)
    add("backfill-indexes", batch=0)
    add("embeddings-backfill", "force", limit=0, batch=0)
    add("embeddings-status")
    return p


def run(spark: SparkSession, arguments: list[str], now: datetime | None = None) -> str:
    """The command's output. Times are relative to `now`."""
    a, now = parser().parse_args(arguments), now or datetime.now(UTC)
    c = config.load(a.config)
    root = a.archive or c.archive
    archive = Archive.open(spark, root)
    commands = {
        "init": lambda: _init(archive, c, a),
        "doctor": lambda: _doctor(archive, c),
        "sync": lambda: _sync(archive, c, a, now),
        "search": lambda: T.format_hits(T.search_messages(archive, a.query, now, a.stream, a.resolved, a.limit)),
        "topics": lambda: _topics(archive, c, a, now),
        "stats": lambda: S.tsv(S.stats(archive)),
        "sql": lambda: S.tsv(archive.sql(a.query)),
        "messages": lambda: _messages(archive, a, now),
        "attachments": lambda: S.tsv(S.attachments(archive, a.stream, a.topic, a.status, a.limit)),
        "attachments-fetch": lambda: _fetch(archive, c, a.limit, a.force, now),
        "backfill-indexes": lambda: f"{I.rebuild(archive, a.batch, _progress).message_attachments.count()} attachments",
        "embeddings-backfill": lambda: _embed(archive, c, a, now),
        "embeddings-status": lambda: _embedded(archive, c),
    }
    return commands[a.command]()


def _init(archive: Archive, c: config.Config, a) -> str:
    """With credentials the server is asked for its name and the settings are saved; else the URL is the name."""
    if a.from_json:
        c = config.fill_from_json(c, a.from_json, a.channel)
    if a.url:
        c = replace(c, server=replace(c.server, url=a.url))
    url, name = c.server.url, c.server.url
    if c.server.email and c.server.api_key:
        told = _client(c).settings()
        name = told.get("realm_name") or url
        config.save(c, a.config)
    row = archive.spark.createDataFrame([(1, url, name)], "id long, url string, name string")
    archive.commit({"organizations": U.upsert("organizations", archive.organizations, archive.organizations.limit(0).unionByName(row, allowMissingColumns=True))})
    return f"archive at {archive.root}\norganization: {name}"


def _doctor(archive: Archive, c: config.Config) -> str:
    """What can be read, and whether the server knows us."""
    lines = [f"{n}: {'ok' if ok else 'unreadable'}" for n, ok in archive.check().items()]
    if not (c.server.email and c.server.api_key):
        return "\n".join([*lines, "server: not set up"])
    try:
        return "\n".join([*lines, f"server: reachable, {len(_client(c).streams())} streams"])
    except (OSError, RuntimeError, ValueError) as e:
        return "\n".join([*lines, f"server: {e}"])


def _progress(done: int, total: int) -> None:
    print(f"{done} of {total} parts", file=sys.stderr)


def _vectorizer(e: config.Embeddings, batch: int = 0) -> Vectorizer:
    provider = e.provider.strip().lower()
    if provider in ("", "local", "hash"):
        return HashVectorizer(e.model)
    if provider == "ollama":
        return model_server(e.base, e.model, batch or e.batch_size)
    raise ValueError(f"unknown provider of embeddings {e.provider!r}")


def _embedded(archive: Archive, c: config.Config) -> str:
    """How many topics have a vector of the model, and which kinds of vectors there are."""
    e = c.embeddings
    head = f"enabled {str(e.enabled).lower()}, model {e.model}, provider {e.provider}, base {e.base}"
    return "\n".join([S.tsv(V.coverage(archive, e.model)), head, S.tsv(V.vector_stats(archive, e.model))])


def _client(c: config.Config) -> rest.Client:
    c.server.check()
    return rest.Client(c.server.url, c.server.email, c.server.api_key)


def _sync(archive: Archive, c: config.Config, a, now: datetime) -> str:
    """From a landing folder, or from the server by the chat_rest source; bookmarks say where to go on."""
    spark = archive.spark
    since = C.time_bound(a.since, False) if a.since else None
    with archive.lock():
        archive, failed = _synced(Archive.open(spark, archive.root), c, a, since, now)
    if a.with_media:
        _fetch(archive, c, 0, False, now)
    if failed:
        raise RuntimeError("; ".join(failed))
    return f"{archive.messages.count()} messages"


def _synced(archive: Archive, c: config.Config, a, since: datetime | None, now: datetime) -> tuple[Archive, list[str]]:
    """The archive after the new messages, and what went wrong with streams that failed; the lock is held."""
    spark = archive.spark
    asked = [x for x in a.streams.split(",") if x]
    if a.landing:
        streams, users, messages = (landing.read(spark, a.landing, k) for k in ("streams", "users", "messages"))
        chosen = S.choose_streams(landing.as_streams(streams), c.sync.streams, c.sync.exclude_streams, asked)
        direct = messages.where("type = 'private'")
        wanted = messages.join(chosen.selectExpr("id AS stream_id"), "stream_id", "left_semi").unionByName(direct)
        roster = landing.as_users(users)
    else:
        client = _client(c)
        made = lambda rows, kind: spark.createDataFrame([tuple(r.get(f.name) for f in kind.fields) for r in rows], kind)
        chosen = S.choose_streams(landing.as_streams(made(client.streams(), landing.STREAM)), c.sync.streams, c.sync.exclude_streams, asked)
        roster = landing.as_users(made(client.users(), landing.USER))
        names = [(r["id"], r["name"]) for r in chosen.collect()] + [(U.DIRECT_ID, "")]
        parts = [[i, n, 0 if a.full else U.bookmark(archive, i)] for i, n in names]
        spark.dataSource.register(rest.MessageSource)
        options = {
            "url": c.server.url, "email": c.server.email, "api_key": c.server.api_key, "streams": json.dumps(parts),
            "concurrency": c.sync.concurrency, "requests_a_minute": c.sync.requests_a_minute,
        }
        wanted = spark.read.format("chat_rest").options(**options).load()
    whole = lambda t, new: U.upsert(t, getattr(archive, t), getattr(archive, t).limit(0).unionByName(new, allowMissingColumns=True), kept=("org_id",))
    wanted = staged(wanted)  # asked for once, read twice
    failed = [r["content"] for r in wanted.where(F.col("type") == rest.FAILED).orderBy("content").collect()]
    archive = archive.commit({"streams": whole("streams", chosen), "users": whole("users", roster)}, locked=True)
    good = wanted.where(F.coalesce("type", F.lit("")) != rest.FAILED)
    if not a.quiet:
        _tell_streams(good, chosen)
    return I.ingest(archive, good, now, since, locked=True), failed


def _tell_streams(messages: DataFrame, streams: DataFrame) -> None:
    """How many messages came of each stream; a row for each stream."""
    names = streams.select(F.col("id").alias("stream_id"), "name")
    own = messages.select(F.when(F.col("type") == "private", U.DIRECT_ID).otherwise(F.col("stream_id")).alias("stream_id"))
    for r in own.groupBy("stream_id").count().join(names, "stream_id", "left").orderBy("stream_id").collect():
        print(f"{r['name'] or U.DIRECT_STREAM}: {r['count']} messages", file=sys.stderr)


def _topics(archive: Archive, c: config.Config, a, now: datetime) -> str:
    if a.semantic:
        found = V.semantic_topics(archive, _vectorizer(c.embeddings), a.search, a.stream, a.unresolved, a.limit)
    elif a.search:
        found = T.search_topics(archive, a.search, now, a.stream, a.unresolved, a.limit)
    else:
        found = S.topics(archive, a.stream, a.unresolved, a.limit)
    return S.tsv(found)


def _messages(archive: Archive, a, now: datetime) -> str:
    if a.limit <= 0 and not a.all:
        raise ValueError("limit is to be positive unless all are asked for")
    f = S.MessageFilter(a.stream, a.topic, a.sender, a.since, a.until, a.days, a.hours, a.last, S.ALL if a.all else a.limit)
    return S.message_lines(S.messages(archive, f.narrow(), now))


def _fetch(archive: Archive, c: config.Config, limit: int, force: bool, now: datetime) -> str:
    with archive.lock():
        archive = Archive.open(archive.spark, archive.root)
        client = replace(_client(c), gap=rest.gap(c.sync.requests_a_minute, c.sync.concurrency))
        updates = media.fetch_pending(archive.message_attachments, c.media_dir, client.download, now, limit, force, c.sync.concurrency)
        updates = staged(updates)  # fetched once, read twice
        archive.commit({"message_attachments": U.update_media(archive.message_attachments, updates)}, locked=True)
    return S.tsv(media.counts(updates))


def _embed(archive: Archive, c: config.Config, a, now: datetime) -> str:
    e = c.embeddings
    if not e.enabled:
        raise RuntimeError("embeddings are switched off")
    options = V.EmbedOptions(e.enabled, e.provider, e.sample_messages, a.limit, a.force)
    vectorizer = _vectorizer(e, a.batch)
    with archive.lock():
        archive = Archive.open(archive.spark, archive.root)
        vectors, n = V.embed_topics(archive, vectorizer, options, now)
        archive.commit({"topic_embeddings": vectors}, locked=True)
    return f"embedded {n}"
