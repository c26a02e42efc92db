"""Listings, search, vectors, upserts and ingest over small archives."""

import json
import threading
import time
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from threadloom import archive as archive_module
from threadloom.archive import Archive
from threadloom.functions.vectors import HashVectorizer
from threadloom.operators import fulltext as T
from threadloom.operators import semantic as V
from threadloom.operators import slices as S
from threadloom.operators import upsert as U
from threadloom.schema import SCHEMAS
from threadloom.sources import landing, media, rest
from threadloom.sources.lock import LockHeldError, LockLostError, SharedLock
from threadloom.streaming import ingest as I

NOW = datetime(2026, 5, 1, 12, tzinfo=UTC)


def archive_of(spark, rows, users, resolved=()):
    """rows: (id, stream, topic, sender, time, text)."""
    streams = {n: i for i, n in enumerate(dict.fromkeys(r[1] for r in rows), 1)}
    topics = {k: i for i, k in enumerate(dict.fromkeys((r[1], r[2]) for r in rows), 1)}
    at = lambda c: F.col(c).cast("timestamp").alias(c)
    m = spark.createDataFrame(
        [(r[0], streams[r[1]], topics[r[1], r[2]], r[3], r[4], r[5], r[5]) for r in rows],
        "id long, stream_id long, topic_id long, sender_id long, timestamp timestamp, content string, content_text string",
    ).withColumn("timestamp", at("timestamp"))
    t = spark.createDataFrame([(i, streams[s], n, n in resolved) for (s, n), i in topics.items()], "id long, stream_id long, name string, resolved boolean")
    a = Archive(
        spark,
        {
            "streams": spark.createDataFrame([(i, n) for n, i in streams.items()], "id long, name string"),
            "topics": t,
            "users": spark.createDataFrame(list(users.items()), "id long, full_name string"),
            "messages": m,
        },
    )
    a.tables["topics"] = U.recompute_topics(a.topics, a.messages)
    return a


@pytest.fixture(scope="module")
def chat(spark):
    t = lambda s: datetime.fromisoformat(s).replace(tzinfo=UTC)
    rows = [
        (1001, "general", "deployment pipeline", 20, t("2026-04-28T10:00:00"), "Released v2.5 to production. Deploy went smoothly."),
        (1002, "general", "deployment pipeline", 21, t("2026-04-28T11:00:00"), "CI pipeline passed all checks before the deploy."),
        (2001, "general", "onboarding checklist", 20, t("2026-04-01T09:00:00"), "New engineer onboarding setup steps: install Go, clone repo."),
        (2002, "general", "onboarding checklist", 21, t("2026-04-02T10:00:00"), "Onboarding doc updated with Docker setup instructions."),
        (3001, "general", "random banter", 20, t("2025-01-10T08:00:00"), "Did you see the game last night?"),
        (4001, "dev", "bug in database layer", 20, t("2026-04-25T14:00:00"), "Found a nil pointer dereference in the database query function."),
        (4002, "dev", "bug in database layer", 21, t("2026-04-26T15:00:00"), "Fixed the database bug. Patch pushed."),
    ]
    return archive_of(spark, rows, {20: "Sender", 21: "Alice"}, {"deployment pipeline"})


def names(df):
    return [r["topic_name"] for r in df.collect()]


def test_topic_search(chat):
    m, t = T.message_index(chat), T.topic_index(chat)
    search = lambda q, **k: T.search_topics(chat, q, NOW, messages=m, topics=t, **k)
    assert "onboarding checklist" in names(search("onboarding"))
    assert names(search("pointer")) == ["bug in database layer"]
    assert names(search("database")) == ["bug in database layer"]
    assert all(r["stream_name"] == "dev" for r in search("deploy OR database", stream="dev").collect())
    assert not any(r["resolved"] for r in search("deploy", unresolved_only=True).collect())
    assert search("xyzzy_nonexistent").count() == 0
    assert len(names(search("the OR onboarding", limit=1))) == 1
    hits = {r["topic_name"]: r for r in search("pipeline").collect()}
    assert "pipeline" in hits["deployment pipeline"]["best_snippet"]
    with pytest.raises(ValueError, match="empty"):
        search("")


def test_message_search_ranks(chat):
    hits = T.search_messages(chat, "deploy", NOW).collect()
    assert [h["message_id"] for h in hits] == [1002, 1001] and all(h["resolved"] for h in hits)
    assert T.search_messages(chat, "database", NOW, resolved_only=True).count() == 0
    assert "[resolved]" in T.format_hits(T.search_messages(chat, "deploy", NOW))
    assert T.format_hits(T.search_messages(chat, "nothing_here", NOW)) == "No results."


@pytest.fixture(scope="module")
def slices(spark):
    ago = lambda **k: NOW - timedelta(**k)
    rows = [
        (1001, "general", "deploys", 10, ago(days=8), "deployed v1"), (1002, "general", "deploys", 11, ago(days=5), "deployed v2"),
        (1003, "general", "deploys", 10, ago(hours=1), "deployed v3"), (2001, "general", "random", 11, ago(days=2), "hello world"),
        (2002, "general", "random", 10, ago(minutes=30), "bye world"), (3001, "dev", "bugs", 11, ago(days=3), "nil pointer"),
    ]
    return archive_of(spark, rows, {10: "Alice", 11: "Bob", 12: "A_lice"})


@pytest.mark.parametrize(
    ("f", "wanted"),
    [
        ({"stream": "general"}, [1001, 1002, 2001, 1003, 2002]),
        ({"stream": "general", "topic": "deploys"}, [1001, 1002, 1003]),
        ({"sender": "alice"}, [1001, 1003, 2002]),
        ({"sender": "A_"}, []),
        ({"hours": 2}, [1003, 2002]),
        ({"since": (NOW - timedelta(days=6)).isoformat()}, [1002, 3001, 2001, 1003, 2002]),
        ({"sender": "Bob", "last": 2}, [3001, 2001]),
        ({"limit": S.ALL}, [1001, 1002, 3001, 2001, 1003, 2002]),
        ({"stream": "dev"}, [3001]),
    ],
)
def test_slices(slices, f, wanted):
    assert [r["message_id"] for r in S.messages(slices, S.MessageFilter(**f).narrow(), NOW).collect()] == wanted


@pytest.mark.parametrize("f", [{}, {"days": -1, "stream": "x"}, {"last": -1}, {"stream": "x", "limit": -2}])
def test_slices_need_a_filter(f):
    with pytest.raises(ValueError):
        S.MessageFilter(**f).narrow()


def test_status(slices):
    with pytest.raises(ValueError, match="status"):
        S.attachments(slices, status="lost")
    assert S.stats(slices).first().asDict() == {"streams": 2, "topics": 3, "users": 3, "messages": 6, "size_in_bytes": 0}


def test_sql(chat):
    assert chat.sql("SELECT count(*) AS n FROM messages").first()["n"] == 7
    with pytest.raises(ValueError, match="queries"):
        chat.sql("DROP TABLE messages")


def test_vectors(spark, chat):
    v = HashVectorizer("fake", 4)
    on = V.EmbedOptions(enabled=True)
    with pytest.raises(RuntimeError):
        V.embed_topics(chat, v, V.EmbedOptions(), NOW)
    vectors, n = V.embed_topics(chat, v, V.EmbedOptions(enabled=True, limit=3), NOW)
    assert n == 3 and vectors.count() == 3
    some = Archive(spark, chat.tables | {"topic_embeddings": vectors})
    vectors, n = V.embed_topics(some, v, on, NOW)
    full = Archive(spark, chat.tables | {"topic_embeddings": vectors.cache()})
    assert n == 1 and V.embed_topics(full, v, on, NOW)[1] == 0
    assert V.coverage(full, "fake").first().asDict() == {"total": 4, "embedded": 4, "missing": 0}
    assert V.vector_stats(full, "fake").first()["dimension"] == 4
    with pytest.raises(V.DimensionMismatchError):
        V.embed_topics(full, HashVectorizer("fake", 8), on, NOW)
    assert V.embed_topics(full, HashVectorizer("fake", 8), V.EmbedOptions(enabled=True, force=True), NOW)[1] == 4
    hits = V.semantic_topics(full, v, "x", stream="dev", limit=2).collect()
    assert [h["topic_name"] for h in hits] == ["bug in database layer"]
    assert V.semantic_topics(full, v, "x", unresolved=True).count() == 3
    with pytest.raises(LookupError):
        V.semantic_topics(full, HashVectorizer("other"), "x")


def test_topic_text(chat):
    texts = {r["topic_id"]: r["text"] for r in V.topic_texts(chat, sample=1).collect()}
    assert texts[1] == "#general > deployment pipeline\nReleased v2.5 to production. Deploy went smoothly."


def test_sparse_merge(spark):
    kind = "id long, org_id long, email string, full_name string, is_bot boolean, avatar_url string, synced_at timestamp"
    old = spark.createDataFrame([(50, 1, "b@x", "Old", True, "/p.png", None)], kind)
    new = spark.createDataFrame([(50, 1, "", "New", False, "", None), (99, 1, "", "Unknown", False, "", None)], kind)
    got = {r["id"]: r for r in U.merge_senders(old, new).collect()}
    assert (got[50]["full_name"], got[50]["email"], got[50]["is_bot"], got[50]["avatar_url"]) == ("New", "b@x", True, "/p.png")
    assert got[99]["full_name"] == "Unknown"


def test_topics_keep_their_ids(spark):
    empty = Archive(spark, {}).topics
    seen = lambda *r: spark.createDataFrame([(1, *x) for x in r], "org_id long, stream_id long, name string")
    one = U.assign_topics(empty, seen((1, "b"), (1, "a"), (2, ""), (1, "a")), NOW)
    ids = {(r["stream_id"], r["name"]): r["id"] for r in one.collect()}
    assert ids == {(1, "a"): 1, (1, "b"): 2, (2, U.NO_TOPIC): 3}
    two = U.assign_topics(U.set_resolved(one, 1, True), seen((1, "✔ a"), (1, "b")), NOW)
    rows = {(r["stream_id"], r["name"]): (r["id"], r["resolved"]) for r in two.collect()}
    assert rows == {(1, "a"): (1, True), (1, "b"): (2, False), (2, U.NO_TOPIC): (3, False), (1, "✔ a"): (4, True)}


def message(i, html="<p>hi</p>", topic="t", stream=10, sender=20, at=1_700_000_000, **more):
    return {"id": i, "stream_id": stream, "sender_id": sender, "sender_full_name": f"S{sender}", "content": html, "timestamp": at + i, "topic": topic} | more


def test_ingest(spark, tmp_path):
    root = str(tmp_path / "archive")
    a = Archive.open(spark, root).commit({"streams": spark.createDataFrame([(10, "general")], "id long, name string")})
    upload = '<p><a class="message_inline_ref" href="/user_uploads/1/ab/todo.txt">todo.txt</a> {} body</p>'
    batch = lambda *rows: spark.createDataFrame(spark.sparkContext.parallelize([json.dumps(r) for r in rows]).map(lambda x: (x,)), "j string").select(
        F.from_json("j", landing.MESSAGE).alias("m")
    ).select("m.*")
    first = [
        message(100, upload.format("needle")), message(101, '<p><span class="user-mention" data-user-id="42">@Al</span></p>', edit_timestamp=1_700_000_500),
        message(102, "<p>secret words</p>", type="private"), message(103, topic="", subject="old style"),
    ]
    a = I.ingest(a, batch(*first), NOW)
    assert [r["message_id"] for r in T.search_messages(a, "needle", NOW).collect()] == [100]
    assert T.search_messages(a, "secret", NOW, stream=U.DIRECT_STREAM).count() == 1
    assert {r["name"]: r["message_count"] for r in a.topics.collect()} == {"t": 2, U.DIRECT_TOPIC: 1, "old style": 1}
    assert (U.bookmark(a, 10), U.bookmark(a, 0), U.bookmark(a, 77)) == (103, 102, 0)
    assert a.message_mentions.first()["mentioned_user_id"] == 42

    up = a.message_attachments.first()
    done = spark.createDataFrame([(up["id"], "p", "fetched", NOW, "", 12, " ")], "id long, media_path string, media_status string, media_fetched_at timestamp, media_content_type string, media_bytes long, media_error string")
    a = a.commit({"message_attachments": U.update_media(a.message_attachments, done)})
    a = I.ingest(a, batch(message(100, upload.format("newneedle")), message(101, "<p>gone</p>"), message(90, at=1)), NOW, since=datetime(2020, 1, 1, tzinfo=UTC))
    assert T.search_messages(a, "needle", NOW).count() == 0 and T.search_messages(a, "newneedle", NOW).count() == 1
    assert a.message_mentions.count() == 0 and a.messages.count() == 4
    kept = a.message_attachments.first()
    assert (kept["media_status"], kept["media_bytes"], kept["media_error"]) == ("fetched", 12, None)
    again = I.rebuild(I.rebuild(a))
    assert (again.message_attachments.count(), again.message_mentions.count()) == (1, 0)
    assert U.bookmark(again, 10) == 103 and all(again.check().values())


def test_only_touched_parts_are_written(spark, tmp_path):
    from threadloom.archive import PART_IDS, ConflictError

    a = Archive.open(spark, str(tmp_path / "a"))
    batch = lambda *rows: spark.read.schema(landing.MESSAGE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    one = I.ingest(a, batch(message(1, topic="x"), message(PART_IDS + 5, topic="x"), message(2, topic="y")), NOW)
    two = I.ingest(one, batch(message(1, "<p>moved</p>", topic="y", edit_timestamp=1_700_000_900)), NOW)
    assert one.parts("messages") == two.parts("messages") == [0, 1]
    laid = two.pointer["messages"].items() - one.pointer["messages"].items()
    assert one.pointer["messages"].items() < two.pointer["messages"].items() and [k.split("+")[0] for k, _ in laid] == ["0"]
    assert {r["name"]: (r["message_count"], r["last_message_id"]) for r in two.topics.collect()} == {"x": (1, PART_IDS + 5), "y": (2, 2)}
    assert two.messages.count() == 3 and two.size_in_bytes() > 0
    with pytest.raises(ConflictError):
        one.commit({"users": one.users})


def test_stream(spark, tmp_path):
    land, root = tmp_path / "land" / "messages", str(tmp_path / "archive")
    land.mkdir(parents=True)
    (land / "1.json").write_text("\n".join(json.dumps(message(i)) for i in range(1, 6)))
    go = lambda: I.run_stream(landing.stream(spark, str(tmp_path / "land")), root, str(tmp_path / "marks"), NOW).awaitTermination()
    go()
    (land / "2.json").write_text("\n".join(json.dumps(message(i)) for i in range(5, 9)))
    go()
    a = Archive.open(spark, root)
    assert a.messages.count() == 8 and U.bookmark(a, 10) == 8 and a.topics.first()["message_count"] == 8


def test_a_server_as_a_stream(spark, tmp_path):
    """Batches go on from the last ids; one that was stored but not marked as done comes again and changes nothing; a
    stream that fails doesn't hold up the others."""
    held, broken = {"general": [1, 2, 3, 5], "dev": [4]}, {"dev"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked = parse_qs(urlsplit(self.path).query)
            name = json.loads(asked["narrow"][0])[0]["operand"]
            ids, anchor = held[name], asked["anchor"][0]
            page = ids[-1:] if anchor == "newest" else [i for i in ids if i >= (0 if anchor == "oldest" else int(anchor))][:2]
            found = [message(i, f"<p>text {i}</p>") for i in page]
            body = json.dumps({"messages": found, "found_newest": not page or page[-1] == ids[-1]}).encode()
            self.send_response(500 if name in broken else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(rest.MessageSource)
    root, marks = str(tmp_path / "a"), str(tmp_path / "marks")
    Archive.open(spark, root).commit({"streams": spark.createDataFrame([(10, "general"), (11, "dev")], "id long, name string")})

    def go():
        options = {"url": f"http://127.0.0.1:{server.server_port}", "email": "e", "api_key": "k", "streams": json.dumps([[10, "general", 0], [11, "dev", 0]]), "concurrency": 2}
        I.run_stream(spark.readStream.format("chat_rest").options(**options).load(), root, marks, NOW).awaitTermination()
        return Archive.open(spark, root)

    assert [r["id"] for r in go().messages.orderBy("id").collect()] == [1, 2, 3, 5]
    held["general"] += [6, 8]
    broken.clear()
    ingest = I.ingest

    def dies_after(*args, **more):
        ingest(*args, **more)
        raise RuntimeError("the driver died")

    with pytest.MonkeyPatch.context() as m:
        m.setattr(I, "ingest", dies_after)
        with pytest.raises(Exception, match="the driver died"):
            go()
    held["general"].append(9)
    go()  # the batch that wasn't marked as done
    a = go()
    server.shutdown()
    assert [r["id"] for r in a.messages.orderBy("id").collect()] == [1, 2, 3, 4, 5, 6, 8, 9]
    assert (U.bookmark(a, 10), U.bookmark(a, 11)) == (9, 4) and sum(r["message_count"] for r in a.topics.collect()) == 8
    assert [r["rowid"] for r in T.message_index(a).scores("text AND 6").collect()] == [6]


def test_media(spark, tmp_path):
    rows = [(i, f"/user_uploads/1/{i}/f.txt", "f.txt", None if i else "error") for i in range(105)]
    rows += [(200, "/user_uploads/x.txt", "x.txt", "fetched"), (201, "/bad", "", None), (202, "/user_uploads/gone", "", ""), (203, None, "", None), (204, "https://else/user_uploads/a", "", None)]
    ups = spark.createDataFrame(rows, "id long, url string, file_name string, media_status string").selectExpr("*", "'text/plain' AS content_type", "timestamp_seconds(id) AS timestamp")

    def download(url):
        if url == "/user_uploads/gone":
            raise ValueError("no upload")
        return (b"x" * 12, "image/png") if url.startswith("/user_uploads/1/7/") else b"x" * 12

    got = media.fetch_pending(ups, str(tmp_path), download, NOW, concurrency=3)
    assert got.rdd.getNumPartitions() == 3
    assert {r["media_status"]: r["n"] for r in media.counts(got).collect()} == {"fetched": 105, "error": 1}
    told = {r["id"]: r for r in got.collect()}
    assert not told.keys() & {200, 201, 203, 204}  # what isn't an upload is never tried, and stays as it is
    assert (told[7]["media_content_type"], told[8]["media_content_type"]) == ("image/png", "text/plain")
    assert (told[202]["media_path"], told[202]["media_error"], told[202]["media_fetched_at"].replace(tzinfo=UTC)) == ("gone", "no upload", NOW)
    some = media.fetch_pending(ups.where("id < 105"), str(tmp_path), download, NOW, limit=100, concurrency=3)
    assert some.count() == 100 and some.rdd.getNumPartitions() == 3
    assert (tmp_path / "1/7/f.txt").read_bytes() == b"x" * 12


def test_media_streams_into_a_shared_file_system(spark, tmp_path):
    """Chunks as they come, a URI as the folder, nothing left of a body that breaks off."""
    ups = spark.createDataFrame([(1, "/user_uploads/a.bin", "", ""), (2, "/user_uploads/b.bin", "", "")], "id long, url string, file_name string, content_type string")
    ups = ups.selectExpr("*", "CAST(NULL AS STRING) AS media_status", "timestamp_seconds(id) AS timestamp")

    def download(url):
        yield b"ab" * 500
        if url.endswith("b.bin"):
            raise OSError("broken off")
        yield b"c"

    got = {r["id"]: r for r in media.fetch_pending(ups, f"file://{tmp_path}/m", download, NOW).collect()}
    assert (got[1]["media_status"], got[1]["media_bytes"], got[2]["media_status"]) == ("fetched", 1001, "error")
    assert [x.name for x in (tmp_path / "m").iterdir()] == ["a.bin"] and (tmp_path / "m/a.bin").stat().st_size == 1001


def test_search_reads_the_kept_index(spark, tmp_path):
    """Postings follow new, edited and moved messages without the texts; a rebuild gives the same."""
    root = str(tmp_path / "a")
    batch = lambda rows: spark.createDataFrame([tuple(r.get(f.name) for f in landing.MESSAGE.fields) for r in rows], landing.MESSAGE)
    archive = Archive.open(spark, root).commit({"streams": spark.createDataFrame([(10, "general")], "id long, name string")})
    assert archive.indexed and archive.has("part_rollups")
    far = 3 * archive_module.PART_IDS
    first = [message(i) | {"content": f"<p>common word{i}</p>"} for i in (1, 2, far, far + 1)]
    archive = I.ingest(archive, batch(first), NOW)
    edit = message(2) | {"content": "<p>common changed</p>", "edit_timestamp": message(2)["timestamp"] + 50, "topic": "elsewhere"}
    read = []
    some = Archive.some_parts
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Archive, "some_parts", lambda self, t, p, other=False: read.append((t, other)) or some(self, t, p, other))
        archive = I.ingest(archive, batch([edit, message(3)]), NOW)
    assert ("messages", True) not in read and ("part_rollups", True) in read  # no message of another part is read

    def found(a, query):
        return {r["rowid"]: round(r["bm25"], 9) for r in T.message_index(a).scores(query).collect()}

    plain = Archive(spark, {n: archive.tables[n] for n in SCHEMAS})  # searched through the texts
    for query in ("common", "changed OR word1", "word2", "elsewhere", "topic_name : elsewhere"):
        assert found(archive, query) == found(plain, query)
    assert found(archive, "word2") == {} and set(found(archive, "changed")) == {2}
    assert archive.topics.select(*sorted(archive.topics.columns)).exceptAll(U.recompute_topics(archive.topics, archive.messages).select(*sorted(archive.topics.columns))).count() == 0
    names = lambda a: [(r["topic_name"], round(r["rank"], 9)) for r in T.search_topics(a, "elsewhere OR common", NOW).collect()]
    assert names(archive) == names(plain) != []
    told = []
    again = I.rebuild(archive, 1, lambda done, of: told.append((done, of)))
    assert told == [(1, 2), (2, 2)] and found(again, "common") == found(archive, "common") and names(again) == names(plain)
    assert again.messages.count() == 5


def test_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive_module, "KEEP_SECONDS", -60)
    root = str(tmp_path / "a")
    archive = Archive.open(spark, root)
    org = lambda n: spark.createDataFrame([(1, "u", n)], "id long, url string, name string")
    for n in "abcd":
        before, archive = archive, archive.commit({"organizations": org(n)})
    assert len(list((tmp_path / "a/organizations").iterdir())) == 2
    assert (before.organizations.first()["name"], archive.organizations.first()["name"]) == ("c", "d")
    with archive.lock():
        with pytest.raises(LockHeldError):
            archive.commit({"organizations": org("e")})
        assert archive.commit({"organizations": org("f")}, locked=True).organizations.first()["name"] == "f"
    for f in (tmp_path / "a/organizations").rglob("*.parquet"):
        f.write_bytes(b"no table")
        f.with_name(f".{f.name}.crc").unlink()
    assert not Archive.open(spark, root).check()["organizations"]


def test_shared_lock(spark, tmp_path):
    path = spark._jvm.org.apache.hadoop.fs.Path(str(tmp_path / "x/writer.lock"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    one, two = SharedLock(fs, path), SharedLock(fs, path)
    with one, pytest.raises(LockHeldError):
        two.acquire()
    with two:
        pass
    two.release()


def test_a_dead_writers_lease_runs_out(spark, tmp_path, monkeypatch):
    """While the first writer is alive its lease is kept; after that the second takes over, and the first is refused."""
    path = spark._jvm.org.apache.hadoop.fs.Path(str(tmp_path / "a/writer.lock"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    make = lambda self: SharedLock(fs, path, lease=1.5)
    monkeypatch.setattr(archive_module._Store, "lock", make)
    monkeypatch.setattr(archive_module._Store, "_path", lambda self, name: path if name == "writer.lock" else spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root))
    a = Archive.open(spark, str(tmp_path / "a"))
    org = lambda n: {"organizations": spark.createDataFrame([(1, "u", n)], "id long, url string, name string")}
    one, two = make(a), make(a)
    one.acquire()
    time.sleep(2.5)
    with pytest.raises(LockHeldError):
        two.acquire()  # the first has kept it fresh
    a = a.commit(org("first"), locked=True)
    one._stop.set()  # it dies, or stands still
    time.sleep(2)
    two.acquire()
    SharedLock.held[path.toString()] = one
    with pytest.raises(LockLostError):
        a.commit(org("late"), locked=True)
    SharedLock.held[path.toString()] = two
    assert a.commit(org("second"), locked=True).organizations.first()["name"] == "second"
    one.release()
    two.check()  # what the first one does is nothing to the second
    two.release()
    assert not fs.exists(path) and len(list((tmp_path / "a").glob("writer.lock*"))) == 0


def test_search_at_the_recency_pole(chat):
    """A message thirty days after `as_of` has no recency: it comes last instead of failing the search."""
    at = chat.messages.orderBy("id").first()["timestamp"].replace(tzinfo=UTC)
    word = "OR".join(f" {w} " for w in chat.messages.orderBy("id").first()["content_text"].split()[:1])
    rows = T.search_messages(chat, word, at - timedelta(days=30)).collect()
    assert rows and rows[-1]["rank"] is None


def test_uploads_are_of_their_own_stream(spark):
    tables = {
        "streams": spark.createDataFrame([(1, "now"), (2, "then")], "id long, name string"),
        "topics": spark.createDataFrame([(5, "t")], "id long, name string"),
        "messages": spark.createDataFrame([(9, 1, 5, 3)], "id long, stream_id long, topic_id long, sender_id long"),
        "message_attachments": spark.createDataFrame([(7, 9, 2, 5, "/u")], "id long, message_id long, stream_id long, topic_id long, url string"),
    }
    a = Archive(spark, tables)
    assert [r["stream_name"] for r in S.attachments(a).collect()] == ["then"]
    assert S.attachments(a, stream="now").count() == 0
