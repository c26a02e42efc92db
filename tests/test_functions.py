"""Rendered messages, vectors, times, settings, locks."""

import json
import threading
import time
from dataclasses import replace
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import columns as C
from threadloom.functions.html import MOST_BYTES, bounded, extract, file_name
from threadloom.functions.vectors import HashVectorizer, HttpVectorizer, ModelServerError, decode, dot, encode, is_unit_length, model_server, normalised, unit
from threadloom.operators import upsert as U
from threadloom.sources import config, landing, rest
from threadloom.sources.lock import LockHeldError, WriterLock
from threadloom.sources.media import UnsafePathError, cache_path
from threadloom.sources.rest import Client, HttpError, Response

UPLOAD = '<a class="message_inline_ref" href="/user_uploads/{}">{}</a>'


def test_mention_and_upload():
    text, mentions, uploads = extract(
        '<p>Hello <span class="user-mention" data-user-id="42">@Alice Example</span></p><p>'
        + UPLOAD.format("2/ab/todo.txt", "todo.txt") + " remember the zeta task</p>"
    )
    assert text == "Hello @Alice Example todo.txt remember the zeta task"
    assert [(m.user_id, m.name, m.kind) for m in mentions] == [(42, "Alice Example", "user")]
    assert [(u.file_name, u.indexed, u.text) for u in uploads] == [("todo.txt", True, "todo.txt remember the zeta task")]


def test_binary_upload_has_no_text():
    _, _, (u,) = extract("<p>" + UPLOAD.format("2/ab/photo.png", "photo.png") + " binary-looking upload</p>")
    assert (u.content_type, u.indexed, u.text) == ("", False, "")


def test_wildcard_is_no_mention():
    _, mentions, _ = extract(
        '<p>Hello <span class="user-mention" data-user-id="*">@all</span> and <span class="user-mention" data-user-id="42">@Alice</span>'
        ' <a class="user-group-mention" data-user-group-id="7">@team</a></p>'
    )
    assert [(m.user_id, m.kind) for m in mentions] == [(42, "user"), (7, "group")]


def test_text_of_markup():
    assert extract("<p>a<b>b</b> &amp; c<!-- no -->d<p>e<br>f<script>g</script>")[0] == "a b & c d e f g"
    assert extract("") == ("", [], [])
    _, _, (u,) = extract("<p>first<p>" + UPLOAD.format("x/a.md", "a.md") + " own")
    assert u.text == "a.md own"


def test_names_and_bounds():
    assert file_name("/user_uploads/1/a%20b.txt", "t") == "a b.txt"
    assert file_name("/user_uploads/%zz", " t ") == "t"
    assert len(bounded("é" * MOST_BYTES).encode()) <= MOST_BYTES
    assert cache_path("/user_uploads/1/a%20b.txt", "f") == "1/a b.txt"
    assert cache_path("/user_uploads/../x", "f") == "f"
    with pytest.raises(UnsafePathError):
        cache_path("/user_uploads/", "..")


@given(st.lists(st.floats(width=32, allow_nan=False), max_size=20))
def test_codec_round_trip(v):
    assert decode(encode(v)) == [float(np.float32(x)) for x in v]


def test_vectors(spark):
    with pytest.raises(ValueError, match="3 bytes"):
        decode(b"abc")
    v = HashVectorizer("m", 8)
    a, b = v.embed(["x", "y"])
    assert abs(float((a * a).sum()) - 1) < 1e-5 and not np.array_equal(a, b) and np.array_equal(a, v.embed(["x"])[0])
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = row.select(normalised(F.col("a")).alias("a"), normalised(F.col("z")).alias("z"), dot(F.col("a"), [1.0, 0.5]).alias("d")).first()
    assert r["a"] == pytest.approx([0.6, 0.8]) and r["z"] == [0.0, 0.0] and r["d"] == 5.0
    assert unit(np.array([0.0, 2.0])).tolist() == [0.0, 1.0]
    h = HttpVectorizer("Model:v1", lambda q: {"embeddings": [[2.0, 0.0]] * len(q["input"])}, batch=2)
    assert [x.tolist() for x in h.embed(["a", "b", "c"])] == [[1.0, 0.0]] * 3 and h.available(["model:latest"])
    with pytest.raises(ValueError, match="received"):
        HttpVectorizer("m", lambda q: {"embeddings": []}).embed(["a"])


def test_times():
    assert C.time_bound("2024-01-02", True) == datetime(2024, 1, 2, 23, 59, 59, tzinfo=UTC)
    assert C.time_bound("2024-01-02T01:00:00+02:00", False) == datetime(2024, 1, 1, 23, tzinfo=UTC)
    with pytest.raises(ValueError, match="RFC 3339"):
        C.time_bound("yesterday", False)


def test_flags(spark):
    names = [("✔ a", True), ("  [RESOLVED] b", True), ("a ✔", False), ("", False), (None, False), ("　✔", True)]
    rows = spark.createDataFrame(names, "name string, wanted boolean")
    assert rows.where(C.is_resolved(F.col("name")) != F.col("wanted")).count() == 0
    people = spark.createDataFrame([("Alice",), ("A_lice",), ("100%",), ("É",)], "n string")
    found = lambda part: [r[0] for r in people.where(C.contains_like(F.col("n"), part)).collect()]
    assert found("a_") == ["A_lice"] and found("ALI") == ["Alice"] and found("%") == ["100%"] and found("é") == []


def test_lock(tmp_path):
    with WriterLock(tmp_path / "w") as a:
        with pytest.raises(LockHeldError):
            WriterLock(tmp_path / "w").acquire()
        a.release()
        a.release()
        WriterLock(tmp_path / "w").acquire().release()
    assert (tmp_path / "w").exists()


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[server]\nurl = "https://a"\n[sync]\nconcurrency = 0\nstreams = ["x"]\n')
    c = config.load(f, {"THREADLOOM_EMAIL": "me@a"})
    assert (c.server.url, c.server.email, c.sync.concurrency, c.sync.streams) == ("https://a", "me@a", 4, ("x",))
    (tmp_path / "o.json").write_text('{"channels": {"chat": {"apiKey": "k", "url": "https://b"}}}')
    c = config.fill_from_json(c, tmp_path / "o.json", "chat")
    assert (c.server.url, c.server.api_key) == ("https://a", "k")
    c.server.check()
    with pytest.raises(ValueError, match="server.url"):
        config.load(tmp_path / "none", {}).server.check()


def test_retries():
    waits, answers = [], [OSError("down"), Response(429, {"Retry-After": "7"}, b""), Response(200, {"X-RateLimit-Remaining": "1"}, b'{"streams": []}')]

    def transport(method, url, headers):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert Client("https://a", "e", "k", transport, waits.append).streams() == []
    assert waits == [1, 7.0, 1.5]
    with pytest.raises(HttpError):
        Client("https://a", "e", "k", lambda *_: Response(500, {}, b"no"), waits.append).users()
    with pytest.raises(ValueError, match="upload"):
        Client("https://a", "e", "k").download("/etc/passwd")
    pages = [b'{"messages": [{"id": 5}, {"id": 9}], "found_newest": false}', b'{"messages": [{"id": 10}], "found_newest": true}']
    asked = []

    def paged(method, url, headers):
        asked.append(url)
        return Response(200, {}, pages[len(asked) - 1])

    assert [m["id"] for m in Client("https://a", "e", "k", paged).messages([], 5)] == [5, 9, 10]
    assert "anchor=5&" in asked[0] and "anchor=10&" in asked[1]


def test_rest_source(spark):
    """Two streams and direct messages read from a server by Spark."""
    from urllib.parse import parse_qs, urlsplit

    held = {"general": [1, 2, 3, 4, 5], "dev": [7], "": [9]}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = parse_qs(urlsplit(self.path).query)
            (narrow,) = json.loads(asked["narrow"][0])
            ids = held[narrow["operand"] if narrow["operator"] == "stream" else ""]
            anchor = 0 if asked["anchor"][0] == "oldest" else int(asked["anchor"][0])
            page = [i for i in ids if i >= anchor][:2]
            found = [{"id": i, "sender_id": 1, "content": f"<p>{i}</p>", "timestamp": i, "topic": "t", "reactions": [{"e": 1}]} for i in page]
            body = json.dumps({"messages": found, "found_newest": not page or page[-1] == ids[-1]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(rest.MessageSource)
    streams = json.dumps([[10, "general", 2], [11, "dev", 0], [0, "", 0]])
    url = f"http://127.0.0.1:{server.server_port}"
    rows = spark.read.format("chat_rest").options(url=url, email="e", api_key="k", streams=streams).load().collect()
    server.shutdown()
    assert sorted((r["stream_id"], r["id"]) for r in rows) == [(0, 9), (10, 2), (10, 3), (10, 4), (10, 5), (11, 7)]
    assert rows[0]["reactions"] == '[{"e": 1}]'


def test_a_failing_stream_gives_what_it_had_and_a_mark():
    pages = {"a": [b'{"messages": [{"id": 5, "type": "stream", "content": "x"}], "found_newest": false}', None], "b": [b'{"messages": [{"id": 7, "content": "y"}], "found_newest": true}']}

    def transport(method, url, headers):
        name = "a" if "%22a%22" in url else "b"
        body = pages[name].pop(0)
        return Response(500, {}, b"broken") if body is None else Response(200, {}, body)

    reader = rest._Reader({"url": "https://x", "email": "e", "api_key": "k", "streams": '[[1, "a", 0], [2, "b", 0]]'})
    reader.more = {"transport": transport}
    names = [f.name for f in landing.MESSAGE.fields]
    rows = [dict(zip(names, r, strict=True)) for p in reader.partitions() for r in reader.read(p)]
    assert [(r["stream_id"], r["id"], r["type"]) for r in rows] == [(1, 5, "stream"), (1, None, rest.FAILED), (2, 7, None)]
    assert rows[1]["content"].startswith("a: status 500")


def test_downloads_come_in_chunks():
    client = Client("https://a", "e", "k", stream=lambda m, u, h: Response(200, {}, iter([b"ab", b"c"])))
    body, kind = client.download("/user_uploads/1/x")
    assert (list(body), kind) == ([b"ab", b"c"], "")


class Server:
    """A chat server on this machine that counts how many requests it has at a time; `answer` gives (headers, body)."""

    def __init__(self, answer):
        self.now = self.most = self.asked = 0
        self.lock = threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                with outer.lock:
                    outer.now, outer.asked = outer.now + 1, outer.asked + 1
                    outer.most = max(outer.most, outer.now)
                headers, body = answer(self.path)
                with outer.lock:  # before the answer, as the next request follows it at once
                    outer.now -= 1
                self.send_response(200)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.server.shutdown()


def test_answers_that_break_off():
    """Fewer bytes than told are an error, of downloads and of the interface, and only for the stream in question."""
    whole = b'{"messages": [{"id": 7, "content": "y"}], "found_newest": true}'
    cut = lambda path: ({"Content-Length": "1000", "Content-Type": "image/png"}, b"x" * 100) if "user_uploads" in path or "%22a%22" in path else ({"Content-Length": str(len(whole))}, whole)
    with Server(cut) as server:
        waits = []
        client = Client(server.url, "e", "k", sleep=waits.append)
        body, kind = client.download("/user_uploads/1/x.png")
        assert kind == "image/png"
        with pytest.raises(rest.CutShortError):
            list(body)
        with pytest.raises(rest.CutShortError):
            client.get("/api/v1/messages", {"narrow": rest.stream_narrow("a")})
        assert waits == [1, 2, 3, 4, 5]  # asked again as after any transport error
        reader = rest._Reader({"url": server.url, "email": "e", "api_key": "k", "streams": '[[1, "a", 0], [2, "b", 0]]'})
        reader.more = {"sleep": waits.append}
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert sorted((r[1], r[7] == rest.FAILED) for r in rows) == [(1, True), (2, False)]


def test_tasks_share_the_server(spark):
    """Never more requests at a time than the settings allow, however many streams or uploads there are."""
    page = b'{"messages": [{"id": 7, "content": "y"}], "found_newest": true}'

    def answer(path):
        time.sleep(0.05)
        return {"Content-Length": str(len(page))}, page

    spark.dataSource.register(rest.MessageSource)
    with Server(answer) as server:
        streams = json.dumps([[i, f"s{i}", 0] for i in range(12)])
        rows = spark.read.format("chat_rest").options(url=server.url, email="e", api_key="k", streams=streams, concurrency=2).load()
        assert rows.count() == 12 and server.asked == 12 and server.most <= 2
    assert [len(p) for p in rest.packed(list(range(5)), 2)] == [3, 2] and rest.packed([], 2) == []


def test_quota():
    """Each of 4 tasks has a quarter of 60 requests a minute."""
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    client = Client("https://a", "e", "k", lambda *_: Response(200, {}, b'{"members": []}'), sleep, gap=rest.gap(60, 4), clock=lambda: now[0])
    for _ in range(3):
        client.users()
    assert waits == [4.0, 4.0] and rest.gap(0, 4) == 0


def test_model_server():
    asked = []

    def call(url, body=None):
        asked.append((url, body))
        return {"models": [{"name": "Nomic:latest"}]} if body is None else {"embeddings": [[3.0, 4.0]] * len(body["input"])}

    v = model_server("http://m/", "nomic", 2, call)
    assert [x.tolist() for x in v.embed(["a", "b", "c"])] == [np.float32([0.6, 0.8]).tolist()] * 3
    assert [u for u, _ in asked[:3]] == ["http://m/api/tags", "http://m/api/embed", "http://m/api/embed"]
    with pytest.raises(ModelServerError, match="no model 'other'"):
        model_server("http://m", "other", 2, call)
    with pytest.raises(ModelServerError, match="no model server"):
        model_server("http://127.0.0.1:9", "other")


def test_unit_length(spark):
    rows = [([0.6, 0.8],), ([1.0, 1.0],), ([],), (None,)]
    got = spark.createDataFrame(rows, "v array<float>").select(is_unit_length(F.col("v")).alias("u")).collect()
    assert [r["u"] for r in got] == [True, False, False, None]


def test_settings_are_saved_and_folders_expanded(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    c = config.load(tmp_path / "none.toml", {})
    assert c.archive == f"{tmp_path}/.threadloom/archive" and c.media_dir.startswith(str(tmp_path))
    own = replace(c, server=config.Server("https://x", "e@x", 'k"\\'), sync=config.Sync(2, ("a", "b"), ()))
    config.save(own, tmp_path / "d/c.toml")
    assert config.load(tmp_path / "d/c.toml", {}) == own and (tmp_path / "d/c.toml").stat().st_mode & 0o77 == 0


def test_plain_markup_is_read_as_by_the_parser():
    """The short way for plain markup gives the parser's tree, and leaves what isn't plain to it."""
    import random

    from threadloom.functions import html as H

    def dump(e):
        return e.name, e.attributes, [dump(c) if isinstance(c, H.Element) else c for c in e.children]

    bits = [
        "<p>", "</p>", '<div class="x">', "</div>", '<a href="/u/1">', "</a>", "<br>", "<br/>", "<!-- c -->", "<!--->", "&amp;", "&lt", "&", "a b", "<", ">", '"',
        "<li>", "</ul>", "<td>", "<table>", "<script>", "<title>", "<P>", "<a b>", '<a b="" b="c">', "<a b='x'>", '<a b="&amp;">', "</br>", "<?pi>", "\n", "é", "<p >", '<a b="c"d="e">',
    ]
    rnd, plain = random.Random(2), 0
    for _ in range(5000):
        x = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))
        slow = H._Tree()
        slow.feed(x)
        slow.close()
        if (fast := H._plain_tree(x)) is not None:
            plain += 1
            assert dump(fast) == dump(slow.root), x
    assert plain > 500 and H._plain_tree("<script>a</script>") is None is H._plain_tree("<p class=x>")


def test_messages_are_parsed_once(spark):
    """A filter on mentions doesn't parse again, and an empty older table joins nothing."""
    from threadloom.archive import Archive
    from threadloom.operators import upsert as U

    m = spark.range(3).selectExpr("id", "'<p>x</p>' AS content")
    plan = U.rebuild_derived(Archive(spark, {"messages": m}))["message_mentions"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_equal_messages_of_a_batch_are_parsed_once(monkeypatch):
    from threadloom.functions import html

    seen, real = [], html.extract
    monkeypatch.setattr(html, "extract", lambda x: seen.append(x) or real(x))
    texts = ["<p>a</p>", None, '<p><span class="user-mention" data-user-id="3">@B</span></p>', "<p>a</p>"] * 50
    out = html.parse_html.func(pa.array(texts)).to_pylist()
    assert sorted(seen) == sorted({x or "" for x in texts})
    assert [(r["text"], [m["user_id"] for m in r["mentions"]]) for r in out] == [("a", []), ("", []), ("@B", [3]), ("a", [])] * 50


def test_latest_of_repeated_is_latest(spark):
    rows = [(1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (None, 3, "d"), (None, 2, "e"), (3, 9, "f"), (3, 9, "f")]
    df = spark.createDataFrame(rows, "id long, at long, x string")
    got = sorted(map(tuple, U.latest_of_repeated(df, ["id"], F.col("at")).collect()), key=str)
    assert got == sorted(map(tuple, U.latest(df, ["id"], F.col("at")).collect()), key=str) and len(got) == 4
    once = df.where("id = 2")
    assert U.latest_of_repeated(once, ["id"], F.col("at")).collect() == once.collect()
