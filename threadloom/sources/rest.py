"""A chat server's REST interface: retries, paging, and a Spark data source over it."""

from __future__ import annotations

import base64
import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .landing import MESSAGE

ATTEMPTS = 5
PAGE_SIZE = 1000
UPLOADS = "/user_uploads/"
CHUNK = 1 << 20
FAILED = "failed"  # the type of a row that stands for a stream whose reading failed


@dataclass(frozen=True)
class Response:
    status: int
    headers: dict[str, str]
    body: bytes | Iterator[bytes]


Transport = Callable[[str, str, dict[str, str]], Response]


class HttpError(RuntimeError):
    def __init__(self, status: int, body: str):
        super().__init__(f"status {status}: {body[:200]}")
        self.status = status


class CutShortError(OSError):
    """An answer ended before its whole body came."""


def _open(method: str, url: str, headers: dict[str, str]):
    """The open answer, or a Response if the server refused."""
    request = urllib.request.Request(url, method=method, headers=headers)
    try:
        return urllib.request.urlopen(request, timeout=60)
    except urllib.error.HTTPError as e:
        try:
            return Response(e.code, dict(e.headers), e.read())
        except http.client.HTTPException as cut:
            raise CutShortError(str(cut)) from cut
    except http.client.HTTPException as e:
        raise CutShortError(str(e)) from e


def _chunks(r) -> Iterator[bytes]:
    """The body; raises CutShortError if fewer bytes come than the answer's Content-Length says."""
    told, came = r.headers.get("Content-Length"), 0
    with r:
        try:
            while data := r.read(CHUNK):
                came += len(data)
                yield data
        except http.client.HTTPException as e:
            raise CutShortError(str(e)) from e
    if told is not None and told.isdigit() and came < int(told):
        raise CutShortError(f"{came} of {told} bytes came")


def http_get(method: str, url: str, headers: dict[str, str]) -> Response:
    """The transport for real servers."""
    r = _open(method, url, headers)
    return r if isinstance(r, Response) else Response(r.status, dict(r.headers), b"".join(_chunks(r)))


def http_stream(method: str, url: str, headers: dict[str, str]) -> Response:
    """The transport for bodies of any length: a good answer's body comes in chunks."""
    r = _open(method, url, headers)
    return r if isinstance(r, Response) else Response(r.status, dict(r.headers), _chunks(r))


@dataclass
class Client:
    """Transport errors wait 1 to 5 s and 429 as long as it says (2 s unless it does); little quota left, 1.5 s.

    gap: the least seconds between two requests, this client's share of the server's quota.
    """

    url: str
    email: str
    api_key: str
    transport: Transport = http_get
    sleep: Callable[[float], None] = field(default=time.sleep)
    stream: Transport = http_stream
    gap: float = 0.0
    clock: Callable[[], float] = field(default=time.monotonic)
    _next: float = field(default=0.0, init=False)

    def _wait_for_turn(self) -> None:
        if self.gap > 0:
            now = self.clock()
            if now < self._next:
                self.sleep(self._next - now)
            self._next = max(now, self._next) + self.gap

    def get(self, path: str, params: dict | None = None) -> bytes:
        return self.ask(path, params, self.transport).body

    def ask(self, path: str, params: dict | None, transport: Transport) -> Response:
        key = base64.b64encode(f"{self.email}:{self.api_key}".encode()).decode()
        query = urllib.parse.urlencode({k: v if isinstance(v, str) else json.dumps(v) for k, v in (params or {}).items()})
        url = self.url.rstrip("/") + path + (f"?{query}" if query else "")
        last: Exception = RuntimeError("not tried")
        for attempt in range(1, ATTEMPTS + 1):
            self._wait_for_turn()
            try:
                r = transport("GET", url, {"Authorization": f"Basic {key}"})
            except OSError as e:
                last = e
                self.sleep(attempt)
                continue
            headers = {k.lower(): v for k, v in r.headers.items()}
            if r.status == 429:
                last = HttpError(429, r.body.decode("utf-8", "replace"))
                self.sleep(_number(headers.get("retry-after"), 2.0))
                continue
            if not 200 <= r.status < 300:
                raise HttpError(r.status, r.body.decode("utf-8", "replace"))
            if "x-ratelimit-remaining" in headers and _number(headers["x-ratelimit-remaining"], 5) < 5:
                self.sleep(1.5)
            return r
        raise last

    def settings(self) -> dict:
        return json.loads(self.get("/api/v1/server_settings"))

    def streams(self) -> list[dict]:
        flags = {k: "true" for k in ("include_public", "include_subscribed", "include_web_public", "include_default")}
        return json.loads(self.get("/api/v1/streams", flags))["streams"]

    def users(self) -> list[dict]:
        return json.loads(self.get("/api/v1/users"))["members"]

    def page(self, anchor: str, narrow: list[dict], size: int = PAGE_SIZE) -> dict:
        asked = {"anchor": anchor, "num_before": 0, "num_after": size, "narrow": narrow, "apply_markdown": "true"}
        return json.loads(self.get("/api/v1/messages", asked))

    def newest(self, narrow: list[dict]) -> int:
        """The greatest message id, 0 if there is none."""
        asked = {"anchor": "newest", "num_before": 1, "num_after": 0, "narrow": narrow, "apply_markdown": "true"}
        return max((m["id"] for m in json.loads(self.get("/api/v1/messages", asked))["messages"]), default=0)

    def messages(self, narrow: list[dict], after: int = 0, size: int = PAGE_SIZE, through: int | None = None) -> Iterator[dict]:
        """All messages from an id on (0: the oldest), which may come again itself, up to one; pages follow the last id."""
        anchor = str(after) if after > 0 else "oldest"
        while True:
            page = self.page(anchor, narrow, size)
            for m in page["messages"]:
                if through is not None and m["id"] > through:
                    return
                yield m
            if not page["messages"] or page.get("found_newest"):
                return
            anchor = str(page["messages"][-1]["id"] + 1)

    def download(self, path: str) -> tuple[Iterator[bytes], str]:
        """An upload in chunks, so that none is ever held whole, and the content type that the server tells."""
        if not path.startswith(UPLOADS):
            raise ValueError(f"not an upload: {path!r}")
        r = self.ask(path, None, self.stream)
        return r.body, {k.lower(): v for k, v in r.headers.items()}.get("content-type", "")


def _number(text: str | None, default: float) -> float:
    try:
        return float(text) if text is not None else default
    except ValueError:
        return default


def stream_narrow(name: str) -> list[dict]:
    return [{"operator": "stream", "operand": name}]


def direct_narrow() -> list[dict]:
    return [{"operator": "is", "operand": "private"}]


class _Part(InputPartition):
    """Streams that one task reads after each other: (id, name, last message id)."""

    def __init__(self, streams: list[list]):
        self.streams = streams


def packed(streams: list[list], tasks: int) -> list[list[list]]:
    """Streams dealt to at most so many tasks."""
    n = max(1, min(tasks, len(streams)))
    return [streams[k::n] for k in range(n)] if streams else []


class MessageSource(DataSource):
    """format("chat_rest"): messages of streams, read on the executors by at most `concurrency` tasks.

    A stream that fails gives the messages it had and then a row of type FAILED with the error as its
    content; the others go on.

    As a streaming source its offset is the last message id of each stream, from the given ones on. A batch has
    what came up to the newest ids that the server tells; a stream that can't be asked stays where it was.
    A failure while a batch is read fails the batch, which then comes again whole.

    Options: url, email, api_key, streams (JSON list of [stream_id, name, last id]; name "" for direct
    messages), concurrency (4), requests_a_minute (0: any number), which the tasks share out.
    """

    @classmethod
    def name(cls) -> str:
        return "chat_rest"

    def schema(self):
        return MESSAGE

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.server = (options["url"], options["email"], options["api_key"])
        self.parts = packed(json.loads(options["streams"]), int(options.get("concurrency", 4)))
        self.more: dict = {"gap": gap(float(options.get("requests_a_minute", 0)), len(self.parts))}  # and a transport of one's own

    def partitions(self):
        return [_Part(p) for p in self.parts]

    def read(self, part):
        client = Client(*self.server, **self.more)
        for stream_id, name, after in part.streams:
            yield from stream_rows(client, stream_id, name, after)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.server = (options["url"], options["email"], options["api_key"])
        self.streams = json.loads(options["streams"])
        self.tasks = int(options.get("concurrency", 4))
        self.rate = float(options.get("requests_a_minute", 0))
        self.known = self.initialOffset()
        self.more: dict = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {str(i): after for i, _, after in self.streams}

    def latestOffset(self) -> dict:  # noqa: N802
        client = Client(*self.server, **{"gap": gap(self.rate, 1)} | self.more)
        for i, name, _ in self.streams:
            try:
                self.known[str(i)] = max(self.known[str(i)], client.newest(_narrow(name)))
            except (OSError, RuntimeError, ValueError, KeyError):
                continue  # asked again before the next batch
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        now = [[i, name, start.get(str(i), 0), end[str(i)]] for i, name, _ in self.streams if end.get(str(i), 0) > start.get(str(i), 0)]
        return [_Part(p) for p in packed(now, self.tasks)]

    def read(self, part: _Part) -> Iterator[tuple]:
        client = Client(*self.server, **{"gap": gap(self.rate, self.tasks)} | self.more)
        for stream_id, name, after, through in part.streams:
            for m in client.messages(_narrow(name), after, through=through):
                if m["id"] > after:
                    yield _row(stream_id, m)

    def commit(self, end: dict) -> None:
        """Nothing to be told to the server; the checkpoint keeps the offset."""


def _narrow(name: str) -> list[dict]:
    return stream_narrow(name) if name else direct_narrow()


def _row(stream_id: int, m: dict) -> tuple:
    own = m | {"stream_id": stream_id, "reactions": json.dumps(m.get("reactions") or [])}
    return tuple(own.get(f.name) for f in MESSAGE.fields)


def gap(requests_a_minute: float, tasks: int) -> float:
    """The seconds between the requests of each of so many tasks."""
    return 60 * max(1, tasks) / requests_a_minute if requests_a_minute > 0 else 0.0


def stream_rows(client: Client, stream_id: int, name: str, after: int) -> Iterator[tuple]:
    """The messages of a stream from an id on, and a FAILED row if they break off."""
    try:
        for m in client.messages(_narrow(name), after):
            yield _row(stream_id, m)
    except (OSError, RuntimeError, ValueError, KeyError) as e:
        failed = {"stream_id": stream_id, "type": FAILED, "content": f"{name or 'direct messages'}: {e}"}
        yield tuple(failed.get(f.name) for f in MESSAGE.fields)
