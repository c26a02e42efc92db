"""Rendered messages: plain text, mentions and uploads. Nothing is fetched."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

#: fixed values: white space, elements without content, and elements whose start ends a paragraph
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
TEXT_TYPES = frozenset(
    ".txt .log .md .markdown .json .yaml .yml .csv .tsv .xml .html .htm .go .py .js .ts .css .sh .sql".split()
)
MOST_BYTES = 64 * 1024
UPLOADS = "/user_uploads/"
_BAD_URL = re.compile(r"%(?![0-9A-Fa-f]{2})|[\x00-\x1f\x7f]")
_PLAIN_PATH = re.compile(r"(?:/[-.\w]+)+", re.ASCII)
#: fixed values: elements and classes of mentions and of uploads' previews, and what holds the text beside an upload
MARKED = frozenset(("a", "span"))
MENTIONS = frozenset(("user-mention", "user-group-mention"))
ID_ATTRIBUTES = ("data-user-id", "data-user-group-id", "data-id")
PREVIEWS = ("message_inline_ref", "message_inline_image")
HOLDERS = frozenset(("p", "blockquote"))


def collapsed(text: str) -> str:
    if text.isascii() and text.isprintable():
        return " ".join(text.split())
    return " ".join(x for x in _SPACE.split(text) if x)


class Element:
    __slots__ = ("attributes", "children", "name", "parent")

    def __init__(self, name: str, attributes: dict[str, str], parent: Element | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Element | str | None] = []  # None parts texts, as a comment does

    def get(self, name: str) -> str:
        return self.attributes.get(name, "")

    def text(self) -> str:
        """All text below, each run apart, white space collapsed."""
        out, todo = [], [self]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            elif c is not None:
                todo += reversed(c.children)
        return collapsed(" ".join(out))


class _Builder:
    def __init__(self):
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end_open({"p"}, barrier={"button", "td", "th", "table"})
        if tag in SIBLINGS:
            self._end_open(SIBLINGS[tag], barrier={"ul", "ol", "dl", "select", "table"})
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        e = Element(tag, first, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def _end_open(self, names: set[str], barrier: set[str]) -> None:
        e = self.at
        while e.parent is not None and e.name not in barrier:
            if e.name in names:
                self.at = e.parent
                return
            e = e.parent

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None:
            if e.name == tag:
                self.at = e.parent
                return
            e = e.parent

    def handle_data(self, data):
        own = self.at.children
        if own and isinstance(own[-1], str):
            own[-1] += data
        else:
            own.append(data)

    def handle_comment(self, data):
        self.at.children.append(None)

    handle_decl = handle_pi = unknown_decl = handle_comment


class _Tree(_Builder, HTMLParser):
    def __init__(self):
        HTMLParser.__init__(self, convert_charrefs=True)
        _Builder.__init__(self)


# markup that needs no parser to be read as it would: lower-case tags, quoted attributes without references, plain comments
_PLAIN = re.compile(r'<(?:([a-z][a-z0-9]*)((?: [a-z][-a-z0-9]*="[^"&<>]*")*)>|/([a-z][a-z0-9]*)>|(!--[^-<>]*-->))|([^<]+)')
_ATTRIBUTE = re.compile(r' ([a-z][-a-z0-9]*)="([^"]*)"')
#: fixed value: elements whose text isn't markup
RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp svg math".split())


def _plain_tree(html: str) -> Element | None:
    """The tree of plain markup, some times faster than by the parser; None if it isn't plain."""
    t, at = _Builder(), 0
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        start, attributes, end, comment, text = m.groups()
        if text:
            t.handle_data(unescape(text) if "&" in text else text)
        elif start:
            if start in RAW:
                return None
            t.handle_starttag(start, _ATTRIBUTE.findall(attributes) if attributes else ())
        elif end:
            t.handle_endtag(end)
        else:
            t.handle_comment(comment)
    return t.root if at == len(html) else None


def tree(html: str) -> Element:
    if (plain := _plain_tree(html)) is not None:
        return plain
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


@dataclass(frozen=True)
class Mention:
    user_id: int
    name: str
    kind: str


@dataclass(frozen=True)
class Upload:
    url: str
    file_name: str
    title: str
    content_type: str
    text: str
    indexed: bool


@functools.lru_cache(maxsize=256)  # an upload's is asked for several times in a row
def _last_part(url: str) -> str:
    if _BAD_URL.search(url):
        return ""
    path = url if _PLAIN_PATH.fullmatch(url) else unquote(urlsplit(url).path)
    return path.rstrip("/").rsplit("/", 1)[-1]


def file_name(url: str, title: str) -> str:
    """The last part of the URL's path, else the title."""
    return _last_part(url) or collapsed(title)


def content_type(name: str) -> str:
    dot = name.rfind(".")
    return "text/plain" if dot >= 0 and "/" not in name[dot:] and name[dot:].lower() in TEXT_TYPES else ""


def bounded(text: str, most: int = MOST_BYTES) -> str:
    raw = text.strip().encode()
    return text.strip() if len(raw) <= most else raw[:most].decode("utf-8", "ignore").strip()


class _Finder:
    """Mentions and uploads of a tree, met in one walk that knows what encloses each element."""

    def __init__(self):
        self.mentions: dict[Mention, None] = {}
        self.uploads: dict[str, Upload] = {}

    def walk(self, root: Element) -> None:
        # beside an element the enclosing ones whose text describes an upload, the innermost first
        todo: list[tuple[Element, tuple[Element, ...]]] = [(root, ())]
        while todo:
            e, around = todo.pop()
            marks = e.attributes.get("class", "").lower() if e.attributes else ""
            if e.attributes and e.name in MARKED:
                self.meet(e, marks, around)
            inner = (e, *around) if e.name in HOLDERS or (marks and any(x in marks for x in PREVIEWS)) else around
            for c in reversed(e.children):
                if isinstance(c, Element):
                    todo.append((c, inner))

    def meet(self, e: Element, marks: str, around: tuple[Element, ...]) -> None:
        tokens = set(marks.split(" "))
        if tokens & MENTIONS:
            self.add_mention(e, someone="user-mention" in tokens, kind="group" if "user-group-mention" in marks else "user")
        url = e.get("href")
        if e.name == "a" and url.strip().lower().startswith(UPLOADS):
            self.add_upload(e.text(), url, PREVIEWS[0] in marks, around)

    def add_mention(self, e: Element, someone: bool, kind: str) -> None:
        numbers = (collapsed(e.get(k)) for k in ID_ATTRIBUTES)
        who = next((int(n) for n in numbers if re.fullmatch(r"[+-]?[0-9]+", n)), 0)
        name = e.text().removeprefix("@")
        everyone = someone and who <= 0
        if (name or who) and not everyone:
            self.mentions[Mention(who, name, kind)] = None

    def add_upload(self, title: str, url: str, shown: bool, around: tuple[Element, ...]) -> None:
        if not shown and not content_type(file_name(url.strip(), title)):
            return
        texts = (p.text() for p in around)
        near = bounded(next((t for t in texts if content_type(file_name(url, t))), ""))
        name = file_name(url, title)
        self.uploads[url] = Upload(url, name, title, content_type(name), near, bool(near))


def extract(html: str) -> tuple[str, list[Mention], list[Upload]]:
    """Plain text, mentions (each once) and uploads (the last of each URL)."""
    root, found = tree(html or ""), _Finder()
    found.walk(root)
    return root.text(), list(found.mentions), list(found.uploads.values())


def _struct(**kinds) -> StructType:
    return StructType([StructField(n, t) for n, t in kinds.items()])


S = StringType()
PARSED = _struct(
    text=S,
    mentions=ArrayType(_struct(user_id=LongType(), name=S, kind=S)),
    uploads=ArrayType(_struct(url=S, file_name=S, title=S, content_type=S, text=S, indexed=BooleanType())),
)


def _arrow(rows: list[tuple[str, list[Mention], list[Upload]]]) -> pa.StructArray:
    kinds = to_arrow_type(PARSED)
    columns = [t for t, _, _ in rows], [[vars(m) for m in ms] for _, ms, _ in rows], [[vars(u) for u in us] for _, _, us in rows]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], fields=list(kinds))


@F.arrow_udf(PARSED)
def parse_html(html: pa.Array) -> pa.Array:
    """struct<text, mentions, uploads> of rendered messages; null counts as empty. Equal ones of a batch are parsed once."""
    each = html.fill_null("").dictionary_encode()
    return _arrow([extract(x) for x in each.dictionary.to_pylist()]).take(each.indices)


#: else a filter that Spark makes of what is done with a part of it would parse all once more
parse_html = parse_html.asNondeterministic()


@F.pandas_udf(S)
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: tree(x or "").text())
