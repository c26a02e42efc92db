"""The full-text query language: parsing on the driver, matching against one document's positions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import terms as index_terms

NEAR_DISTANCE = 10


class QuerySyntaxError(ValueError):
    """The query isn't in the language, or names a column that isn't there."""


@dataclass(frozen=True)
class Phrase:
    """Terms that stand side by side; `prefix`: the last one may go on; `first`: at a column's start."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: frozenset[str] | None = None


@dataclass
class Node:
    """near: phrases within `distance`; and, or, not: parts."""

    kind: str
    phrases: list[Phrase] = field(default_factory=list)
    parts: list[Node] = field(default_factory=list)
    distance: int = NEAR_DISTANCE

    def all_phrases(self) -> list[Phrase]:
        return self.phrases + [p for x in self.parts for p in x.all_phrases()]

    def nears(self) -> list[Node]:
        """The nodes that hold phrases, in order of the query."""
        return [self] if self.kind == "near" else [n for x in self.parts for n in x.nears()]

    @property
    def empty(self) -> bool:
        return self.kind == "near" and len(self.phrases) == 1 and not self.phrases[0].terms


_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([0-9A-Za-z_\x1a\x80-\U0010ffff]+)|([(){}:,+*^-]))')


def _tokens(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while query[at:].strip(" \t\r\n"):
        m = _TOKEN.match(query, at)
        if not m:
            rest = query[at:].lstrip()
            raise QuerySyntaxError("unterminated string" if rest[0] == '"' else f'syntax error near "{rest[0]}"')
        string, word, mark = m.groups()
        if string is not None:
            out.append(("string", string[1:-1].replace('""', '"')))
        elif word is not None:
            out.append((word, word) if word in ("AND", "OR", "NOT") else ("word", word))
        else:
            out.append((mark, mark))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, query: str, columns: tuple[str, ...], stemmed: bool):
        self.tokens, self.at = _tokens(query), 0
        self.columns = {c.lower(): c for c in columns}
        self.stemmed = stemmed

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    def take(self, *kinds: str) -> str:
        kind, value = self.tokens[self.at]
        if kind not in kinds:
            raise QuerySyntaxError(f'syntax error near "{value}"')
        self.at += 1
        return value

    def whole(self) -> Node:
        node = self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.operand, None), None), None)
        self.take("end")
        return node

    def chain(self, operator: str, part, columns) -> Node:
        node = part()
        while self.kind == operator:
            self.at += 1
            node = Node(operator.lower(), parts=[node, part()])
        return node

    def group(self) -> Node:
        self.take("(")
        node = self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.operand, None), None), None)
        self.take(")")
        return node

    def operand(self) -> Node:
        if self.kind == "(":
            return self.group()
        items: list[Node] = []
        while True:
            here = self.at
            columns = self.column_filter()
            if columns is not None and self.kind == "(":
                if items:
                    raise QuerySyntaxError('syntax error near "("')
                return _limited(self.group(), columns)
            item = self.near()
            items.append(_limited(item, columns) if columns is not None else item)
            if self.kind not in ("string", "word", "^", "{", "-") or self.at == here:
                break
        full = [x for x in items if not x.empty]
        node = full[0] if full else items[0]
        for x in full[1:]:
            node = Node("and", parts=[node, x])
        return node

    def column_filter(self) -> frozenset[str] | None:
        here, negative = self.at, False
        if self.kind == "-":
            self.at += 1
            negative = True
        names: list[str] = []
        if self.kind == "{":
            self.at += 1
            while self.kind in ("string", "word"):
                names.append(self.take("string", "word"))
            self.take("}")
            if not names:
                raise QuerySyntaxError('syntax error near "}"')
        elif self.kind in ("string", "word") and self.tokens[self.at + 1][0] == ":":
            names.append(self.take("string", "word"))
        elif negative:
            if here and self.tokens[here - 1][0] in ("string", "word") and self.kind in ("string", "word"):
                raise QuerySyntaxError(f"no such column: {self.tokens[self.at][1]}")
            raise QuerySyntaxError('syntax error near "-"')
        else:
            return None
        for n in names:
            if n.lower() not in self.columns:
                raise QuerySyntaxError(f"no such column: {n}")
        self.take(":")
        own = frozenset(self.columns[n.lower()] for n in names)
        return frozenset(self.columns.values()) - own if negative else own

    def near(self) -> Node:
        if self.kind == "^":
            self.at += 1
            p = self.phrase()
            return Node("near", [Phrase(p.terms, p.prefix, True)])
        if self.kind == "word" and self.tokens[self.at + 1][0] == "(":
            name = self.take("word")
            if name != "NEAR":
                raise QuerySyntaxError(f'syntax error near "{name}"')
            self.take("(")
            phrases = [self.phrase()]
            while self.kind in ("string", "word"):
                phrases.append(self.phrase())
            distance = NEAR_DISTANCE
            if self.kind == ",":
                self.at += 1
                number = self.take("string", "word")
                if not number.isdigit():
                    raise QuerySyntaxError(f'expected integer, got "{number}"')
                distance = int(number)
            self.take(")")
            full = [p for p in phrases if p.terms]
            return Node("near", full or phrases[:1], distance=distance)
        return Node("near", [self.phrase()])

    def phrase(self) -> Phrase:
        found: list[str] = []
        while True:
            found += index_terms(self.take("string", "word"), self.stemmed)
            prefix = self.kind == "*"
            if prefix:
                self.at += 1
            if self.kind != "+":
                return Phrase(tuple(found), prefix and bool(found))
            self.at += 1


def _limited(node: Node, columns: frozenset[str]) -> Node:
    """A column filter over a whole group narrows the filters inside."""
    return Node(
        node.kind,
        [Phrase(p.terms, p.prefix, p.first, columns if p.columns is None else p.columns & columns) for p in node.phrases],
        [_limited(x, columns) for x in node.parts],
        node.distance,
    )


def parse(query: str, columns: tuple[str, ...], stemmed: bool = True) -> Node:
    """Raises QuerySyntaxError for what isn't a query: an empty string, too."""
    return _Parser(query, columns, stemmed).whole()


Positions = dict[str, dict[str, list[int]]]  # term -> column -> positions


def instances(p: Phrase, found: Positions) -> dict[str, list[int]]:
    """Column -> starts of a phrase."""
    out: dict[str, list[int]] = {}
    if not p.terms:
        return out
    last = p.terms[-1]
    ends = [found[t] for t in found if t.startswith(last)] if p.prefix else [found[last]] if last in found else []
    fixed = [found.get(t) for t in p.terms[:-1]]
    if not ends or None in fixed:
        return out
    for column in {c for e in ends for c in e}:
        if p.columns is not None and column not in p.columns:
            continue
        starts = {x - len(fixed) for e in ends for x in e.get(column, ())}
        for i, f in enumerate(fixed):
            starts &= {x - i for x in f.get(column, ())}
        if p.first:
            starts &= {0}
        if starts:
            out[column] = sorted(starts)
    return out


def _near(node: Node, every: list[dict[str, list[int]]]) -> list[dict[str, list[int]]]:
    """The instances that lie in some group of all phrases with at most `distance` words between."""
    if len(every) == 1:
        return every
    out: list[dict[str, list[int]]] = [{} for _ in every]
    sizes = [len(p.terms) for p in node.phrases]
    for column in set.intersection(*(set(x) for x in every)):
        lists = [x[column] for x in every]
        at = [0] * len(lists)
        kept: list[set[int]] = [set() for _ in lists]
        while all(at[i] < len(lists[i]) for i in range(len(lists))):
            now = [lists[i][at[i]] for i in range(len(lists))]
            high = max(now)
            moved = False
            for i in range(len(lists)):  # bring every phrase close enough to the last one
                if now[i] < high - sizes[i] - node.distance:
                    at[i] += 1
                    moved = True
                    break
            if moved:
                continue
            for i in range(len(lists)):
                kept[i].add(now[i])
            after = [x[at[i] + 1] if at[i] + 1 < len(x) else float("inf") for i, x in enumerate(lists)]
            at[after.index(min(after))] += 1
        if all(kept):
            for i, k in enumerate(kept):
                out[i][column] = sorted(k)
    return out


def match(node: Node, found: Positions) -> tuple[bool, list[dict[str, list[int]]]]:
    """Whether a document matches, and the instances of each phrase in order of the query."""
    if node.kind == "near":
        every = [instances(p, found) for p in node.phrases]
        near = _near(node, every)
        ok = all(near) and bool(near)
        return ok, near if ok else [{} for _ in near]
    (a, x), (b, y) = (match(p, found) for p in node.parts)
    ok = {"and": a and b, "or": a or b, "not": a and not b}[node.kind]
    if not ok:
        return False, [{} for _ in x + y]
    return True, x + (y if node.kind != "not" else [{} for _ in y])


def phrase_counts(node: Node, found: Positions) -> list[bool]:
    """For each phrase of the query, whether it occurs at all: what inverse document frequencies count."""
    return [bool(instances(p, found)) for p in node.all_phrases()]


def occurrences(node: Node, found: Positions) -> list[dict[str, list[int]]]:
    """The instances of each phrase, whether or not the whole query matches."""
    if node.kind == "near":
        every = [instances(p, found) for p in node.phrases]
        return _near(node, every) if all(every) else [{} for _ in every]
    return [x for p in node.parts for x in occurrences(p, found)]
