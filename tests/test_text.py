"""Words, stems, the query language and excerpts, against the full-text engine of sqlite3."""

import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.functions.text import STEP_2, STEP_3, STEP_4, stem, terms, words
from threadloom.operators.fulltext import snippet
from threadloom.plans.fulltext import QuerySyntaxError, match, parse, phrase_counts

VOCABULARY = ["one", "two", "three", "deploy", "deployed", "data", "database", "x", "running", "run"]


def engine(rows, columns, tokenizer="porter unicode61"):
    c = sqlite3.connect(":memory:")
    c.execute(f"create virtual table t using fts5({', '.join(columns)}, tokenize='{tokenizer}')")
    marks = ", ".join("?" * (len(columns) + 1))
    c.executemany(f"insert into t(rowid, {', '.join(columns)}) values({marks})", [(i, *r) for i, r in enumerate(rows)])
    return c


def indexed(rows, tokenizer):
    c = engine([(r,) for r in rows], ("x",), tokenizer)
    c.execute("create virtual table v using fts5vocab(t, 'instance')")
    out = [[] for _ in rows]
    for term, doc in c.execute("select term, doc from v order by doc, offset"):
        out[doc].append(term)
    return out


def test_stems_agree():
    rnd = random.Random(5)
    ends = [*STEP_2, *STEP_3, *STEP_4, "s", "es", "ies", "sses", "ed", "eed", "ing", "y", "e", "ll", "ated", "bled", "pping"]
    made = {"".join(rnd.choice("abcdefghilmnoprstuvyz") for _ in range(rnd.randint(0, 6))) + "".join(rnd.choices(ends, k=rnd.randint(1, 3))) for _ in range(8000)}
    made |= {"sky", "ties", "happy", "generalizations", "oscillators", "deployment", "deploys", "a" * 70 + "ing", "is", "by"}
    every = sorted(made)
    assert [x for x, y in zip(every, indexed(every, "porter unicode61"), strict=True) if [stem(x)] != y] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB éÉñßø-'_.1½中́ΩάệABC😀✔ﬁＡ", max_size=14), min_size=1, max_size=20))
def test_words_agree(texts):
    assert [[w for w, _, _ in words(t)] for t in texts] == indexed(texts, "unicode61")


def _query(rnd, depth=0):
    x = rnd.random()
    again = lambda: _query(rnd, depth + 1)
    if x < 0.4 or depth > 3:
        return rnd.choice([*VOCABULARY, '"one two"', "dat*", '"two da" *', '""', "one_two", "NOT", "and", "v2.5", "data-base", "?", '"', "("])
    if x < 0.55:
        return f"{again()} {again()}"
    if x < 0.8:
        return f"{again()} {rnd.choice(['AND', 'OR', 'NOT'])} {again()}"
    if x < 0.86:
        return f"({again()})"
    if x < 0.93:
        return f"{rnd.choice(['a', 'b', 'z', '{a b}', '-a', '- b'])}: {again()}"
    return rnd.choice([f"^{again()}", "one + two", "NEAR(one two)", "NEAR(run* data, 2)", 'NEAR("one two" x three, 0)'])


def test_queries_match_the_same_rows():
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.randint(0, n)))
    rows = [(text(9), text(5)) for _ in range(40)]
    c = engine(rows, ("a", "b"))
    positions = []
    for r in rows:
        found = {}
        for column, t in zip("ab", r, strict=True):
            for i, w in enumerate(terms(t)):
                found.setdefault(w, {}).setdefault(column, []).append(i)
        positions.append(found)
    for _ in range(1500):
        q = _query(rnd)
        try:
            wanted = {i for (i,) in c.execute("select rowid from t where t match ?", (q,))}
        except sqlite3.Error:
            with pytest.raises(QuerySyntaxError):
                parse(q, ("a", "b"))
            continue
        node = parse(q, ("a", "b"))
        assert {i for i, p in enumerate(positions) if match(node, p)[0]} == wanted, q
        assert all(len(phrase_counts(node, p)) == len(node.all_phrases()) for p in positions[:1])


@pytest.mark.parametrize("q", ["", " ", "?", "v2.5", '"', "(", "AND x", "database-bug", "z: x"])
def test_errors(q):
    with pytest.raises(QuerySyntaxError):
        parse(q, ("a", "b"))


def test_snippets_agree():
    rnd = random.Random(2)
    rows = []
    for _ in range(300):
        parts = [rnd.choice([*VOCABULARY, f"w{rnd.randint(0, 30)}"]) + rnd.choice([" ", " ", ". ", ": ", ".", ", ", ".\n", "? "]) for _ in range(rnd.randint(1, 70))]
        rows.append((rnd.choice(["", "("]) + "".join(parts), rnd.choice(VOCABULARY)))
    c = engine(rows, ("a", "b"))
    for q in ("one", "one two", '"one two"', "run* OR data", "one OR two OR three", "a: one", "NEAR(one two)"):
        node = parse(q, ("a", "b"))
        for i, wanted in c.execute("select rowid, snippet(t, 0, '', '', ' … ', 20) from t where t match ?", (q,)):
            assert snippet(rows[i][0], "a", node) == wanted
