"""The audit of filters against applying every order to the documents."""

import re
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (3, None, "a"), (4, "", None), (5, "", "a"), (None, LONG, "a"), (None, "x", "b"), (None, "x", "b"),
    (6, LONG + " A" * 30, "a"), (7, LONG.upper(), "b"), (8, "same " * 70, "b"), (9, LONG + " 5 % $", "a"), (10, "few words | here", None),
    (11, " ".join(["w"] * 21 + [f"v{i}" for i in range(38)]), "b"), (12, LONG + " É" + " naïve" * 3, "c"), (13, "\x0b\x1c \t", "c"), (14, "y\u0085z " * 500, "c"),
    (0, LONG, "d"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (6, 1, None), (7, None, 1), (7, 1, 0), (99, 1, 1), (None, 1, 1), (8, 0, 0)]


def fails(row) -> set[str]:
    d, text, _ = row
    t = text or ""
    w = WORD.findall(t)
    again = d is not None and any(x is not None and x < d and (o or "") == t for x, o, _ in DOCS)
    tests = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": again}
    return {k for k, v in tests.items() if v}


def brute() -> dict:
    label = lambda d, at: any(x[0] == d and x[0] is not None and x[at] == 1 for x in LABELS)
    out, shapley = {}, {}
    for part in {p or "" for _, _, p in DOCS}:
        rows = [(r, fails(r)) for r in DOCS if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r, x in left if f in x]
                left = [(r, x) for r, x in left if f not in x]
                every = sum(f in x for _, x in rows)
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, order, step] = [
                    f, len(left), len(gone), every - len(gone), sum(x == {f} for _, x in rows), sum(label(r[0], 1) for r in gone), sum(label(r[0], 2) for r in gone),
                ]
    return {k: (*v, shapley[k[0], v[0]]) for k, v in out.items()}


def frames(spark):
    made = [(d, t, s, 1, "h", 2) for d, t, s in DOCS]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, n int, h string, mask int")
    return docs, spark.createDataFrame([(*x, 7) for x in LABELS], "doc_id long, quality int, toxic int, n int")


def test_every_order(spark):
    docs, labels = frames(spark)
    out = filter_audit.audit_filters(docs.repartition(3), labels)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()}
    wanted = brute()
    assert len(wanted) == 600 * 5 and got == wanted
    assert {k[0] for k in got} == {"", "a", "b", "c", "d"}


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    rows = filter_audit.audit_filters(docs, labels.limit(0)).collect()
    assert len(rows) == 3000 and not any(r["good_lost"] or r["toxic_lost"] for r in rows)


def test_neighbours_are_swapped():
    for n in range(1, 6):
        orders = [(tuple(o), at) for o, at in filter_audit.plain_changes(n)]
        assert {o for o, _ in orders} == set(permutations(range(n))) and len(orders) == len(set(orders))
        for (a, _), (b, at) in zip(orders, orders[1:], strict=False):
            assert [i for i in range(n) if a[i] != b[i]] == [at, at + 1]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=8, max_size=8))
def test_shapley_shares_all_that_is_removed(counts):
    """The sums over all orders divided by their number share out the documents that any filter removes."""
    cells = np.zeros((1, 8, 3), np.int64)
    cells[0, :, 0] = counts
    names, steps, shapley = filter_audit.audit_orders(cells, "XYZ")
    assert len(names) == 6 and shapley.sum() == 6 * sum(counts[1:])
    # a document goes to each of the filters that it fails equally often
    assert shapley[0].tolist() == [sum(6 // bin(m).count("1") * c for m, c in enumerate(counts) if m >> f & 1) for f in range(3)]


def test_hot_rows_are_counted_before_the_shuffle(spark):
    """A third of the rows alike and without an id: a row for each task."""
    docs = spark.range(0, 30000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text", "'s' AS source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = filter_audit.failure_cells(docs, labels).collect()
    assert [(r["part"], r["mask"], r["n"]) for r in cells] == [("s", 1, 30000)]
