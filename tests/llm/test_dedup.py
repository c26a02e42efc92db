"""Substring, suffix-array and SimHash dedup against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import anchors, simhash, substring_dedup, suffix_dedup
from threadloom.llm.components import components
from threadloom.llm.run_index import RunIndex, suffix_array

from . import brute


def rows_of(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.fixture(scope="module")
def corpus(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    return df, {r["doc_id"]: r["text"] or "" for r in df.collect()}


def small():
    rnd = random.Random(1)
    rows = [(i * 7 % 211, " ".join(rnd.choice(["a", "b", "é"]) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    rows += [(900 + i, "a " * rnd.randint(0, 400)) for i in range(5)] + [(950, ""), (951, " \t\n")]
    return rows + [(960 + i, "\x0babc  def" * rnd.randint(1, 60)) for i in range(5)]


@pytest.mark.parametrize("texts", ["corpus", "small"])
def test_words(spark, corpus, texts):
    df, docs = corpus if texts == "corpus" else (brute.frame(spark, small()), dict(small()))
    assert rows_of(substring_dedup.digest_repeated_spans(df)) == brute.spans_removed(docs)


@pytest.mark.parametrize("texts", ["corpus", "small"])
def test_bytes(spark, corpus, texts):
    df, docs = corpus if texts == "corpus" else (brute.frame(spark, small()), dict(small()))
    assert rows_of(suffix_dedup.digest_repeated_bytes(df)) == brute.bytes_removed(docs)


def test_few_paths_or_many_give_the_same(spark, corpus, monkeypatch):
    df, docs = corpus
    monkeypatch.setattr(suffix_dedup, "FEW_PATHS", 0)
    assert rows_of(suffix_dedup.digest_repeated_bytes(df)) == brute.bytes_removed(docs)


def test_cases(spark):
    q = lambda n: "q " * n
    df = brute.frame(spark, [(None, None), (None, q(50)), (3, None), (3, q(50)), (3, q(50)), (5, q(60))])
    words = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeated_spans(df).collect())
    assert words == [(0, 0, 0), (0, 50, 50), (3, 0, 0), (3, 50, 0), (3, 50, 0), (5, 60, 60)]
    spans = {r["doc_id"]: r["spans"] for r in substring_dedup.remove_repeated_spans(df).collect()}
    assert [tuple(s) for s in spans[5]] == [(0, 60, 3)]
    left = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeated_bytes(df).collect())
    assert left == [(0, 0, 0), (0, 100, 100), (3, 0, 0), (3, 100, 0), (3, 100, 100), (5, 120, 120)]
    assert substring_dedup.digest_repeated_spans(df.limit(0)).count() == 0 == suffix_dedup.digest_repeated_bytes(df.limit(0)).count()
    whole = suffix_dedup.shorten_documents(df)
    assert whole.columns == df.columns and whole.where("text IS NULL").count() == 2 and whole.where("n_chars <> length(text)").count() == 0


def test_long_words_that_differ_in_every_letter(spark):
    """Thue-Morse words and their complements, on which polynomials modulo 2^64 agree."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    word = lambda n, one: "".join("ab"[b ^ one] for b in bits[:n])
    rows = []
    for j, n in enumerate((128, 1024, 2048, 4096)):
        lead = " ".join(f"{n}w{i}" for i in range(12))
        rows += [(10 * j + 1, f"{lead} {word(n, 0)}"), (10 * j + 2, f"{lead} {word(n, 1)}"), (10 * j + 3, f"{lead}\t{word(n, 1)} end")]
    df = brute.frame(spark, rows)
    assert rows_of(substring_dedup.digest_repeated_spans(df)) == brute.spans_removed(dict(rows))
    assert rows_of(suffix_dedup.digest_repeated_bytes(df)) == brute.bytes_removed(dict(rows))


@pytest.mark.parametrize("broken", ["words", "bytes"])
def test_no_row_is_wrong_where_hashes_collide(spark, monkeypatch, broken):
    """Every symbol has one hash: all windows are proposed as equal, and the comparison at the sources refuses."""
    rows = [(i, " ".join(f"{i}word{j}" for j in range(40))) for i in range(6)]
    monkeypatch.setattr(anchors, "mixed" if broken == "words" else "byte_values", (lambda x: x * 0) if broken == "words" else lambda seed: np.ones(256, np.uint64))
    op = substring_dedup.digest_repeated_spans if broken == "words" else suffix_dedup.digest_repeated_bytes
    text = lambda rows: pa.table({"doc_id": [r[0] for r in rows], "rank": [0] * len(rows), "text": [r[1] for r in rows], "block": [0] * len(rows)})
    t = anchors.Text(text(rows), broken == "words", 13 if broken == "words" else 100)
    proposed = anchors.Proposed(anchors.Pieces(t, 4 if broken == "words" else 20), anchors.Verdicts(anchors._table({}, anchors.VERDICTS)), False)
    assert len(proposed.first)
    with pytest.raises(RuntimeError, match="one 64-bit hash"):
        anchors.propose(t, proposed)
    assert op(brute.frame(spark, rows[:1])).count() == 1


def test_paths_are_compacted_and_answered():
    rows = [(1, "x " + " ".join(f"w{j}" for j in range(90)) + " y"), (2, " ".join(f"w{j}" for j in range(90)))]
    table = lambda block, rows: pa.table({"doc_id": [r[0] for r in rows], "rank": [0] * len(rows), "text": [r[1] for r in rows], "block": [block] * len(rows)})
    both = anchors.Text(table(0, rows), True, 13)
    found = anchors.Proposed(anchors.Pieces(both, 4), anchors.Verdicts(anchors._table({}, anchors.VERDICTS)), False)
    assert (found.first.tolist(), found.count.tolist(), found.source.tolist()) == ([92], [78], [1])  # one path of all 78 windows
    source, copy = anchors.Text(table(0, rows[:1]), True, 13), anchors.Text(table(1, rows[1:]), True, 13)
    found.first -= 92
    claims = anchors._table(anchors.propose(copy, found), anchors.CLAIMS)
    asked = claims.filter(pa.array(claims.column("block").to_numpy() == 0))
    assert asked.num_rows == 1
    told = anchors.answer(source.table, asked, lambda t: source)
    own = claims.filter(pa.array(claims.column("block").to_numpy() == 1))
    marked = anchors.Marked(copy, pa.concat_tables([own, told]))
    assert marked.mask.all() and marked.source.tolist() == [1]
    wrong = asked.set_column(asked.schema.get_field_index("digest"), "digest", pa.array([b"0" * 32], pa.binary()))
    with pytest.raises(RuntimeError, match="one 64-bit hash"):
        anchors.Marked(copy, pa.concat_tables([own, anchors.answer(source.table, wrong, lambda t: source)]))


def plain_paths(docs, k=13):
    """The compacted graph from the places of all windows."""
    words = {d: brute.WORD.findall((t or "").encode()) for d, t in docs.items()}
    first, again = {}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            e = tuple(words[d][i : i + k])
            if first.setdefault(e, (d, i))[0] < d:
                again.setdefault(e, []).append((d, i))
    source = {(d, i): first[tuple(words[d][i : i + k])] for places in again.values() for d, i in places}
    starts, ends, cover, sides = {}, {}, {}, ({}, {})
    word = lambda d, i: words[d][i] if 0 <= i < len(words[d]) else None
    for (d, i), (a, x) in source.items():
        cover[a, x] = cover.get((a, x), 0) + 1
        if source.get((d, i - 1)) != (a, x - 1):
            starts.setdefault((a, x), []).append(word(d, i - 1))
        if source.get((d, i + 1)) != (a, x + 1):
            ends.setdefault((a, x + 1), []).append(word(d, i + k))
    out = set()
    for a, x in cover:
        if (a, x - 1) in cover and (a, x) not in starts and (a, x) not in ends:
            continue
        y = x + 1
        while (a, y) in cover and (a, y) not in starts and (a, y) not in ends:
            y += 1
        into = {*starts.get((a, x), []), word(a, x - 1)} - {None}
        outof = {*ends.get((a, y), []), word(a, y - 1 + k)} - {None}
        out.add((a, x, y - x + k - 1, cover[a, x] + 1, len(into), len(outof)))
    return out


@pytest.mark.parametrize("texts", ["corpus", "small"])
def test_compacted_graph(spark, corpus, texts):
    df, docs = corpus if texts == "corpus" else (brute.frame(spark, small()), dict(small()))
    got = [tuple(r) for r in substring_dedup.repeated_paths(df).collect()]
    assert set(got) == plain_paths(docs) and len(got) == len(set(got)) and max(r[4] for r in got) > 1
    assert substring_dedup.repeated_paths(df.limit(0)).count() == 0


def test_rows_of_one_id_lie_in_many_blocks(spark):
    rnd = random.Random(8)
    text = lambda: " ".join(f"{rnd.random():.17f}" for _ in range(60))
    shared = text()
    rows = [(None, f"{text()} {shared} {text()}") for _ in range(40)] + [(7, f"{text()} {shared}") for _ in range(40)]
    gone = [r["n_removed"] for r in substring_dedup.digest_repeated_spans(brute.frame(spark, rows)).orderBy("doc_id").collect()]
    assert gone == [60] * 40 + [0] * 40  # nulls first: all have a source, rows of id 7 none
    left = suffix_dedup.remove_repeated_bytes(brute.frame(spark, rows)).collect()
    assert sum(r["n_removed"] < 500 for r in left) == 1  # the first of id 7 by rank keeps its passage
    again = suffix_dedup.remove_repeated_bytes(brute.frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, left)) == sorted(map(str, again))


def test_run_index():
    rnd = random.Random(3)
    for alphabet in (b"ab", b"\x00\xff\x01", bytes(range(256))):
        base = bytes(rnd.choice(alphabet) for _ in range(300))
        pieces = [base[a : a + rnd.randint(0, 80)] for a in rnd.choices(range(250), k=24)]
        texts, queries = pieces[:16], [p[:20] + b"\x01" + p[20:] for p in pieces[16:]]
        index = RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
        offs = np.concatenate([[0], np.cumsum([len(x) for x in queries])])
        length, _ = index.matching_statistics(np.frombuffer(b"".join(queries), np.uint8), offs, 40)
        for x, o in zip(queries, offs.tolist(), strict=False):
            for i in range(len(x)):
                best = max(n for n in range(41) if i + n <= len(x) and any(x[i : i + n] in t for t in texts))
                assert length[o + i] == best
    t = np.array([3, 1, 3, 1, 3, 0])
    assert suffix_array(t).tolist() == sorted(range(6), key=lambda i: t[i:].tolist())


def test_simhash(spark, corpus):
    df, docs = corpus
    assert rows_of(simhash.near_duplicates(df)) == brute.simhash_classes(docs)


def test_simhash_of_one_large_group(spark):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(300)] = f"x{rnd.randint(0, 99)}"
        rows.append((5000 - i, " ".join(w)))
    rows += [(9000 + i, "") for i in range(5)] + [(9100, "One"), (9101, "oNE")]
    df = brute.frame(spark, rows)
    wanted = brute.simhash_classes(dict(rows))
    assert rows_of(simhash.near_duplicates(df)) == wanted
    assert {r["doc_id"] for r in simhash.keep_one_of_each(df).collect()} == {c for _, c in wanted.values()}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    odd = simhash.near_duplicates(brute.frame(spark, [(None, "a"), (4, "a"), (4, "a"), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in odd) == [(0, 0), (0, 4), (4, 4), (4, 4)]


def test_one_row_of_each_component_stays(spark):
    rows = [(None, "nobody's own text here"), (None, "twice without an id"), (None, "twice without an id"), (3, "one two three")]
    rows += [(3, "one two three"), (2, "once more"), (None, "once more"), (3, "another text of the same id"), (None, None)]
    kept = simhash.keep_one_of_each(brute.frame(spark, rows))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [
        (0, ""), (0, "nobody's own text here"), (0, "twice without an id"), (2, "once more"), (3, "another text of the same id"), (3, "one two three"),
    ]
    assert kept.columns == brute.frame(spark, rows).columns and simhash.keep_one_of_each(brute.frame(spark, rows).limit(0)).count() == 0


def test_masks_cover():
    masks, rnd = simhash.covering_masks(), random.Random(3)
    for _ in range(5000):
        flips = sum(1 << i for i in rnd.sample(range(64), 3))
        assert any(not m & flips for m in masks)


def test_dense_buckets():
    rnd = random.Random(9)
    x = np.unique(np.array([0xDEADBEEF12345678 ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(1500)], np.uint64))
    masks = simhash.covering_masks()
    of, xs = np.repeat(np.arange(15), len(x)), np.tile(x, 15)
    a, b = simhash.link_buckets(of, (xs & np.array(masks, np.uint64)[of]).view(np.int64), xs, masks)
    got = simhash._roots(len(x), np.searchsorted(x, a), np.searchsorted(x, b))
    pairs = [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3) + i + 1]
    assert (got == simhash._roots(len(x), *np.array(pairs).T)).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
