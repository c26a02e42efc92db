"""Token counts, encoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadloom.llm import bpe, packing, token_counts
from threadloom.llm.tokens import PRETOKEN, UNSAFE, byte_level, read_spec

from . import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def spec():
    return read_spec(PATH)


def test_counts(spark):
    got = {(r["doc_id"]): tuple(r)[1:] for r in token_counts.count_tokens(brute.frame(spark), PATH).collect()}
    assert got == {d: (len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for d, t in brute.MIXED}
    assert token_counts.count_tokens(brute.frame(spark).limit(0), PATH).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_of_other_vocabularies(spark, name):
    path = public_tokenizers.path(name)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(brute.frame(spark), path).collect()}
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        wanted = {d: len(sp.encode(t or "")) for d, t in brute.MIXED}
    else:
        t_ = Tokenizer.from_file(path)
        wanted = {d: len(t_.encode(t or "", add_special_tokens=False).ids) for d, t in brute.MIXED}
    assert got == wanted


def test_digests(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digest_documents(brute.frame(spark), PATH).collect()}
    for d, t in brute.MIXED:
        own = ids(t)
        text = LIBRARY.decode(own, skip_special_tokens=False)
        assert got[d] == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    full = {r["doc_id"]: r for r in bpe.encode_documents(brute.frame(spark), PATH).collect()}
    assert all(full[d]["ids"] == ids(t) and full[d]["decoded"] == (t or "") for d, t in brute.MIXED)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(spec, text):
    v, s = byte_level(spec), bpe.speculator(spec)
    assert np.frombuffer(s.encode([text])[0], "<u4").tolist() == ids(text) == v.ids(text).tolist()
    assert s.decode(np.array(ids(text), "<u4").tobytes()) == LIBRARY.decode(ids(text), skip_special_tokens=False)


def test_safe_texts_split_alike(spec):
    """Over every character that the fast pattern is trusted with."""
    chars = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and not UNSAFE.match(c)]
    split = byte_level(spec).library.pre_tokenizer.pre_tokenize_str
    for around in ("a{}a ", "1{}1 ", "!{}! ", " {} x"):
        for k in range(0, len(chars), 4000):
            text = "".join(around.format(c) for c in chars[k : k + 4000])
            assert PRETOKEN.findall(text) == [text[a:b] for _, (a, b) in split(text)]


def test_every_token_encodes_to_itself(spec):
    v = byte_level(spec)
    assert [t for t, i in v.ranks.items() if v.exact(t) != [i]] == []
    assert len(v.ranks) == 50256


def test_pairs_pass_where_merging_keeps_them_apart(spec):
    v, s, rnd = byte_level(spec), bpe.speculator(spec), np.random.default_rng(4)
    n = len(v.ranks)
    short = np.array([i for t, i in v.ranks.items() if len(t) <= 2])
    a = np.concatenate([rnd.integers(0, n, 60000), rnd.choice(short, 60000), np.arange(n)])
    b = np.concatenate([rnd.integers(0, n, 60000), rnd.choice(short, 60000), np.arange(n)])  # twice the same: ties
    wanted = [v.exact(s.token[x] + s.token[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert s.apart(a, b).tolist() == wanted and 0.05 < np.mean(wanted) < 0.95
    assert s.whole(np.arange(n)).all()


def test_long_words_and_few_words(spec, monkeypatch):
    """Words beyond any in the corpus, walked alone or in step."""
    v, rnd = byte_level(spec), random.Random(6)
    words = ["".join(rnd.choice("abcxyz") for _ in range(n)) for n in (1, 399, 400, 401, 5000, 60000)] + ["a" * 30000, "é" * 900, "ab" * 401]
    wanted = {w: np.array(v.exact(w.encode()), "<u4").tobytes() for w in words}
    for few in (0, 3, 16):
        monkeypatch.setattr(bpe, "FEW_WORDS", few)
        assert bpe.Speculator(v).encode_words(words[: 9 if few else 4] + ["some", "short", "ones"]).items() >= {w: wanted[w] for w in words[: 9 if few else 4]}.items()


def test_the_corpus_and_a_very_long_text(spark, folder):
    """Every document of the small table, and one text far beyond the corpus' longest, against the library."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rnd = random.Random(7)
    rows.append((10**9, " ".join(rnd.choice(["the", "of", "naïve", "中文", "x1", "<|endoftext|>", "\n\n", "Zürich"]) for _ in range(400_000))))
    df = brute.frame(spark, rows)
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, PATH).collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digest_documents(df, PATH).collect()}
    for d, t in rows:
        own = ids(t)
        text = LIBRARY.decode(own, skip_special_tokens=False)
        assert counted[d] == len(own)
        assert got[d] == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_long_white_space_and_long_words(spark):
    """Runs that overflow a backtracking regex engine, next to words and alone."""
    rnd = random.Random(8)
    mixed = "".join(rnd.choice(" \t\n") for _ in range(2_000_000))
    rows = [(1, "\n" * 1_000_000), (2, mixed), (3, "a" * 1_000_000), (4, "é <|endoftext|>" + " " * 20_000 + "☃ x"), (5, "a" + " " * 4999 + "b"), (6, "b" + "\u3000" * 9000 + "c")]
    df = brute.frame(spark, rows)
    lengths = {d: len(ids(t)) for d, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, PATH).collect()} == lengths
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.digest_documents(df, PATH).collect()} == lengths
    packed = packing.pack_documents(df, PATH).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] - 1 for r in packed} == lengths


def test_packing_ids_of_the_corpus(spark, folder):
    """Every piece's checksum, over the whole small table, against the library's ids."""
    df = spark.read.parquet(f"{folder}/documents.parquet")
    own = {r["doc_id"]: np.array([*ids(r["text"]), 2], "<u4") for r in df.collect()}
    for r in packing.pack_documents(df, PATH).collect():
        assert r["ids_crc32"] == zlib.crc32(own[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())


def test_packing_of_like_rows(spark):
    """A third of the rows alike and without an id are dealt over all blocks, and each has a place of its own."""
    rows = [(None if i % 3 == 0 else i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    out = packing.pack_documents(brute.frame(spark, rows).repartition(4), PATH).collect()
    assert len(out) == 3000 == len({(r["sequence_id"], r["offset"]) for r in out})
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024


def test_packing_of_the_corpus(spark, folder):
    """Sequences of the whole table against the volume bound; every piece has its place."""
    df = spark.read.parquet(f"{folder}/documents.parquet")
    out = packing.pack_documents(df, PATH).collect()
    volume = sum(len(ids(r["text"])) + 1 for r in df.collect())
    assert sum(r["length"] for r in out) == volume
    n = len({r["sequence_id"] for r in out})
    # no packing can do with fewer than either bound: the volume, and pieces of which no two fit together
    assert n <= 1.01 * max(-(-volume // 1024), sum(r["length"] > 512 for r in out)) + 1


def test_packing(spark):
    rnd = random.Random(1)
    rows = brute.MIXED + [(100 + i, "word " * rnd.randint(0, 1500)) for i in range(300)] + [(100, "again")]
    out = packing.pack_documents(brute.frame(spark, rows), PATH).collect()
    sequences, pieces = {}, {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"]), []).append(r)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for d, t in [x for x in rows if x[0] != 100]:
        own = np.array([*ids(t), 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(own[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(own)
    total = sum(r["length"] for r in out)
    assert len(sequences) <= 1.03 * total / 1024 + 1
    assert packing.pack_documents(brute.frame(spark).limit(0), PATH).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plans_place_everything(lengths):
    histogram = np.bincount(lengths, minlength=65)[:65] if lengths else np.zeros(65, int)
    plan = packing.plan_sequences(histogram)
    placed = np.zeros(65, int)
    for own, n in plan:
        assert sum(own) <= 64 and n > 0
        for x in own:
            placed[x] += n
    assert (placed == histogram).all()
