"""Toxicity, URL rules, nearest neighbours, fingerprints."""

import hashlib
import pathlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import ann, minhash, toxicity, url_filter
from threadloom.llm.common import release, unpack

from . import brute


def planted(n=700):
    rnd = random.Random(2)
    plain = [f"w{i}" for i in range(400)]
    bad = ["grumble", "snarl", "hiss"]
    rows, labels = [], []
    for i in range(n):
        w = rnd.choices(plain, k=rnd.randint(5, 80))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, None, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = planted()
    known = spark.createDataFrame(labels + [(5, None, None), (99999, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(brute.frame(spark, rows + brute.MIXED[1:4]), known).collect()
    truth = {d: t for d, _, t in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == toxicity.held_out(r["doc_id"]) for r in out)
    right = [r["predicted"] == truth[r["doc_id"]] for r in held]
    assert len(held) > 80 and sum(right) >= 0.95 * len(right)
    assert not any(r["predicted"] for r in out if r["doc_id"] == 2 and r["score"] < 0.5)
    clean = toxicity.keep_clean(brute.frame(spark, rows), known)
    assert clean.columns == brute.frame(spark, rows).columns
    kept = {r["doc_id"] for r in clean.collect()}
    assert kept == {r["doc_id"] for r in out if r["doc_id"] in dict(rows) and r["predicted"] == 0}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score_documents(brute.frame(spark), none).collect()
    assert len(out) == len(brute.MIXED) and {r["predicted"] for r in out} == {0}
    assert toxicity.score_documents(brute.frame(spark).limit(0), none).count() == 0


def test_label_model_trusts_agreeing_voters():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.3).astype(float)
    votes = np.stack([np.where(rng.random(2000) < 0.85, y, rng.random(2000) < 0.02) for _ in range(6)], 1)
    votes = np.hstack([votes, votes.sum(1, keepdims=True) == 0])  # as the pattern voters do
    noisy = np.where(rng.random(2000) < 0.1, 1 - y, y)
    assert ((toxicity.label_model(votes.astype(float), noisy) > 0.5) == y).mean() > 0.93


@pytest.mark.parametrize("share", [0.1, 0.2])
def test_label_model_mends_flipped_labels(share):
    rng = np.random.default_rng(1)
    y = (rng.random(3000) < 0.15).astype(float)
    votes = np.stack([np.where(y > 0, rng.random(3000) < 0.35, rng.random(3000) < 0.01) for _ in range(20)], 1).astype(float)
    votes = np.hstack([votes, votes[:, :5], votes.sum(1, keepdims=True) == 0])  # five voters twice, and a pattern
    flipped = rng.random(3000) < share
    side = toxicity.label_model(votes, np.where(flipped, 1 - y, y)) > 0.5
    assert (side == y)[flipped].mean() > 0.9 and (side == y)[~flipped].mean() > 0.97


def test_toxicity_on_the_real_labels(spark, folder):
    """Held-out rows of the whole tables; scores are the same however the tables are cut."""
    larger = pathlib.Path(folder).parent / "sf0.1"
    folder = str(larger) if larger.exists() else folder
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(truth[d], r["predicted"]) for d, r in scored.items() if r["held_out"] and d in truth]
    assert sum(p for t, p in held if t) >= 0.85 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.01 * len(held)
    again = toxicity.score_documents(docs.repartition(5), labels.repartition(3)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {d: r["score"] for d, r in scored.items()}


def test_counts_add_up_over_many_tasks(spark):
    rows, labels = planted(300)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = toxicity._learnable(brute.frame(spark, rows), known)
    few, many = (sorted(map(tuple, toxicity._count(x).collect())) for x in (kept.coalesce(1), kept.repartition(2 * toxicity.FAN_IN + 3)))
    assert few and few == many
    bits = toxicity._bits(known)
    assert bits.sum() == 300 and bits.size == toxicity.ID_BITS


def test_counts_leave_a_task_slice_by_slice(monkeypatch):
    """All arrays in one batch were held three times over in the worker and once more in the executor."""
    sent = []

    class Rows:
        rdd = SimpleNamespace(getNumPartitions=lambda: 1)

        def mapInArrow(self, count, schema):
            batch = pa.record_batch([pa.array([1, 2]), pa.array(["snarl at all", "snarl"]), pa.array([1, 0], pa.int32()), pa.array([0, 0], pa.int32())], ["doc_id", "text", "toxic", "fold"])
            sent.extend(count(iter([batch])))
            return SimpleNamespace(groupBy=lambda *_: SimpleNamespace(applyInArrow=lambda *_: None))

    monkeypatch.setattr(toxicity, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    toxicity._count(Rows())
    each = toxicity.FEATURES // toxicity.CHUNKS
    assert [b.column("chunk").to_pylist() for b in sent] == [[k] for k in range(toxicity.CHUNKS)] and {b.column("part")[0].as_py() for b in sent} == {3}
    assert max(b.nbytes for b in sent) < each * (4 * 2 * toxicity.FOLDS + 2) + 1000
    clean, toxic = (sum(unpack(b.column(c)[0].as_py(), np.int32).sum() for b in sent) for c in ("n0", "n1"))
    grams = [len(toxicity.grams([t.encode()])[0]) for t in ("snarl", "snarl at all")]
    assert [clean, toxic] == grams and grams[1] > grams[0] > 0


def test_freed_memory_goes_back_to_the_system():
    """Small pieces that stay keep the C library from giving back what was freed between them."""

    def resident():
        return int(pathlib.Path("/proc/self/statm").read_text().split()[1]) * 4096

    rows = [bytes(60_000) for _ in range(4000)]  # each below the size that gets a mapping of its own
    stay = rows[::2]
    del rows
    before = resident()
    release()
    assert resident() < before - 60_000_000 and len(stay) == 2000


def test_copies_of_one_text_are_one_row_to_learn_from(spark):
    rows, labels = planted(200)
    rows += [(1000 + i, "the very same words in a row") for i in range(50)] + [(None, "no id")]
    known = spark.createDataFrame(labels + [(1000 + i, None, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    kept = toxicity._learnable(brute.frame(spark, rows), known).where("doc_id >= 1000").collect()
    ids = [1000 + i for i in range(50) if not toxicity.held_out(1000 + i)]
    assert sorted(r["doc_id"] for r in kept) == sorted([min(i for i in ids if i % 2 == 0), min(i for i in ids if i % 2)])


URLS = [
    (1, None), (2, "no scheme"), (3, "http://A.COM"), (4, "http://WWW.example.com/en/x?q"), (5, "http://a.example.com/en/"), (6, "x://net/es/.."),
    (7, "http://xnet/es/"), (8, "http://a.net/fr/?x://b.com/"), (None, "http://a.org/en/1#q"), (9, "http://a.com?b/"), (10, "é://é.com/é\n/x"), (5, "http://a.example.com/en/"),
]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p) for h, p, _ in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_urls(spark, folder):
    extra = spark.createDataFrame([(*r, "host", 1) for r in URLS], "page_id long, url string, host string, verdict int")
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    verdicts = {h + p: v for h, p, v in url_filter.RULES}
    for df in (extra, pages):
        rows = sorted(((r["page_id"] or 0, r["url"]) for r in df.collect()), key=str)
        got = url_filter.judge(df).collect()
        assert sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"] or "") for r in got) == sorted(
            (d, h, p, rule or "") for d, (h, p, rule) in ((d, plain_rule(u)) for d, u in rows)
        )
        assert all(r["verdict"] == verdicts.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block") for r in got)
    assert url_filter.judge(extra.limit(0)).count() == 0


def test_deeper_folders_tell_urls_apart(spark):
    deep = "/".join(f"d{i}" for i in range(40))
    rows = [(i, f"http://www.example.com/en/{i % 7}/good/{deep}") for i in range(60)] + [(100 + i, f"http://example.com/en/{i % 7}/bad/x") for i in range(60)]
    rows += [(200, "http://host.org/x/bad/y"), (201, "http://host.org/x/good/y"), (202, "http://host.org/x/z/d39")]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i]["verdict"] for i in (200, 201, 202)] == ["block", "allow", "allow"]
    assert [got[i]["mined_rule"] for i in (200, 201, 202)] == ["folder:bad", "folder:good", "folder:d39"]


def test_mined_rules_are_those_of_brute_force(spark):
    rnd = random.Random(6)
    rows = [(sorted(rnd.sample("abcdef", rnd.randint(1, 4))), rnd.choice(["allow", "block", "block"])) for _ in range(300)]
    mining = url_filter.Mining(support=0.02, confidence=0.7)
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), mining).collect()}
    from itertools import combinations

    every = {}
    for n in range(1, 5):
        for x in combinations("abcdef", n):
            of = [label for t, label in rows if set(x) <= set(t)]
            for v in ("allow", "block"):
                if of and of.count(v) >= 0.02 * len(rows) and of.count(v) / len(of) >= 0.7:
                    every[x, v] = of.count(v) / len(of)
    wanted = {
        (x, v): c for (x, v), c in every.items()
        if not any(v == w and d >= c and set(y) < set(x) for (y, w), d in every.items())
    }
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k]) for k in got)
    urls = spark.createDataFrame([(i, list(t)) for i, (t, _) in enumerate(rows)], "key long, tokens array<string>")
    rules = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), mining)
    matched = {r["key"]: (r["verdict"], r["confidence"]) for r in url_filter.match(urls, rules).collect()}
    for i, (t, _) in enumerate(rows):
        best = max((c for (x, _), c in wanted.items() if set(x) <= set(t)), default=None)
        assert (matched[i][1] if i in matched else None) == (pytest.approx(best) if best is not None else None)


def exact(rows, k=10, every=100):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            order = np.lexsort((ids, d))
            out[int(q)] = [(int(ids[j]), d[j]) for j in order if ids[j] != q][:k]
    return out


def test_nearest(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label")
    truth = exact([(r[0], r[1]) for r in df.collect()])
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = sum(len({v for v, _ in truth[q]} & {v for v, _ in got[q].values()}) for q in truth)
    assert hits >= 0.9 * sum(map(len, truth.values()))
    for q, ranks in got.items():
        assert [*sorted(ranks)] == [*range(1, 11)] and [x[1] for _, x in sorted(ranks.items())] == sorted(s for _, s in ranks.values())


@pytest.mark.parametrize(("times", "step"), [(400, 0.0), (60, 1e-4), (400, 1e-4)])
def test_nearest_of_one_id_many_times(spark, times, step):
    rows = [(0, [1.0, 0.0])] + [(1, [1.1 + i * step, 0.0]) for i in range(times)] + [(i, [1.0 + i, 0.0]) for i in range(2, 30)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i) for i in range(1, 11)]


def recall_and_share(x, queries, k=10):
    """Recall of the k nearest and share of all rows seen, by a forest fitted as the operator does."""
    forest = ann.Forest(x)
    most, leaf = forest.effort(x, np.arange(len(x)), k), forest.leaves(x)
    hits, seen = [], []
    for i in queries:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        own = np.zeros(len(x), bool)
        for t, n in forest.search(x[i], most):
            own |= leaf[t] == n
        hits.append(own[np.argsort(d)[:k]].mean())
        seen.append(own.mean())
    return np.mean(hits), np.mean(seen)


def test_search_prunes_where_vectors_have_structure():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(250, 48))[rng.integers(0, 250, 8000)] + 0.15 * rng.normal(size=(8000, 48))
    recall, seen = recall_and_share(x, range(0, 8000, 80))
    assert recall >= 0.95 and seen < 0.1
    flat = rng.normal(size=(8000, 6))
    recall, seen = recall_and_share(flat, range(0, 8000, 80))
    assert recall >= 0.95 and seen < 0.2
    one, same = np.arange(1), np.ones((50, 3))
    assert ann.Forest(x[:1]).effort(x[:1], one, 10) == 1 and ann.Forest(same).effort(same, np.zeros(50), 10) == 1


def test_recall_over_the_larger_table(spark, folder):
    larger = pathlib.Path(folder).parent / "sf0.1"
    df = spark.read.parquet(f"{larger if larger.exists() else folder}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = 0
    for q, near in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        found += len(near & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert set(got) == set(ids[ids % 100 == 0].tolist()) and found >= 0.9 * 10 * len(got)


def test_nearest_of_copies_and_odd_rows(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(300)]
    odd = [(None, [1.0, 2.0]), (1000, None), (1100, [0.0, 0.0]), (1200, [float("nan"), 1.0]), (1300, [None, 1.0]), (1400, [1.0]), (1500, [float("inf"), 1.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: [(v, s) for _, v, s in sorted(x)] for q, x in got.items()} == exact(rows)
    few = ann.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 1.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_fingerprints(spark, folder):
    corpus = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    for rows in (corpus, [x for x in brute.MIXED if x[0] is not None], [(5, "a b c")]):
        order = sorted(rows, key=lambda r: -r[0])
        got = {r["doc_id"]: r for r in minhash.fingerprint_edits(brute.frame(spark, rows)).collect()}
        assert len(got) == len(rows)
        errors = []
        for i, (d, t) in enumerate(order):
            t, following = t or "", order[(i + 1) % len(order)][1] or ""
            cut = len(t) // 3
            new = t[: len(t) - cut] + following[:cut]
            r = got[d]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
            for name, other in (("edited", new), ("next", following)):
                j = brute.shingle_likeness(t, other)
                assert r[f"jaccard_{name}"] == pytest.approx(j) and (r[f"bands_{name}"] > 0 or j < 0.8) and (r[f"bands_{name}"] == 32 or j < 1)
            errors += [r["near_edited"] - brute.shingle_likeness(t, new), r["near_next"] - brute.shingle_likeness(t, following)]
        assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02
        by_text = {}
        for d, t in rows:
            assert by_text.setdefault(t or "", got[d]["fingerprint"]) == got[d]["fingerprint"]


def test_fingerprints_of_odd_rows(spark):
    out = minhash.fingerprint_edits(brute.frame(spark, [(None, "x y z"), (3, "a b c"), (3, "a b d"), (1, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in out) == [(-1, 5), (1, 0), (3, 5), (3, 5)]
    assert minhash.fingerprint_edits(brute.frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 9, 1 << 20])
def test_successors_over_slots_and_hot_ids(spark, monkeypatch, most):
    """A third of the rows have one id, a third none: their slots are split, and each row has its successor."""
    monkeypatch.setattr(minhash, "MOST_SLOTS", most)
    rnd = random.Random(5)
    text = lambda i: " ".join(f"{rnd.randrange(50)}" for _ in range(rnd.randint(0, 12)))
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, text(i)) for i in range(900)]
    df = brute.frame(spark, rows).repartition(4)
    keyed = minhash._keyed(df.select("doc_id", "text"))
    slot, _ = minhash._slots(keyed)
    slots = keyed.select(slot("id", "place").alias("slot"), "doc_id").distinct().groupBy("doc_id").count().where("doc_id IS NULL OR doc_id = 77").collect()
    assert {r["count"] for r in slots} == {1} if most == 1 else max(r["count"] for r in slots) > 1
    order = [(r["doc_id"], r["text"]) for r in keyed.orderBy(keyed["id"].desc(), keyed["place"].desc(), "text").collect()]
    wanted = []
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        cut = len(t) // 3
        wanted.append((d or -1, len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()))
    got = [(r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in minhash.fingerprint_edits(df).collect()]
    assert sorted(got) == sorted(wanted)


def test_similar_documents(spark, folder):
    corpus = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    made = []
    for i in range(200):
        w = list(base)
        for _ in range(rnd.randint(0, 8)):
            w[rnd.randrange(200)] = f"x{rnd.randint(0, 9)}"
        made.append((100000 + i, " ".join(w)))
    rows = corpus + made + [(200000, ""), (200050, " "), (None, made[0][1]), (200001, corpus[0][1])]
    got = {(r["query_id"], r["doc_id"]): r["jaccard"] for r in minhash.similar_documents(brute.frame(spark, rows), 10).collect()}
    least, query = {}, {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        least.setdefault(t, d)
        if d % 10 == 0:
            query.setdefault(t, d)
    wanted = {
        (q, d): j for t, q in query.items() for u, d in least.items()
        if t != u and t.split() and u.split() and (j := brute.shingle_likeness(t, u)) >= 0.8
    }
    assert len(wanted) > 50 and got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k]) for k in got)
    assert minhash.similar_documents(brute.frame(spark).limit(0)).count() == 0
