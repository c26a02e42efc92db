"""Summaries of quantiles against sorted lists."""

import functools
import math
import random
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.llm import quantiles as Q
from threadloom.llm import whole_keys

KEYS = ["k", "batch"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, batch int, x long, times long")


def made(seed=1):
    """Small and large keys, heavy ties, a hot key."""
    rnd = random.Random(seed)
    rows = []
    for k, n in (("one", 1), ("few", 19), ("edge", 20), ("some", 90), ("many", 3000), ("hot", 9000)):
        for _ in range(n):
            x = {"hot": lambda: 5 if rnd.random() < 0.7 else rnd.randint(0, 10**6), "some": lambda: rnd.randint(0, 3)}.get(k, lambda: rnd.randint(-500, 5000))()
            rows.append((k, rnd.randint(0, 3) if k != "edge" else 0, x, 1))
    return rows


def lists(rows):
    out = defaultdict(list)
    for k, b, x, times in rows:
        for key in ((k, b), (k, Q.WHOLE)):
            out[key] += [x] * times
    return {k: sorted(v) for k, v in out.items()}


def test_exact_ranks(spark):
    rows = made()
    sorted_ = lists(rows)
    summed = frame(spark, rows).groupBy("k", "batch", "x").agg(F.sum("times").alias("times"))
    got = Q.exact_ranks(summed, ["k"], "batch").collect()
    assert len(got) == len({r[:3] for r in rows}) and sum(r["whole_first"] for r in got) == len({(r[0], r[2]) for r in rows})
    for r in got:
        own = sorted_[r["k"], r["batch"]]
        assert (r["below"], r["upto"]) == (sum(v < r["x"] for v in own), sum(v <= r["x"] for v in own))
        assert (r["n"], r["distinct"], r["place"]) == (len(own), len(set(own)), sorted(set(own)).index(r["x"]) + 1)
        every = sorted_[r["k"], Q.WHOLE]
        assert (r["whole_below"], r["whole_upto"], r["whole_n"]) == (sum(v < r["x"] for v in every), sum(v <= r["x"] for v in every), len(every))


def test_quantiles(spark):
    rows = made()
    sorted_ = lists(rows)
    out = Q.quantiles_of_batches(frame(spark, rows).repartition(5), ["k"], "batch").collect()
    assert {(r["k"], r["batch"], r["i"]) for r in out} == {(*k, i) for k, v in sorted_.items() if len(v) >= 20 for i in (1, 2, 3)}
    answers = defaultdict(list)
    for r in sorted(out, key=lambda r: r["i"]):
        own = sorted_[r["k"], r["batch"]]
        n, t = len(own), -(-r["i"] * len(own) // 4)
        assert (r["n"], r["target"], r["exact_x"]) == (n, t, own[t - 1])
        below, upto = sum(v < r["answer"] for v in own), sum(v <= r["answer"] for v in own)
        assert (r["n_below"], r["n_upto"]) == (below, upto) and r["rank_error"] == max(0, below + 1 - t, t - upto)
        assert r["within"] and 1000 * r["rank_error"] <= 20 * n
        assert min(10, len(set(own))) <= r["points"] <= min(n, 1000) and own[0] <= r["answer"] <= own[-1]
        answers[r["k"], r["batch"]].append(r["answer"])
    assert all(a == sorted(a) for a in answers.values())


def test_merged_intervals_hold_the_counts(spark):
    """Also merged twice, and thinned out."""
    rows = made(2)
    summed = frame(spark, rows).groupBy("k", "batch", "x").agg(F.sum("times").alias("times"))
    own = Q.summarise(Q.exact_ranks(summed, ["k"], "batch"), KEYS)
    pairs = Q.merge(own.withColumn("half", F.expr("batch div 2")), ["k", "half"], "batch")
    twice = Q.merge(pairs, ["k"], "half")
    once = Q.merge(own, ["k"], "batch")
    thin = Q.merge(own, ["k"], "batch", most=40)
    whole = {k: v for (k, b), v in lists(rows).items() if b == Q.WHOLE}
    for df in (once, twice, thin):
        counts = defaultdict(int)
        for r in df.collect():
            v = whole[r["k"]]
            below, upto = sum(y < r["x"] for y in v), sum(y <= r["x"] for y in v)
            assert r["n"] == len(v) and r["below_min"] <= below <= r["below_max"] and r["upto_min"] <= upto <= r["upto_max"]
            counts[r["k"]] += 1
            if df is not thin:
                assert r["upto_max"] - r["upto_min"] <= len(v) / 50 and r["below_max"] - r["below_min"] <= len(v) / 50
        assert all(min(10, len(set(whole[k]))) <= c <= (40 if df is thin else 1000) for k, c in counts.items()) and counts.keys() == whole.keys()


def test_streams(spark):
    """Nulls, repeated and broken rows, an item that isn't there, ids of all kinds."""
    clicks = [(1, 7, 1.0, "a"), (1, 7, 1.0, "b"), (2, None, 1.0, "a"), (3, 7, None, "a"), (4, 7, float("nan"), "a"), (5, 7, float("inf"), "a"), (None, 7, -2.345, "a"), (None, 7, -2.345, "a"), (-6, 8, 0.005, "a")]
    made_ = spark.createDataFrame(clicks, "click_id long, client_id long, value double, batch string")
    crc = lambda v: zlib.crc32(str(v).encode() if v is not None else b"") % 4
    got = sorted(map(tuple, Q.value_rows(made_).collect()))
    assert got == sorted([("value", "7", crc(1), 100 + 1000 * crc(1), 1), ("value", "7", crc(None), math.floor(100 * -2.345 + 0.5) + 1000 * crc(None), 1), ("value", "8", crc(-6), 1 + 1000 * crc(-6), 1)])
    lines = spark.createDataFrame([(1, 5), (1, 5), (1, None), (2, 5), (3, 5), (None, 5), (4, 5), (9, 5)], "item_id long, vendor_id long")
    items = spark.createDataFrame([(1, "B", 2.5), (2, None, 1.0), (3, "C", None), (4, "C", 1e3), (None, "B", 1.0)], "item_id long, brand string, price double")
    got = sorted(map(tuple, Q.price_rows(lines, items).collect()))
    assert got == sorted([("price", "B", crc(5), 250 + 1000 * crc(5), 2), ("price", "B", 0, 250, 1), ("price", "C", crc(5), 100000 + 1000 * crc(5), 1)])
    nothing = Q.value_rows(made_.limit(0)).unionByName(Q.price_rows(lines.limit(0), items))
    assert Q.quantiles_of_batches(nothing, ["stream", "grp"], "batch").count() == 0


def test_null_keys_are_keys(spark):
    rows = [(None, 0, x, 1) for x in range(40)] + [("a", 0, x, 2) for x in range(10)]
    out = Q.quantiles_of_batches(frame(spark, rows), ["k"], "batch").collect()
    assert sorted((r["k"] or "", r["batch"], r["i"], r["answer"]) for r in out) == sorted((k, b, i, x) for k, xs in (("", (9, 19, 29)), ("a", (2, 4, 7))) for b in (0, -1) for i, x in enumerate(xs, 1))


def test_a_hot_key_fills_many_partitions(spark):
    """A range sort splits a key: none of the sort's tasks has more than a fair share."""
    rows = spark.range(0, 60000, 1, 8).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('k', id % 50) END AS k", "0 AS batch", "id * 7919 % 60000 AS x", "1L AS times")
    dealt = rows.repartitionByRange(16, "k", "x").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 3 * 60000 / 16
    got = Q.exact_ranks(rows, ["k"], "batch").where("k = 'hot'").agg(F.max("upto"), F.count("*"), F.countDistinct("below")).first()
    assert tuple(got) == (40000, 40000, 40000)


def many(seed=3):
    """Keys of all sizes, few and many batches, ties within and across batches, a null key, summaries to thin out."""
    rnd = random.Random(seed)
    rows = []
    for k in range(300):
        n, width, batches = rnd.choice([1, 5, 19, 20, 30, 80, 400]), rnd.choice([1, 3, 50, 10**6]), rnd.choice([1, 2, 4, 9])
        rows += [(f"k{k}" if k else None, rnd.randrange(batches), rnd.randint(-width, width), rnd.randint(1, 3)) for _ in range(n)]
    return rows + [(k, rnd.randrange(9), rnd.randint(0, 10**6), 1) for k in ("big1", "big2") for _ in range(9000)]


def test_only_cut_keys_are_ranked_across_partitions(spark, monkeypatch):
    """Keys that lie in one partition are done there, with the rows that the ranks across partitions give."""
    rows, seen = frame(spark, many()), []
    counted = rows.groupBy("k", "batch", "x").agg(F.sum("times").alias("times"))
    ranks = Q.exact_ranks
    monkeypatch.setattr(Q, "exact_ranks", lambda values, by, batch: seen.append(values) or ranks(values, by, batch))
    got = Q.quantiles_of_batches(rows, ["k"], "batch")
    assert [df.select("k").distinct().count() <= 2 * 4 for df in seen] == [True]
    plain = Q._across_partitions(counted, ["k"], "batch", 4, 20, 20)
    assert got.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_whole_keys_in_chunks():
    """Wherever batches and chunks end, and whether keys are long: inner keys are done, the others' rows come out as they went in."""
    counts = defaultdict(int)
    for k, b, x, times in many(4)[:4000]:
        counts[k or "", x, b] += times
    table = pa.table({"k": [k or None for k, _, _ in sorted(counts)], "batch": pa.array([b for *_, b in sorted(counts)], pa.int32()), "x": [x for _, x, _ in sorted(counts)], "times": [counts[c] for c in sorted(counts)]})
    rule = functools.partial(whole_keys.answers, parts=4, allowed=20, least=20, points=200, least_points=10, most=1000, whole=-1)
    expected, keys = None, [k or None for k in sorted({k for k, *_ in counts})]
    size = {k: sum(c[0] == (k or "") for c in counts) for k in keys}
    for rows, chunk in ((10**6, 10**6), (7, 10**6), (7, 500), (1, 50), (100, 30), (333, 1)):
        out = pa.Table.from_batches(whole_keys.finisher(["k"], "batch", rule, chunk)(iter(table.to_batches(rows)))).to_pylist()
        passed = [(r["k"], r["batch"], r["x"], r["times"]) for r in out if r["times"] is not None]
        done = {(r["k"], r["batch"], r["i"]): r for r in out if r["times"] is None}
        left = {r[0] for r in passed}
        expected = expected or done
        assert {keys[0], keys[-1]} <= left and left <= {keys[0], keys[-1]} | {k for k in keys if size[k] >= chunk}
        assert sorted(passed, key=repr) == sorted(((r["k"], r["batch"], r["x"], r["times"]) for r in table.to_pylist() if r["k"] in left), key=repr)
        assert done == {k: v for k, v in expected.items() if k[0] not in left}
