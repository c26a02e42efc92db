"""Mergeable quantile summaries: evenly spaced order statistics with rank intervals.

A summary is a set of rows with one key: n (rows summarised), x, and bounds of how many rows lie below x
(below_min, below_max) and up to x (upto_min, upto_max). Summaries of batches are exact at their points;
merged ones have intervals, as a batch only tells between which of its points an x lies.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import whole_keys
from .common import materialise

LEAST_POINTS, POINTS, MOST_POINTS = 10, 200, 1000
WHOLE = -1
BOUNDS = ("below_min", "below_max", "upto_min", "upto_max")


def exact_ranks(values: DataFrame, by: list[str], batch: str) -> DataFrame:
    """by, batch, x, below, upto, place, n, distinct of rows of distinct (by, batch, x) and `times`: how many values of
    the batch lie below and up to x, which of its distinct ones x is, and of how many; whole_below, whole_upto and
    whole_n say the same of all batches of `by` together, whole_first whether the row is the first of its x there.

    One range sort of all rows by (by, x), wherever keys begin and end, so a key with a third of the rows fills a
    third of the partitions. Each partition counts by itself; offsets are running sums of the partitions'
    totals, one row for each key in each partition.
    """
    keys = [*by, batch]
    dealt = values.select(*keys, "x", "times").repartitionByRange(*by, "x").withColumn("pid", F.spark_partition_id())
    ranged = materialise(dealt.sortWithinPartitions(*by, "x", batch))
    totals = ranged.groupBy(*by, "pid", batch).agg(F.sum("times").alias("t"), F.count("*").alias("d"))
    nothing = F.lit(0).cast("long")
    own, every = Window.partitionBy(*keys), Window.partitionBy(*by)
    before = own.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    earlier = every.orderBy("pid").rangeBetween(Window.unboundedPreceding, -1)  # all batches' rows of the partitions before
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), nothing)
    offsets = totals.select(
        *keys, "pid", so_far("t", before).alias("t0"), so_far("d", before).alias("d0"), F.sum("t").over(own).alias("n"), F.sum("d").over(own).alias("distinct"),
        so_far("t", earlier).alias("w0"), F.sum("t").over(every).alias("whole_n"),
    )
    joined = _null_safe(ranged, offsets, [*by, "pid", batch])
    here = Window.partitionBy(*by, "pid")
    mine = Window.partitionBy(*by, "pid", batch).orderBy("x")
    rows = Window.unboundedPreceding, 0
    upto, whole = F.col("t0") + F.sum("times").over(mine.rowsBetween(*rows)), F.col("w0") + F.sum("times").over(here.orderBy("x").rangeBetween(*rows))
    return joined.select(
        *keys, "x", (upto - F.col("times")).alias("below"), upto.alias("upto"), (F.col("d0") + F.row_number().over(mine)).alias("place"), "n", "distinct",
        whole.alias("whole_upto"), (whole - F.sum("times").over(Window.partitionBy(*by, "pid", "x"))).alias("whole_below"), "whole_n",
        (F.row_number().over(Window.partitionBy(*by, "pid", "x").orderBy(batch)) == 1).alias("whole_first"),
    )


def _spaced(low: Column, high: Column, total: Column, n: int) -> Column:
    """Whether one of n evenly spaced places of 1..total lies in low+1..high."""
    return F.floor(high * n / total) > F.floor(low * n / total)


def summarise(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """A summary of each key of `exact_ranks`: the x that hold one of POINTS evenly spaced ranks, the least x, and
    LEAST_POINTS evenly spaced ones of the distinct x, so that many equal values can't crowd out the others."""
    held = (
        _spaced(F.col("below"), F.col("upto"), F.col("n"), POINTS)
        | _spaced(F.col("place") - 1, F.col("place"), F.col("distinct"), LEAST_POINTS)
        | (F.col("below") == 0)
    )
    return ranks.where(held).select(
        *keys, "n", "x", *(F.col(b.split("_")[0]).alias(b) for b in BOUNDS)
    )


def merge(summaries: DataFrame, keys: list[str], batch: str, most: int = MOST_POINTS) -> DataFrame:
    """One summary of each key from those of its batches: n and the interval bounds are sums over the batches.

    Between two points of a batch its count is at least the one up to the lower point and at most the one
    below the upper point. Both are step functions of x, so their sums over the batches are running sums of
    the steps; at a batch's own points its own bounds count. A key brings (batches x points) rows together:
    with many batches merge in rounds, by ever coarser batches. More than `most` points are thinned out to
    evenly spaced ones.
    """
    one = Window.partitionBy(*keys, batch).orderBy("x")
    nothing = F.lit(0).cast("long")
    rises = F.col("upto_min") - F.coalesce(F.lag("upto_min").over(one), nothing)
    ceiling = F.coalesce(F.lead("below_max").over(one), F.col("n"))  # of what lies after the point and before the next
    stepped = summaries.repartition(*keys).select(  # the only shuffle: all that follows is within keys
        *keys, batch, "n", "x", *BOUNDS, rises.alias("rise"), ceiling.alias("ceiling"), F.lag("x").over(one).alias("was")
    ).withColumn("_first", F.col("was").isNull())
    lifts = F.col("ceiling") - F.when(F.col("_first"), F.col("below_max")).otherwise(F.lag("ceiling").over(one))
    floor0 = F.when(F.col("_first"), F.col("below_max")).otherwise(0)  # the ceiling before a batch's least point
    points = stepped.withColumn("lift", lifts).groupBy(*keys, "x").agg(
        F.sum("rise").alias("rise"), F.sum("lift").alias("lift"), F.sum(floor0).alias("under"), F.sum(F.when(F.col("_first"), F.col("n"))).alias("rows"),
        F.sum(F.col("below_min") - F.col("upto_min")).alias("d_below_min"), F.sum(F.col("below_max") - F.col("ceiling")).alias("d_below_max"),
        F.sum(F.col("upto_max") - F.col("ceiling")).alias("d_upto_max"),
    )
    key, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    low = F.sum("rise").over(so_far)
    high = F.sum("lift").over(so_far) + F.sum("under").over(key)
    merged = points.select(
        *keys, F.sum("rows").over(key).alias("n"), "x", (low + F.col("d_below_min")).alias("below_min"), (high + F.col("d_below_max")).alias("below_max"),
        low.alias("upto_min"), (high + F.col("d_upto_max")).alias("upto_max"),
        F.row_number().over(Window.partitionBy(*keys).orderBy("x")).alias("place"), F.count("*").over(key).alias("points"),
    )
    middle = F.col("below_min") + F.col("upto_max")
    spread = most - LEAST_POINTS - 2
    before = F.lag(middle).over(Window.partitionBy(*keys).orderBy("x"))
    thin = before.isNull() | (F.col("place") == F.col("points")) | _spaced(before, middle, 2 * F.col("n"), spread)
    thin = thin | _spaced(F.col("place") - 1, F.col("place"), F.col("points"), LEAST_POINTS)
    return merged.withColumn("_held", (F.col("points") <= most) | thin).where("_held").select(*keys, "n", "x", *BOUNDS)


def _targets(n: Column, parts: int) -> list[Column]:
    return [F.ceil(F.lit(i) * n / parts) for i in range(1, parts)]


def estimate(summaries: DataFrame, keys: list[str], parts: int, least: int = 20) -> DataFrame:
    """keys, n, points, i, target, answer and the answer's BOUNDS of every summary of at least `least` rows, for i in
    1..parts-1: target is ceil(i n / parts), answer the point whose rank is sure to be nearest to it, the least of several.

    Answers don't decrease with i: rank intervals of greater points lie higher.
    """
    targets = _targets(F.col("n"), parts)
    off = lambda t: F.greatest(F.lit(0).cast("long"), F.col("below_max") + 1 - t, t - F.col("upto_min"))
    best = [F.min(F.struct(off(t), F.col("x").alias("answer"), *BOUNDS)).alias(f"a{i}") for i, t in enumerate(targets, 1)]
    found = summaries.where(F.col("n") >= least).groupBy(*keys, "n").agg(F.count("*").alias("points"), *best)
    each = [F.struct(F.lit(i).alias("i"), t.alias("target"), *(F.col(f"a{i}")[c].alias(c) for c in ("answer", *BOUNDS))) for i, t in enumerate(targets, 1)]
    return found.select(*keys, "n", "points", F.explode(F.array(*each)).alias("e")).select(*keys, "n", "points", "e.*")


def exact_quantiles(ranks: DataFrame, keys: list[str], n: str, below: str, upto: str, parts: int, least: int) -> DataFrame:
    """keys, i, exact_x: the x of `exact_ranks` that hold the targets."""
    hit = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), t.alias("t")) for i, t in enumerate(_targets(F.col(n), parts), 1))), lambda s: (s["t"] > F.col(below)) & (s["t"] <= F.col(upto)))
    return ranks.where(F.col(n) >= least).select(*keys, F.col("x").alias("exact_x"), F.explode(F.transform(hit, lambda s: s["i"])).alias("i"))


def quantiles_of_batches(rows: DataFrame, by: list[str], batch: str, parts: int = 4, allowed: int = 20, least: int = 20) -> DataFrame:
    """by, batch, i, n, target, exact_x, points, answer, n_below, n_upto, rank_error, within: quantiles of x of each
    batch and, as batch WHOLE, of each key's merged summaries, beside the exact ones.

    Every row has `by`, `batch` (0 or more), x (long) and times, how often it counts; no x is null.
    within: rank_error is at most `allowed` thousandths of n. Repeated rows count each; an empty table gives
    an empty one; keys may be null and are a key of their own then.
    """
    keys = [*by, batch]
    counted = rows.groupBy(*keys, "x").agg(F.sum("times").alias("times"))
    done = materialise(_whole_keys_done(counted, by, batch, parts, allowed, least))
    result = [*keys, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within"]
    others = _across_partitions(done.where("times IS NOT NULL").select(*keys, "x", "times"), by, batch, parts, allowed, least)
    return done.where("times IS NULL").select(*result).unionByName(others.select(*result))


def _whole_keys_done(counted: DataFrame, by: list[str], batch: str, parts: int, allowed: int, least: int) -> DataFrame:
    """by, batch and the result's columns of keys that a range sort left whole in one partition; the rows of the
    other keys, those it cut and the long ones, with x and times beside them. The hash goes first as sorts compare
    numbers faster than texts."""
    rule = functools.partial(whole_keys.answers, parts=parts, allowed=allowed, least=least, points=POINTS, least_points=LEAST_POINTS, most=MOST_POINTS, whole=WHOLE)
    order = [F.col("_hash"), *(F.col(k) for k in by), F.col("x")]
    dealt = counted.withColumn("_hash", F.xxhash64(*by)).repartitionByRange(*order).sortWithinPartitions(*order).select(*by, batch, "x", "times")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in (*by, batch)), whole_keys.RESULT, "x long, times long"])
    return dealt.mapInArrow(whole_keys.finisher(by, batch, rule), schema)


def _across_partitions(counted: DataFrame, by: list[str], batch: str, parts: int, allowed: int, least: int) -> DataFrame:
    """`quantiles_of_batches` of distinct rows, wherever the rows of a key lie."""
    keys = [*by, batch]
    ranks = materialise(exact_ranks(counted, by, batch))
    own = materialise(summarise(ranks, keys))
    whole = ranks.where("whole_first")
    # a batch's summary knows its points' ranks; those of the whole's answers are looked up among all rows
    parts_ = estimate(own, keys, parts, least).withColumnsRenamed({"below_min": "n_below", "upto_min": "n_upto"}).drop("below_max", "upto_max")
    counts = whole.where(F.col("whole_n") >= least).select(*by, F.col("x").alias("answer"), F.col("whole_below").alias("n_below"), F.col("whole_upto").alias("n_upto"))
    all_ = _null_safe(estimate(merge(own, by, batch), by, parts, least).drop(*BOUNDS), counts, [*by, "answer"])
    told = _null_safe(parts_, exact_quantiles(ranks, keys, "n", "below", "upto", parts, least), [*keys, "i"])
    told_all = _null_safe(all_, exact_quantiles(whole, by, "whole_n", "whole_below", "whole_upto", parts, least), [*by, "i"])
    out = told.unionByName(told_all.withColumn(batch, F.lit(WHOLE)))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    out = out.withColumn("rank_error", error).withColumn("within", 1000 * F.col("rank_error") <= allowed * F.col("n"))
    return out.select(*keys, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null, sorted and merged, so that no side is broadcast."""
    own = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(own.hint("merge"), same).drop(*(f"_{k}" for k in keys))


def _batch(id_: Column, batches: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(batches)).cast("int")


def _shifted(money: Column) -> Column:
    return F.floor(100 * money + 0.5) + 1000 * F.col("batch")


def value_rows(clicks: DataFrame, batches: int = 4) -> DataFrame:
    """stream, grp, batch, x and times (1) of the clicks, one row for each click_id.

    Rows of one click_id that differ count once, with the greatest client and value. Clicks without a client
    or a finite value are left out; all without an id are one click.
    """
    one = clicks.groupBy(clicks["click_id"].alias("id")).agg(F.max(clicks["client_id"]).alias("client"), F.max(clicks["value"].cast("double")).alias("money"))
    kept = one.where(F.col("client").isNotNull() & _finite("money")).withColumn("batch", _batch(F.col("id"), batches))
    return kept.select(F.lit("value").alias("stream"), F.col("client").cast("string").alias("grp"), "batch", _shifted(F.col("money")).alias("x"), F.lit(1).cast("long").alias("times"))


def price_rows(lines: DataFrame, items: DataFrame, batches: int = 4) -> DataFrame:
    """stream, grp, batch, x, times of the sale lines by their items: lines of one item and batch are counted before
    the join, so that a hot item is a row for each batch. Lines without an item, and items without a brand or a
    finite price, are left out; an item that is there twice counts twice; a line without a vendor is in the
    batch of the empty text."""
    dealt = lines.select(lines["item_id"].alias("item"), _batch(lines["vendor_id"], batches).alias("batch")).where("item IS NOT NULL")
    counted = dealt.groupBy("item", "batch").agg(F.count("*").alias("times"))
    own = items.select(items["item_id"].alias("item"), items["brand"].cast("string").alias("grp"), items["price"].cast("double").alias("money"))
    priced = counted.join(own.where(F.col("grp").isNotNull() & _finite("money")).hint("merge"), "item")
    return priced.select(F.lit("price").alias("stream"), "grp", "batch", _shifted(F.col("money")).alias("x"), "times")


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
