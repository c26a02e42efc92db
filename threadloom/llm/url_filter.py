"""URL filtering: fixed rules first, mined association rules for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# fixed rules (host, path, verdict) of the registered query
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@dataclass(frozen=True)
class Mining:
    """What a mined rule needs: its share of all labelled URLs, its confidence, and its length at most."""

    support: float = 0.005
    confidence: float = 0.8
    default: str = "allow"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z in lower case) and path; both empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits the host or a domain above it and begins the path, as (rule, verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=False):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL by place: top domain, words of the host, first folder, all further ones and their number."""
    labels = F.split(host, r"\.")
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    words = F.flatten(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.split(x, "-")))
    found = F.concat(
        F.array(F.concat(F.lit("top:"), F.element_at(labels, -1))),
        F.transform(words, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.slice(folders, 1, 1), lambda x: F.concat(F.lit("first:"), x)),
        F.transform(F.slice(folders, 2, F.greatest(F.size(folders) - 1, F.lit(0))), lambda x: F.concat(F.lit("folder:"), x)),
        F.array(F.concat(F.lit("folders:"), F.least(F.size(folders), F.lit(9)).cast("string"))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def mine(labelled: DataFrame, mining: Mining) -> DataFrame:
    """rule_id, antecedent, verdict, confidence, support of the rules of a table (tokens, label).

    Rows are counted as often as they come; null or empty token sets count and support no rule. An empty
    table, or one whose labels nothing tells apart, gives an empty one.

    Spark's FP-growth finds the frequent token sets. Tokens below the support are dropped first, which
    no frequent set can hold. Tokens of the same URLs (all folders of one long path) are mined as one, as
    together they say no more than each alone, and each stands in for it in the rules. A rule is dropped if a part of its antecedent says the same with no less
    confidence.
    """
    spark = labelled.sparkSession
    schema = "rule_id long, antecedent array<string>, verdict string, confidence double, support double"
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], schema)
    # at most (tokens of a URL) / support of these, whatever the number of URLs
    place = [F.sum(F.xxhash64(F.lit(k), F.array_sort("tokens")).bitwiseAND(F.lit((1 << 31) - 1))).alias(f"h{k}") for k in (1, 2)]
    counted = labelled.select("tokens", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *place)
    alike: dict[tuple, list[str]] = {}
    for r in counted.where(F.col("n") >= mining.support * n).orderBy("token").collect():
        alike.setdefault((r["n"], r["h1"], r["h2"]), []).append(r["token"])
    usual = [x[0] for x in alike.values()]
    one = labelled.select("label", F.filter("tokens", lambda x: x.isin(usual) if usual else F.lit(False)).alias("tokens"))
    baskets = one.select(F.array_union("tokens", F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=mining.support, minConfidence=mining.confidence).fit(baskets)
    found = (
        model.associationRules.where(F.col("consequent")[0].startswith("label:"))
        .where(~F.exists("antecedent", lambda x: x.startswith("label:")))
        .select(F.array_sort("antecedent").alias("antecedent"), F.expr("substring(consequent[0], 7)").alias("verdict"), "confidence", "support")
    )
    found = materialise(found)
    a, b = found.alias("a"), found.alias("b")
    # a rule is found by one of its tokens, and its parts share that token
    parts_ = (
        a.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
        .join(
            b.select(
                F.col("antecedent").alias("part"), F.col("verdict").alias("says"), F.col("confidence").alias("sure"), F.col("antecedent")[0].alias("token")
            ),
            "token",
        )
        .where("verdict = says AND sure >= confidence AND size(part) < size(antecedent) AND size(array_except(part, antecedent)) = 0")
        .select("antecedent", "verdict")
        .distinct()
    )
    kept = found.join(parts_, ["antecedent", "verdict"], "left_anti")
    more = [(x[0], x) for x in alike.values() if len(x) > 1]
    if more:
        others = F.broadcast(spark.createDataFrame(more, "token string, others array<string>"))
        each = kept.select("*", F.explode("antecedent").alias("token")).join(others, "token", "left")
        sets = F.array_agg(F.coalesce("others", F.array("token")))
        chosen = F.aggregate(
            "sets",
            F.array(F.array().cast("array<string>")),
            lambda acc, x: F.flatten(F.transform(acc, lambda a: F.transform(x, lambda t: F.array_append(a, t)))),
        )
        kept = (
            each.groupBy("antecedent", "verdict", "confidence", "support")
            .agg(sets.alias("sets"))
            .select(F.explode(chosen).alias("antecedent"), "verdict", "confidence", "support")
            .withColumn("antecedent", F.array_sort("antecedent"))
        )
    return materialise(kept.select(F.xxhash64("antecedent", "verdict").alias("rule_id"), "antecedent", "verdict", "confidence", "support"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, tokens) -> key, mined verdict and rule of those that a rule fits: the most confident, then best
    supported, longest, first in order. Keys without tokens, or without a rule that fits, have no row.

    The inverted index lists each rule under its rarest token, by support. Distinct token sets are
    matched once, so a host that fills the table costs one lookup.
    """
    weight = rules.select(F.explode("antecedent").alias("token"), "support").groupBy("token").agg(F.max("support").alias("w"))
    rare = (
        rules.select("rule_id", F.explode("antecedent").alias("token"))
        .join(weight, "token")
        .groupBy("rule_id")
        .agg(F.min(F.struct("w", "token")).getField("token").alias("token"))
    )
    index = rules.join(rare, "rule_id")
    hits = (
        urls.select("key", "tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
    )
    best = F.struct("confidence", "support", F.size("antecedent").alias("n"), F.array_join("antecedent", " ").alias("mined_rule"), "verdict")
    return hits.groupBy("key").agg(F.max(best).alias("best")).select("key", "best.verdict", "best.mined_rule", "best.confidence")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, mining: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule and confidence of every row.

    A fixed rule's verdict stands. URLs under fixed rules are the labelled ones from which FP-growth
    mines token combinations; the best mined rule judges the others, and where none fits the verdict
    is the default (allow). Null URLs and those without `://` have an empty host and path and no
    tokens, so they get the default. Repeated rows give repeated rows, null ids stay null, an empty
    table gives an empty one; other columns are ignored.
    """
    host, path = parts(pages["url"].cast("string"))
    rows = (
        pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
        .withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
        .withColumn("tokens", tokens(F.col("host"), F.col("path")))
    )
    mined = mine(rows.where("fixed IS NOT NULL").select("tokens", F.col("fixed.verdict").alias("label")), mining)
    # only tokens of rules matter, so that URLs apart in others are one key
    known = [r["token"] for r in mined.select(F.explode("antecedent").alias("token")).distinct().collect()]
    rows = rows.withColumn("tokens", F.array_sort(F.filter("tokens", lambda x: x.isin(known) if known else F.lit(False))))
    open_ = rows.where("fixed IS NULL").select("tokens").distinct()
    matched = match(open_.select(F.col("tokens").alias("key"), "tokens"), mined).select(
        "key", F.col("verdict").alias("says"), "mined_rule", "confidence"
    )
    matched = materialise(matched)  # so that the join's sides are both shuffled and a hot token set can be split
    out = rows.withColumn("key", F.when(F.col("fixed").isNull(), F.col("tokens"))).join(matched, "key", "left")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "says", F.lit(mining.default)).alias("verdict"),
        "mined_rule",
        "confidence",
    )
