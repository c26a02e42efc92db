"""The operators as registered queries: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, filter_audit, minhash, packing, quantiles, simhash, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter, warc
from .common import documents

VOCABULARY = "byte_bpe_50k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest_repeated_spans(documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_repeated_bytes(documents(spark, sf_dir))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_edits(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, lines, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "sale_lines", "items"))
    rows = quantiles.value_rows(clicks).unionByName(quantiles.price_rows(lines, items))
    return quantiles.quantiles_of_batches(rows, ["stream", "grp"], "batch")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op2_url_filter: hosts, paths and the fixed rules that fit."""
    return op2_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def document_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op10_minhash: lengths and edited texts."""
    return op10_minhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_url_filter, op3_toxicity, op4_token_counts, op5_bpe,
        op6_packing, op7_simhash, op8_suffix_dedup, op9_nearest, op10_minhash, op11_warc, op12_quantiles, op13_filter_audit,
        url_rules, document_edits,
    )
}
#: The operators without SQL can't be told whole in it (tokenizers, trained models, XXH64, approximate search); tests hold
#: each against brute force, an exact round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w),
x AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words[i:i + 12]) AS first FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x WHERE first < doc_id),
kept AS (
  SELECT t.doc_id, count(g.i) AS n_removed, string_agg(t.word, ' ' ORDER BY t.i) FILTER (g.i IS NULL) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) t LEFT JOIN gone g USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op8_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 99)) AS i, unnest(list_transform(range(0, len(x) // 2 - 99), lambda i: md5_number(substring(x, 2 * i + 1, 200)))) AS m FROM h),
f AS (SELECT m, min((doc_id, i)) AS first FROM g GROUP BY m HAVING count(*) > 1),
k AS (SELECT doc_id, i FROM g JOIN f USING (m) WHERE (doc_id, i) > first),
r AS (SELECT doc_id, i, i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 100 AS fresh FROM k),
n AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY ALL),
l AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY 1)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN starts IS NULL THEN x ELSE list_aggregate(
         list_transform(range(1, len(starts) + 2), lambda j: substring(x, 2 * (CASE WHEN j = 1 THEN 0 ELSE ends[j - 1] END) + 1,
           2 * ((CASE WHEN j > len(starts) THEN len(x) // 2 ELSE starts[j] END) - (CASE WHEN j = 1 THEN 0 ELSE ends[j - 1] END)))), 'string_agg', '') END)) AS kept_sha256
FROM h LEFT JOIN l USING (doc_id)
""",
    "url_rules": """
WITH r AS (SELECT * FROM (VALUES ('com/'), ('example.com/en/'), ('www.example.com/en/'), ('net/es/'), ('net/fr/')) v(rule)),
s AS (SELECT rule, split_part(rule, '/', 1) AS rh, substring(rule, length(split_part(rule, '/', 1)) + 1) AS rp FROM r),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM h JOIN s ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT page_id, host, path, rule FROM h LEFT JOIN f USING (page_id)
""",
    "document_edits": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS following FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(left(t, n - n // 3) || left(following, n // 3)) AS edited_sha256 FROM d
""",
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
         ((strpos('0123456789abcdef', x[5 * i // 4 + 1]) - 1) * 16 + strpos('0123456789abcdef', x[least(5 * i // 4 + 2, 40)]) - 1)
         >> (3 - 5 * i % 4)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id < holder OR (page_id IS NULL AND holder IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < holder OR page_id IS NULL THEN holder END AS refers_to, true AS digest_holds
FROM t
""",
    "op13_filter_audit": """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS again,
         regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, CAST(len(words) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER)
         + 4 * CAST(100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) AS INTEGER)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(again, false) AS INTEGER) AS mask,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(range(0, 5)) AS f),
o AS (
  SELECT [a.f, b.f, x.f, y.f, z.f] AS fs FROM f a, f b, f x, f y, f z WHERE len(list_distinct([a.f, b.f, x.f, y.f, z.f])) = 5),
s AS (SELECT fs, unnest(range(1, 6)) AS step FROM o),
k AS (SELECT fs, step, fs[step] AS f, 1 << fs[step] AS bit, CAST(coalesce(list_sum(list_transform(fs[1:step - 1], lambda q: 1 << q)), 0) AS BIGINT) AS before FROM s),
r AS (
  SELECT part, fs, step, f,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, k GROUP BY ALL)
SELECT part, list_aggregate(list_transform(fs, lambda q: 'ABCDE'[q + 1]), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step, 'ABCDE'[f + 1] AS filter,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
""",
    "op12_quantiles": """
WITH v AS (
  SELECT 'value' AS stream, CAST(max(client_id) AS VARCHAR) AS grp, CAST(click_id AS VARCHAR) AS id, max(value) AS money FROM clicks GROUP BY click_id),
p AS (SELECT 'price' AS stream, brand AS grp, CAST(vendor_id AS VARCHAR) AS id, price AS money FROM sale_lines JOIN items USING (item_id)),
u AS (SELECT * FROM v UNION ALL SELECT * FROM p),
-- CRC-32 of a short text of digits: bytes folded in bit by bit
k AS (SELECT id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(id) + 1), lambda i: ascii(id[i])::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda z, _: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384::BIGINT) ELSE z >> 1 END)) AS c
      FROM (SELECT DISTINCT coalesce(id, '') AS id FROM u)),
r AS (SELECT stream, grp, xor(c, 4294967295::BIGINT) % 4 AS batch, CAST(floor(100 * money + 0.5) AS BIGINT) + 1000 * (xor(c, 4294967295::BIGINT) % 4) AS x
      FROM u JOIN k ON k.id = coalesce(u.id, '') WHERE grp IS NOT NULL AND money IS NOT NULL AND isfinite(money)),
b AS (SELECT stream, grp, batch, x FROM r UNION ALL SELECT stream, grp, -1, x FROM r),
e AS (
  SELECT stream, grp, batch, x, n, upto - t AS below, upto, place, max(place) OVER (PARTITION BY stream, grp, batch) AS d FROM (
    SELECT stream, grp, batch, x, count(*) AS t, sum(count(*)) OVER (PARTITION BY stream, grp, batch ORDER BY x) AS upto,
           sum(count(*)) OVER (PARTITION BY stream, grp, batch) AS n, row_number() OVER (PARTITION BY stream, grp, batch ORDER BY x) AS place FROM b GROUP BY 1, 2, 3, 4)),
s AS (
  SELECT *, coalesce(lead(below) OVER w, n) AS ceiling, upto - coalesce(lag(upto) OVER w, 0) AS rise FROM e
  WHERE batch >= 0 AND (upto * 200 // n > below * 200 // n OR place * 10 // d > (place - 1) * 10 // d OR below = 0)
  WINDOW w AS (PARTITION BY stream, grp, batch ORDER BY x)),
l AS (SELECT *, ceiling - coalesce(lag(ceiling) OVER (PARTITION BY stream, grp, batch ORDER BY x), below) AS lift, lag(x) OVER (PARTITION BY stream, grp, batch ORDER BY x) IS NULL AS first FROM s),
m AS (
  SELECT stream, grp, x, sum(rise) AS rise, sum(lift) AS lift, sum(CASE WHEN first THEN n END) AS rows, sum(below - ceiling) AS db FROM l GROUP BY 1, 2, 3),
w AS (
  SELECT stream, grp, -1 AS batch, sum(rows) OVER (PARTITION BY stream, grp) AS n, x, sum(lift) OVER (PARTITION BY stream, grp ORDER BY x) + db AS below_max,
         sum(rise) OVER (PARTITION BY stream, grp ORDER BY x) AS upto_min FROM m),
a AS (SELECT stream, grp, batch, n, x, below AS below_max, upto AS upto_min FROM s UNION ALL SELECT * FROM w),
t AS (SELECT *, unnest([1, 2, 3]) AS i FROM a WHERE n >= 20),
g AS (SELECT *, CAST(ceil(i * n / 4) AS BIGINT) AS target FROM t),
q AS (
  SELECT stream, grp, batch, i, n, target, count(*) AS points, min((greatest(0, below_max + 1 - target, target - upto_min), x))[2] AS answer
  FROM g GROUP BY ALL HAVING true)
SELECT q.stream, q.grp, CAST(q.batch AS INTEGER) AS batch, CAST(i AS INTEGER) AS i, CAST(q.n AS BIGINT) AS n, target, z.x AS exact_x, points, answer, CAST(e.below AS BIGINT) AS n_below, CAST(e.upto AS BIGINT) AS n_upto,
       CAST(greatest(0, e.below + 1 - target, target - e.upto) AS BIGINT) AS rank_error, 1000 * greatest(0, e.below + 1 - target, target - e.upto) <= 20 * q.n AS within
FROM q JOIN e ON (e.stream, e.grp, e.batch, e.x) = (q.stream, q.grp, q.batch, q.answer)
JOIN e z ON (z.stream, z.grp, z.batch) = (q.stream, q.grp, q.batch) AND z.below < target AND target <= z.upto
""",
}
