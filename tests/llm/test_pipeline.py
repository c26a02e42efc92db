"""The pipeline's stages on their own inputs."""

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from threadloom.llm import ann, queries, simhash
from threadloom.llm.common import materialise

from . import brute


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]
    stages = dict(corpus_pipeline.STAGES)
    clean = materialise(stages["toxicity"](spark, docs, folder))
    assert clean.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert sum(1 for d, t in labels.items() if t == 0 and d not in kept) <= 1
    one = materialise(stages["SimHash near-dedup"](spark, clean, folder))
    assert {r["doc_id"] for r in one.collect()} == {c for _, c in brute.simhash_classes(kept).values()}
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    short = materialise(stages["suffix-array dedup"](spark, one, folder))
    removed = brute.bytes_removed(texts)
    for r in short.collect():
        n, gone, _, sha = removed[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and len(r["text"].encode()) <= n - gone
        if len(r["text"].encode()) == n - gone:  # no character was cut
            assert brute.digest(r["text"].encode()) == sha
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in short.collect())
    pieces = stages["best-fit packing"](spark, short, folder)
    assert pieces.agg({"length": "sum"}).first()[0] == total == corpus_pipeline.run(spark, folder).agg({"length": "sum"}).first()[0]


def test_odd_documents_pass_all_stages(spark, folder):
    docs = brute.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES:
            now = materialise(stage(spark, now, folder))
        assert (now.count() > 0) == (rows.count() > 0)


def test_stages_leave_clashing_columns_alone(spark, folder):
    """Columns that are called like the stages' own."""
    names = ["_null", "none", "c0", "carried", "_carried", "block", "rank", "at", "family", "fold", "fingerprint", "_row_1", "n_chars_1", "root", "least", "_"]
    docs = brute.frame(spark).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = materialise(stage(spark, now, folder))
        assert now.columns == docs.columns and now.select(*names).distinct().collect() == docs.select(*names).distinct().collect()
    assert materialise(corpus_pipeline.STAGES[-1][1](spark, now, folder)).count() == now.count() > 0
    ids = lambda df: sorted((r["doc_id"] or -1) for r in df.collect())
    assert ids(now) == ids(simhash.keep_one_of_each(brute.frame(spark)))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    clashing = vectors.select("*", *(F.lit(1).alias(c) for c in ("cell", "leaf", "v", "n", "d", "leaves", "query_id", "q", "score")))
    assert sorted(map(tuple, ann.nearest(clashing).collect())) == sorted(map(tuple, ann.nearest(vectors).collect())) != []


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql_says_the_same(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "clicks", "sale_lines", "items"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    out = queries.QUERIES[name](spark, folder)
    wanted = c.sql(queries.ORACLE_SQL[name])
    assert sorted(out.columns) == sorted(wanted.columns)
    assert sorted(map(tuple, out.collect())) == sorted(wanted.select(*out.columns).fetchall())
