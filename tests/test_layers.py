"""Edits and moves laid on top of a part: what is written, what readers see, when layers become one."""

import json
import random
import shutil
from collections import Counter
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.archive import PART_IDS, Archive
from threadloom.operators import slices as S
from threadloom.operators import upsert as U
from threadloom.operators.segments import MERGE_AT, due_for_merge
from threadloom.sources import landing
from threadloom.streaming import ingest as I

NOW = datetime(2026, 5, 1, 12, tzinfo=UTC)
UPLOAD = '<a href="/user_uploads/1/{}.txt">{}.txt</a>'
MENTION = '<span class="user-mention" data-user-id="{}">@U{}</span>'


def message(i, html, topic, at=1_700_000_000, **more):
    return {"id": i, "type": "stream", "stream_id": 10, "topic": topic, "sender_id": 20, "sender_full_name": "S", "content": html, "timestamp": at + i % 1000} | more


def batch(spark, rows):
    return spark.read.schema(landing.MESSAGE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def fresh(spark, root):
    return Archive.open(spark, str(root)).commit({"streams": spark.createDataFrame([(10, "general")], "id long, name string")})


def written(a, b, tables):
    """Bytes of the Parquet files that b names and a doesn't."""
    new = {f for t in tables for f in set(b.pointer.get(t, {}).values()) - set(a.pointer.get(t, {}).values())}
    return sum(f.stat().st_size for x in new for f in Path(b.root, x).rglob("*.parquet"))


def agrees(archive, told):
    """Messages, children, topics and listings are those of the last version of each message."""
    assert {r["id"]: r["content"] for r in archive.messages.collect()} == {i: m["content"] for i, m in told.items()}
    uploads = Counter((r["message_id"], r["url"]) for r in archive.message_attachments.collect())
    assert uploads == Counter((i, m["content"].split('"')[1]) for i, m in told.items() if "user_uploads" in m["content"])
    assert Counter(r["message_id"] for r in archive.message_mentions.collect()) == Counter(i for i, m in told.items() if "user-mention" in m["content"])
    want = Counter(m["topic"] for m in told.values())
    topics = {r["name"]: r for r in archive.topics.collect()}
    assert {n: r["message_count"] for n, r in topics.items()} == {n: want[n] for n in topics}
    for name, n in want.items():
        ids = sorted(i for i, m in told.items() if m["topic"] == name)
        assert (topics[name]["first_message_id"], topics[name]["last_message_id"]) == (ids[0], ids[-1])
    name = max(want)
    got = S.messages(archive, S.MessageFilter(topic=name, limit=10_000), NOW)
    assert {r["message_id"] for r in got.collect()} == {i for i, m in told.items() if m["topic"] == name}


def test_an_edit_writes_little_of_its_part(spark, tmp_path):
    rnd = random.Random(5)
    html = lambda: "<p>" + " ".join(f"{rnd.getrandbits(40):x}" for _ in range(60)) + "</p>"
    rows = [message(i, html(), f"t{i % 7}") for i in range(1, 6001)]
    a = I.ingest(fresh(spark, tmp_path), batch(spark, rows), NOW)
    b = I.ingest(a, batch(spark, [message(77, "<p>edited</p>", "t1", edit_timestamp=1_700_009_000)]), NOW)
    tables = ("messages", "message_mentions", "message_attachments", "part_rollups", "message_gone", "rollup_gone")
    assert 0 < written(a, b, tables) < 0.01 * written(fresh(spark, tmp_path / "none"), a, ("messages",))
    assert b.messages.count() == 6000 and b.messages.where("id = 77").first()["content"] == "<p>edited</p>"
    # filters still reach the files of a part that has removals
    plan = b.messages.where("topic_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(topic_id,3)" in plan
    # new messages alone read none of the part's rollups anew and need no removals of messages
    c = I.ingest(b, batch(spark, [message(6001, "<p>more</p>", "t1")]), NOW)
    assert len(c.pointer["message_gone"]) == len(b.pointer["message_gone"]) and c.messages.count() == 6001


def test_edits_moves_and_merges_agree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "due_for_merge", lambda sizes: 2 if len(sizes) > 3 else 0)
    rnd = random.Random(3)
    archive, told = fresh(spark, tmp_path / "a"), {}
    copy = lambda name: Archive.open(spark, str(shutil.copytree(tmp_path / "a", tmp_path / name)))
    seen = 0
    for k in range(5):
        ids = [rnd.choice((1, PART_IDS)) * rnd.randint(1, 30) if rnd.random() < 0.9 else 7 for _ in range(9)]
        rows = []
        for i in dict.fromkeys(ids):
            html = rnd.choice(["<p>{}</p>".format, lambda x: UPLOAD.format(x, x), lambda x: MENTION.format(x + 1, x)])(k)
            rows.append(message(i, html, f"t{rnd.randint(0, 3)}", edit_timestamp=1_700_000_000 + 2000 * (k + 1)))
        archive = I.ingest(archive, batch(spark, rows), NOW)
        told |= {r["id"]: r for r in rows}
        seen = max(seen, len([x for x in archive.pointer["messages"] if x.split("+")[0] == "0"]))
    assert seen == 3 and "message_gone" in archive.pointer
    agrees(archive, told)
    # all layers made one: removals go with them
    one = copy("one").compact(archive.parts("messages"), len)
    assert not one.pointer["message_gone"] and not one.pointer["rollup_gone"]
    assert len(one.pointer["messages"]) == len(one.parts("messages"))
    agrees(one, told)
    # some of the newest made one: removals stay for the layers below
    two = copy("two").compact(archive.parts("messages"), lambda sizes: min(2, len(sizes) - 1))
    agrees(two, told)
    # a part written whole is as new as its newest layer, and later edits still replace its rows
    done = archive.message_attachments.select("id", *(F.lit(None).cast("string").alias(c) for c in U.MEDIA)).withColumn("media_status", F.lit("fetched"))
    whole = copy("whole")
    whole = whole.commit({"message_attachments": U.update_media(whole.message_attachments, done)})
    agrees(whole, told)
    last = message(7, "<p>bare</p>", "t0", edit_timestamp=1_700_900_000)
    told[7] = last
    whole = I.ingest(whole, batch(spark, [last]), NOW)
    agrees(whole, told)
    agrees(I.rebuild(whole), told)


@pytest.mark.parametrize("n", [1, MERGE_AT - 1, MERGE_AT])
def test_when_layers_are_merged(n):
    assert due_for_merge([10**9] + [5000] * n) == (n if n == MERGE_AT else 0)
