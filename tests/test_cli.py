"""Commands from an empty folder to answers."""

import json
from datetime import UTC, datetime

import pytest

from threadloom.cli import run
from threadloom.sources.lock import LockHeldError, WriterLock

NOW = datetime(2024, 1, 10, tzinfo=UTC)


@pytest.fixture(scope="module")
def command(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("cli")
    land = base / "land"
    rows = {
        "streams": [{"stream_id": 1, "name": "general"}, {"stream_id": 2, "name": "Random"}],
        "users": [{"user_id": 5, "full_name": "Ada", "email": "a@x", "is_bot": False}],
        "messages": [
            {"id": 1, "stream_id": 1, "sender_id": 5, "sender_full_name": "Ada", "content": "<p>deploy <b>now</b></p>", "timestamp": 1704800000, "topic": "✔ ship"},
            {"id": 2, "stream_id": 1, "sender_id": 6, "sender_full_name": "Bo", "content": "<p>later</p>", "timestamp": 1704810000, "topic": "ship"},
            {"id": 3, "stream_id": 2, "sender_id": 6, "sender_full_name": "Bo", "content": "<p>cat</p>", "timestamp": 1704810000, "topic": "cats"},
            {"id": 4, "sender_id": 6, "sender_full_name": "Bo", "content": "<p>psst</p>", "timestamp": 1704810000, "type": "private"},
        ],
    }
    for kind, own in rows.items():
        (land / kind).mkdir(parents=True)
        (land / kind / "1.json").write_text("\n".join(json.dumps(r) for r in own))
    (base / "c.toml").write_text('[embeddings]\nenabled = true\n[sync]\nexclude_streams = ["random"]\n')

    def go(*args):
        return run(spark, ["--config", str(base / "c.toml"), "--archive", str(base / "archive"), *args], NOW)

    assert "archive at" in go("init", "--url", "https://chat.test")
    assert go("sync", "--landing", str(land)) == "3 messages"
    assert go("sync", "--landing", str(land)) == "3 messages"
    return go


def test_answers(command):
    assert command("search", "deploy") == "#general > ✔ ship (2024-01-09) [resolved]\n  Ada: deploy now"
    assert command("search", "nothing") == "No results."
    assert command("sql", "SELECT full_name, avatar_url FROM users ORDER BY id") == "full_name\tavatar_url\nAda\t\nBo\t"
    assert command("messages", "--stream", "general", "--last", "1").endswith("#general > ship | Bo\n  later\n\n(1 messages)")
    assert command("messages", "--topic", "none") == "No messages found."
    assert command("topics", "--unresolved").splitlines()[1].split("\t")[:2] in (["general", "ship"], ["direct-messages", "direct messages"])
    assert "✔ ship" in command("topics", "--search", "deploy")
    assert command("stats").splitlines()[1].startswith("2\t3\t2\t3\t")
    assert command("attachments").count("\n") == 0
    assert command("doctor").count(": ok") == 9
    assert command("backfill-indexes") == "0 attachments"
    assert command("embeddings-backfill") == "embedded 3"
    assert command("embeddings-status").splitlines()[1] == "3\t3\t0"
    assert len(command("topics", "--semantic", "--search", "x").splitlines()) == 4


@pytest.mark.parametrize("args", [("messages",), ("messages", "--stream", "x", "--limit", "0"), ("messages", "--since", "soon"), ("attachments", "--status", "odd"), ("sql", "DELETE FROM users")])
def test_refusals(command, args):
    with pytest.raises(ValueError):
        command(*args)


def test_since_keeps_its_zone(spark, tmp_path):
    land = tmp_path / "land"
    for kind, rows in {
        "streams": [{"stream_id": 1, "name": "general"}], "users": [],
        "messages": [{"id": i, "stream_id": 1, "sender_id": 5, "content": "<p>x</p>", "timestamp": 1704800000 + 3600 * i, "topic": "t"} for i in range(1, 5)],
    }.items():
        (land / kind).mkdir(parents=True)
        (land / kind / "1.json").write_text("\n".join(map(json.dumps, rows)))
    go = lambda *args: run(spark, ["--config", str(tmp_path / "none"), "--archive", str(tmp_path / "a"), *args], NOW)
    # 1704800000 is 11:33:20 UTC; 15:00 two hours east is 13:00 UTC
    assert go("sync", "--landing", str(land), "--since", "2024-01-09T15:00:00+02:00") == "3 messages"
    assert go("doctor").endswith("server: not set up") and "model hash" in go("embeddings-status")
    with WriterLock(tmp_path / "a/writer.lock"), pytest.raises(LockHeldError):
        go("sync", "--landing", str(land))
    with pytest.raises(RuntimeError, match="switched off"):
        go("embeddings-backfill")
