"""Tables of an archive. Times are UTC instants; keys are named in KEYS."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

_TYPES = {
    "long": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType(),
    "timestamp": TimestampType(), "array<float>": ArrayType(FloatType()), "array<int>": ArrayType(IntegerType()),
}
_TYPES["entries"] = ArrayType(
    StructType([StructField(n, _TYPES[t]) for n, t in (("rowid", "long"), ("n", "int"), ("col", "int"), ("times", "int"), ("positions", "array<int>"))])
)

_DDL = {
    "organizations": "id long, url string, name string, synced_at timestamp",
    "streams": "id long, org_id long, name string, description string, is_web_public boolean, invite_only boolean, "
    "synced_at timestamp",
    "topics": "id long, org_id long, stream_id long, name string, resolved boolean, message_count long, "
    "first_message_id long, last_message_id long, first_message_at timestamp, last_message_at timestamp, "
    "synced_at timestamp",
    "users": "id long, org_id long, email string, full_name string, is_bot boolean, avatar_url string, synced_at timestamp",
    "messages": "id long, org_id long, stream_id long, topic_id long, sender_id long, content string, "
    "content_text string, timestamp timestamp, edit_timestamp timestamp, has_attachment boolean, has_image boolean, "
    "has_link boolean, reactions string, is_me_message boolean",
    "message_mentions": "message_id long, org_id long, stream_id long, topic_id long, mentioned_user_id long, "
    "mentioned_name string, mention_kind string, timestamp timestamp",
    "message_attachments": "id long, message_id long, org_id long, stream_id long, topic_id long, url string, "
    "file_name string, title string, content_type string, text_content string, indexed boolean, timestamp timestamp, "
    "media_path string, media_status string, media_fetched_at timestamp, media_content_type string, "
    "media_bytes long, media_error string",
    "topic_embeddings": "topic_id long, model string, provider string, dimension int, vector array<float>, "
    "indexed_at timestamp",
    "sync_state": "org_id long, stream_id long, last_message_id long, synced_at timestamp",
}

_ROLLUPS = "topic_id long, message_count long, first_message_id long, last_message_id long, first_message_at timestamp, last_message_at timestamp"
_BLOCKS = (
    "term string, span long, removed boolean, n_rows int, words long, top_times int, least_n int, newest timestamp, entries entries,"
    " seg string, slice int"
)
_SLICES = "slice int, first_term string, last_term string, seg string"
_TOTALS = "rows long, words long, size long, removals long, seg string"
_FACTS = "rowid long, at timestamp, stream_id long, topic_id long, sender_id long, topic_name string, sender_name string, seg string"


def _schemas(ddl: dict[str, str]) -> dict[str, StructType]:
    return {name: StructType([StructField(*x.split()[:1], _TYPES[x.split()[1]]) for x in d.split(", ")]) for name, d in ddl.items()}


SCHEMAS = _schemas(_DDL)
#: derived, kept beside the other tables in archives on disk: each part's share of the topics' rollups
DERIVED = _schemas({"part_rollups": _ROLLUPS})
#: rows (by their key in a part) for which layers up to before this one no longer speak
GONE = _schemas({name: "part long, layer long, id long" for name in ("message_gone", "rollup_gone")})
#: full-text segments: postings in blocks, the terms of their files, totals, and what is known of each row
SEGMENTS = _schemas(
    {f"{kind}_{name}": ddl for kind in ("message", "topic") for name, ddl in (("blocks", _BLOCKS), ("slices", _SLICES), ("totals", _TOTALS))}
    | {"message_facts": _FACTS}
)

KEYS = {
    "organizations": ["id"],
    "streams": ["id"],
    "topics": ["stream_id", "name"],
    "users": ["id"],
    "messages": ["id"],
    "message_mentions": ["message_id", "mentioned_user_id", "mentioned_name", "mention_kind"],
    "message_attachments": ["message_id", "url"],
    "topic_embeddings": ["topic_id", "model"],
    "sync_state": ["org_id", "stream_id"],
}
