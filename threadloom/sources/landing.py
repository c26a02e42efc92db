"""Pages of a chat server as JSON lines in a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType


def _struct(**kinds) -> StructType:
    return StructType([StructField(n, t) for n, t in kinds.items()])


L, S, B = LongType(), StringType(), BooleanType()
STREAM = _struct(stream_id=L, name=S, description=S, invite_only=B, is_web_public=B)
USER = _struct(user_id=L, email=S, full_name=S, is_bot=B, avatar_url=S)
MESSAGE = _struct(
    id=L, stream_id=L, sender_id=L, sender_full_name=S, content=S, timestamp=L, edit_timestamp=L, type=S, subject=S,
    topic=S, is_me_message=B, reactions=S,
)
PAGE = _struct(messages=ArrayType(MESSAGE), found_newest=B, found_oldest=B, anchor=L)
KINDS = {"streams": STREAM, "users": USER, "messages": MESSAGE, "pages": PAGE}


def read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """One kind of record; a folder of pages is read as its messages by `page_messages`."""
    return spark.read.schema(KINDS[kind]).json(f"{folder}/{kind}")


def stream(spark: SparkSession, folder: str, kind: str = "messages", files: int = 100) -> DataFrame:
    """The same as a stream of new files."""
    return spark.readStream.schema(KINDS[kind]).option("maxFilesPerTrigger", files).json(f"{folder}/{kind}")


def page_messages(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("messages").alias("m")).select("m.*")


def as_streams(rows: DataFrame, org_id: int = 1) -> DataFrame:
    return rows.select(
        F.col("stream_id").alias("id"), F.lit(org_id).cast("long").alias("org_id"), "name", "description",
        F.coalesce("is_web_public", F.lit(False)).alias("is_web_public"), F.coalesce("invite_only", F.lit(False)).alias("invite_only"),
    )


def as_users(rows: DataFrame, org_id: int = 1) -> DataFrame:
    return rows.select(
        F.col("user_id").alias("id"), F.lit(org_id).cast("long").alias("org_id"), "email", "full_name",
        F.coalesce("is_bot", F.lit(False)).alias("is_bot"), "avatar_url",
    )
