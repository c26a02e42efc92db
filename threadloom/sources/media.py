"""Uploads fetched into a folder that all executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime
from posixpath import dirname, normpath
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.slices import status_is
from .rest import UPLOADS

UPDATES = "id long, media_path string, media_status string, media_content_type string, media_bytes long, media_error string"


Body = bytes | Iterable[bytes]


class UnsafePathError(ValueError):
    """An upload's URL leads out of the cache."""


def cache_path(url: str, fallback: str) -> str:
    """Where an upload goes below the cache: its path under the uploads folder, else the fallback name."""
    path = quote(urlsplit(url).path, safe="/%").removeprefix(UPLOADS)
    if not path or ".." in path:
        path = fallback
    path = normpath(unquote(path)) if path else "."
    if path in (".", "/") or path.startswith(("..", "/")):
        raise UnsafePathError(url)
    return path


def is_upload(url: Column) -> Column:
    """Whether a URL is in the server's uploads; others are never fetched, and stay as they are."""
    return F.coalesce(url.startswith(UPLOADS), F.lit(False))


def fetch_pending(
    uploads: DataFrame, folder: str, download: Callable[[str], Body | tuple[Body, str]], as_of: datetime, limit: int = 0, force: bool = False,
    concurrency: int = 4,
) -> DataFrame:
    """Updates for `update_media`: each pending upload (all with force) fetched, or what went wrong.

    `download` gives a body, or one with its content type, which then counts more than the upload's own.
    `folder` is a path that all executors mount, or a URI of a shared file system. Bodies are written as
    they come; files are named when whole, so that a lost task leaves none cut short. limit below 1: all.
    At most `concurrency` tasks download at a time. URLs that aren't uploads are left out, after the limit.
    """
    wanted = uploads if force else uploads.where(status_is(F.col("media_status"), "pending"))
    if limit > 0:
        wanted = wanted.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)

    def run(frames):
        for f in frames:
            yield pd.DataFrame([_one(r, folder, download) for r in f.itertuples()], columns=[x.split()[0] for x in UPDATES.split(", ")])

    own = wanted.where(is_upload(F.col("url"))).select("id", "url", F.coalesce("file_name", F.lit("")).alias("file_name"), "content_type")
    rows = own.repartition(max(1, concurrency)).mapInPandas(run, UPDATES)
    return rows.withColumn("media_fetched_at", C.instant(as_of))


def _one(row, folder: str, download) -> tuple:
    path = ""
    try:
        path = cache_path(row.url, row.file_name or f"attachment-{row.id}")
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        target = f"{base.rstrip('/')}/{path}"
        system.create_dir(dirname(target), recursive=True)
        fresh = f"{dirname(target)}/.{uuid.uuid4().hex}.part"
        got, size = download(row.url), 0
        body, kind = got if isinstance(got, tuple) else (got, "")
        try:
            with system.open_output_stream(fresh, compression=None) as out:
                for chunk in (body,) if isinstance(body, bytes) else body:
                    out.write(chunk)
                    size += len(chunk)
        except BaseException:
            system.delete_file(fresh)
            raise
        system.move(fresh, target)
        return row.id, path, "fetched", kind or row.content_type or "", size, ""
    except (OSError, ValueError, RuntimeError) as e:
        return row.id, path, "error", "", 0, str(e)


def counts(updates: DataFrame) -> DataFrame:
    """media_status and how many."""
    return updates.groupBy("media_status").agg(F.count("*").alias("n"))
