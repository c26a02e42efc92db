"""Column expressions: names, times, flags and scores."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: white space as Unicode has it
SPACE = r"[\s\p{Z}\x{85}]"
DAY = 86400.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    """The value itself, null if it is white space only."""
    return F.when(trimmed(c) != "", c)


def is_resolved(name: Column) -> Column:
    """Whether a topic's name says that it is resolved: a check mark or [resolved] in front."""
    t = trimmed(F.coalesce(name, F.lit("")))
    return t.startswith("✔") | F.lower(t).startswith("[resolved]")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def contains_like(c: Column, part: str) -> Column:
    """Substring match in which only A to Z match either case and no character is a wildcard."""
    return ascii_lower(c).contains(part.translate(str.maketrans(_UPPER, _LOWER)))


def rfc3339(c: Column) -> Column:
    """A UTC instant to the second; the session's zone is UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def instant(t: datetime) -> Column:
    return F.timestamp_micros(F.lit(int(t.astimezone(UTC).timestamp() * 1_000_000)))


def age_days(c: Column, as_of: datetime) -> Column:
    return (F.unix_micros(instant(as_of)) - F.unix_micros(c.cast("timestamp"))) / F.lit(1e6 * DAY)


def message_recency(c: Column, as_of: datetime, at_pole: float | None = None) -> Column:
    """1 now, one half after 30 days; above 1 for times to come, `at_pole` at the pole 30 days ahead."""
    under = F.lit(1.0) + age_days(c, as_of) / F.lit(30.0)
    return F.when(under == 0, F.lit(at_pole).cast("double")).otherwise(F.try_divide(F.lit(1.0), under))


def most_recency(newest: Column, as_of: datetime) -> Column:
    """The most that message_recency can be of times up to `newest`: anything, if that is near the pole or beyond, or null."""
    ahead = newest.isNull() | (age_days(newest, as_of) < F.lit(-29.99))
    return F.when(ahead, F.lit(float("inf"))).otherwise(message_recency(newest, as_of))


def topic_recency(c: Column, as_of: datetime) -> Column:
    """Half of message_recency, 0 without a time and at the pole."""
    return F.coalesce(F.try_divide(F.lit(0.5), F.lit(1.0) + age_days(c, as_of) / F.lit(30.0)), F.lit(0.0))


def activity(count: Column) -> Column:
    return F.when(count > 0, F.log2(F.lit(1.0) + count) * F.lit(0.1)).otherwise(F.lit(0.0))


def has_link(html: Column, text: Column) -> Column:
    return F.lower(html).contains("href=") | text.contains("http://") | text.contains("https://")


def has_image(html: Column) -> Column:
    return F.lower(html).contains("<img")


def has_attachment(html: Column, parsed: Column | None = None) -> Column:
    found = F.lower(html).contains('class="message_inline_ref"')
    return found if parsed is None else found | (F.size(parsed) > 0)


def time_bound(value: str, end: bool) -> datetime:
    """An instant from RFC 3339, or the first or last second of a day."""
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        day = datetime.strptime(value, "%Y-%m-%d").replace(tzinfo=UTC)
        return day.replace(hour=23, minute=59, second=59) if end else day
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", value):
        raise ValueError(f"neither RFC 3339 nor YYYY-MM-DD: {value!r}")
    return datetime.fromisoformat(value).astimezone(UTC)
