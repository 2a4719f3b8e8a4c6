"""Time rules: everything is naive UTC at second precision."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliq.checks import require_iso

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def parse_ts(text: Column) -> Column:
    """ISO text to timestamp; null when it is not a full ISO date.

    Spark's cast takes ``T`` or a space, ``Z`` and offsets. It misses the basic
    form (``20260518T142201``), rewritten here, and takes bare years, refused here.
    """
    value = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    basic = F.regexp_replace(
        value, r"^(\d{4})(\d{2})(\d{2})(?:[T ](\d{2})(\d{2})(\d{2}))?", "$1-$2-$3T$4:$5:$6"
    )
    value = F.when(value.rlike(r"^\d{8}([T ]\d{6}|$)"), F.regexp_replace(basic, "T::$", "")).otherwise(value)
    parsed = F.date_trunc("second", F.try_to_timestamp(value))
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), parsed)


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def effective_ts(raw: Column, parsed: Column, ingested: Column) -> Column:
    """Reported time when one was stored (even an unreadable one), else ingest time."""
    return F.when(raw.isNotNull(), parsed).otherwise(ingested)


def window_cutoff(now, days: int) -> datetime:
    return require_iso(now, "now") - timedelta(days=int(days))


def source_datetime(text: Column) -> Column:
    """``yyyy/MM/dd HH:mm`` for a tracker query; midnight for a bare date."""
    full = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})"
    day = r"^(\d{4})-(\d{2})-(\d{2})"

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    return F.when(
        text.rlike(full),
        F.concat(part(full, 1), F.lit("/"), part(full, 2), F.lit("/"), part(full, 3), F.lit(" "),
                 part(full, 4), F.lit(":"), part(full, 5)),
    ).when(
        text.rlike(day),
        F.concat(part(day, 1), F.lit("/"), part(day, 2), F.lit("/"), part(day, 3), F.lit(" 00:00")),
    )
