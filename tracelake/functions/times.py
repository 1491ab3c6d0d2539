"""Timestamps, holds, durations and day buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOLD_FOREVER = "forever"
# Seconds per duration unit.
DURATION_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss"


def instant(text: Column) -> Column:
    """The moment an ISO text names, null on junk; offsets are honoured."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def as_iso(ts: Column) -> Column:
    """ISO text in UTC at second resolution."""
    return F.concat(F.date_format(ts, ISO_PATTERN), F.lit("+00:00"))


def hold_active(hold_until: Column, now: Column) -> Column:
    """Whether a hold is in force; a garbled one is no hold."""
    return F.coalesce((hold_until == HOLD_FOREVER) | (instant(hold_until) > now), F.lit(False))


def hold_garbled(hold_until: Column) -> Column:
    return F.coalesce((hold_until != "") & (hold_until != HOLD_FOREVER)
                      & instant(hold_until).isNull(), F.lit(False))


def duration_seconds(text: Column) -> Column:
    """``2h``, ``1.5d``, ``45s`` or bare seconds; null when it is none of them."""
    raw = F.lower(F.trim(text))
    number = F.regexp_extract(raw, r"^(.*?)([smhd]?)$", 1).try_cast("double")
    unit = F.regexp_extract(raw, r"^(.*?)([smhd]?)$", 2)
    scale = F.lit(1.0)
    for name, seconds in DURATION_UNITS.items():
        scale = F.when(unit == name, float(seconds)).otherwise(scale)
    return F.when(raw.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?[smhd]?$"), number * scale)


def day_bucket(created: Column, today: Column) -> Column:
    """Today / Yesterday / weekday name / Month Year / Undated."""
    day = F.to_date(instant(created))
    age = F.datediff(today, day)
    return (
        F.when(day.isNull(), "Undated")
        .when(age == 0, "Today")
        .when(age == 1, "Yesterday")
        .when(age < 7, F.date_format(day, "EEEE"))
        .otherwise(F.date_format(day, "MMMM yyyy"))
    )
