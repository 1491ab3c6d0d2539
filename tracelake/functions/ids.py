"""Session and asset identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import strip

# Fixed values of the id notation.
RUN_ID = r"^([SI])-(\d{2})-(\d{4,})$"
ASSET_ID = r"^AF-(\d{2})-(\d{4,})$"
ID_WIDTH = 4
ASSET_BUCKET = 100
SUFFIX_WIDTH = 3
PREFIX_BY_KIND = {"standard": "S-", "intake": "I-", "fragment": "S-"}


def pad_number(number: Column, width: int = ID_WIDTH) -> Column:
    """Zero-pad to at least ``width``; longer numbers keep every digit."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def format_id(prefix: Column | str, year2: Column, number: Column) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lpad(year2.cast("string"), 2, "0"), F.lit("-"), pad_number(number))


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def id_prefix(run_id: Column) -> Column:
    return F.concat(_group(run_id, RUN_ID, 1), F.lit("-"))


def id_year(run_id: Column) -> Column:
    return F.lit(2000) + _group(run_id, RUN_ID, 2).cast("int")


def id_number(run_id: Column) -> Column:
    return _group(run_id, RUN_ID, 3).cast("bigint")


def is_provisional(run_id: Column) -> Column:
    return F.coalesce(run_id.rlike(r"^I-\d{2}-\d{4,}$"), F.lit(False))


def expand_run_id(text: Column, this_year: int, prefix: str = "S-") -> Column:
    """Canonical id for what a person typed; null when it is not an id."""
    raw = F.upper(strip(text))
    dated = r"^([SI]-)?(\d{2})-(\d+)$"
    own = F.regexp_extract(raw, dated, 1)
    return (
        F.when(raw.rlike(RUN_ID), raw)
        .when(raw.rlike(dated), format_id(
            F.when(own == "", F.lit(prefix)).otherwise(own),
            F.regexp_extract(raw, dated, 2),
            F.regexp_extract(raw, dated, 3).try_cast("bigint")))
        .when(raw.rlike(r"^\d+$"), format_id(
            prefix, F.lit(f"{this_year % 100:02d}"),
            raw.try_cast("bigint")))
    )


def asset_year(asset_id: Column) -> Column:
    return _group(strip(asset_id), ASSET_ID, 1).cast("int")


def asset_number(asset_id: Column) -> Column:
    return _group(strip(asset_id), ASSET_ID, 2).cast("bigint")


def is_asset_id(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(ASSET_ID), F.lit(False))


def asset_bucket(asset_id: Column) -> Column:
    """Which hundred the asset belongs to."""
    return F.floor(asset_number(asset_id) / ASSET_BUCKET).cast("bigint")


def format_asset_id(year2: Column, number: Column) -> Column:
    return format_id("AF-", year2, number)


def duplicate_name(filename: Column, n: Column) -> Column:
    """``raw.csv`` -> ``raw-001.csv``: the number goes before the last suffix."""
    stem, suffix = split_suffix(filename)
    return F.concat(stem, F.lit("-"), pad_number(n, SUFFIX_WIDTH), suffix)


def split_suffix(filename: Column) -> tuple[Column, Column]:
    """(stem, last suffix); a leading or trailing dot starts no suffix."""
    pattern = r"^(.+)(\.[^.]+)$"
    has = filename.rlike(pattern)
    return (
        F.when(has, F.regexp_extract(filename, pattern, 1)).otherwise(filename),
        F.when(has, F.regexp_extract(filename, pattern, 2)).otherwise(F.lit("")),
    )
