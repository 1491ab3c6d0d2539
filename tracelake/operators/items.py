"""Items: data files paired with their sidecars, and views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as txt
from tracelake.functions.times import day_bucket, hold_active, instant
from tracelake.operators.skew import attach, previous_in_groups

SESSION = ["archive", "run_id"]
ITEM = [*SESSION, "name"]

#: Worst first, as a list sorted by status shows them.
STATUS_RANK = ("orphan", "stray", "drifted", "paired")


# -- J1, J15: pairing ------------------------------------------------------

def pair_items(files: DataFrame, sidecars: DataFrame, verify: bool = False) -> DataFrame:
    """One row per logical artifact: paired, orphan, stray or drifted.

    Drift is looked for only when hashes are to be verified, and a sidecar
    without a recorded hash is not checkable rather than wrong.
    """
    left = files.select(*ITEM, "size", "mtime", F.col("sha256").alias("actual_sha256"),
                        F.lit(True).alias("has_file"))
    right = sidecars.where(~F.col("trashed")).select(
        *SESSION, F.col("filename").alias("name"), "readable", "created", "source", "origin",
        "repo", "commit", "dirty", "entry_point", "code", "sha256", "original_name",
        "duplicate_index", F.lit(True).alias("has_sidecar"))
    both = left.join(right, ITEM, "full_outer")
    drifted = F.col("sha256") != F.col("actual_sha256") if verify else F.lit(False)
    return both.select(
        *ITEM,
        F.when(F.col("has_sidecar").isNull(), "orphan").when(F.col("has_file").isNull(), "stray")
        .when(drifted, "drifted").otherwise("paired").alias("status"),
        "size",
        F.coalesce("created", "mtime").alias("timestamp"),
        F.when(~F.col("readable"), "?")
        .when(F.col("has_sidecar"), F.coalesce("source", F.lit("script"))).alias("source"),
        F.coalesce(F.col("source").isNotNull(), F.lit(False)).alias("source_recorded"),
        "origin", "repo", "commit", "dirty", "entry_point", "code", "sha256",
        F.coalesce("original_name", "name").alias("display_name"),
        (F.coalesce("duplicate_index", F.lit(0)) + 1).alias("position"),
    )


def orphan_files(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Data files nobody wrote a sidecar for."""
    known = sidecars.where(~F.col("trashed")).select(*SESSION, F.col("filename").alias("name"))
    visible = files.where(~F.col("name").startswith(".")
                          & ~F.col("name").isin("session.yaml", "annotations.yaml")
                          & ~F.col("name").endswith(txt.SIDECAR_SUFFIX))
    return visible.join(known, ITEM, "left_anti")


# -- J4: annotations -------------------------------------------------------

def with_annotations(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """Items with the notes on themselves and on their session."""
    own = annotations.where("filename is not null").select(
        *SESSION, F.col("filename").alias("name"), F.col("tags").alias("user_tags"),
        F.col("comment").alias("user_comment"))
    session = annotations.where("filename is null").select(
        *SESSION, F.col("tags").alias("session_user_tags"),
        F.col("comment").alias("session_comment"))
    none = F.array().cast("array<string>")
    return (
        items.join(own, ITEM, "left").join(session, SESSION, "left")
        .withColumn("user_tags", F.coalesce("user_tags", none))
        .withColumn("session_user_tags", F.coalesce("session_user_tags", none))
        .withColumn("user_comment", F.coalesce("user_comment", F.lit("")))
        .withColumn("session_comment", F.coalesce("session_comment", F.lit("")))
    )


# -- W1: duplicates ---------------------------------------------------------

def with_duplicate_groups(items: DataFrame) -> DataFrame:
    """Add ``total``, the number of writes under one name in a session.

    Totals are counted before the shuffle and joined back with the largest
    groups split, since copies of one name may be most of a session.
    """
    keys = [*SESSION, "display_name"]
    totals = items.groupBy(*keys).agg(F.count("*").alias("total"))
    return attach(items, totals, keys, "total", ["name"], "inner")


# -- A2, A7: counts per session ----------------------------------------------

def session_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(*SESSION).agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("status") != "paired").alias("n_problems"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def list_sessions(sessions: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Every readable session with item counts and hold state (A2)."""
    zero = F.lit(0).cast("bigint")
    return (
        sessions.join(session_counts(items), SESSION, "left")
        .withColumns({n: F.coalesce(n, zero) for n in ("n_items", "n_problems", "bytes")})
        .withColumn("held", hold_active(F.col("hold_until"), now))
    )


# -- A3, W8: activity --------------------------------------------------------

def activity(listed: DataFrame) -> DataFrame:
    """Sessions, items and problems per archive and calendar day."""
    day = F.to_date(instant(F.col("created")))
    return (
        listed.withColumn("day", day).where("day is not null").groupBy("archive", "day")
        .agg(F.count("*").alias("sessions"), F.sum("n_items").alias("items"),
             F.sum("n_problems").alias("problems"))
    )


def activity_summary(days: DataFrame) -> DataFrame:
    return days.groupBy("archive").agg(
        F.count("*").alias("active_days"), F.min("day").alias("first"), F.max("day").alias("last"),
        F.max("sessions").alias("busiest"))


def calendar_strip(days: DataFrame, archives: DataFrame, today: str, weeks: int) -> DataFrame:
    """A dense strip of whole weeks ending with the week of ``today``."""
    date = F.lit(today).cast("date")
    end = F.date_add(date, 7 - F.dayofweek(date))          # weeks end on Saturday
    spine = archives.select("archive", F.explode(F.sequence(
        F.date_sub(end, weeks * 7 - 1), end)).alias("day"))
    busiest = days.groupBy("archive").agg(F.max("sessions").alias("busiest"))
    return (
        spine.join(days, ["archive", "day"], "left").join(busiest, "archive", "left")
        .select("archive", "day", F.coalesce("sessions", F.lit(0)).alias("sessions"),
                F.coalesce("items", F.lit(0)).alias("items"),
                txt.activity_shade(F.col("sessions"), F.coalesce("busiest", F.lit(1))).alias("shade"),
                (F.col("day") > date).alias("future"))
    )


# -- A1, A9, F14: tags --------------------------------------------------------

def tag_counts(sessions: DataFrame) -> DataFrame:
    """Sessions per tag, most used first."""
    return (sessions.select("archive", F.explode("tags").alias("tag"))
            .groupBy("archive", "tag").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "tag", "archive"))


def tag_spread(selection: DataFrame) -> DataFrame:
    """Whether each tag of a selection is on every item or only on some."""
    per_tag = (selection.select("archive", F.explode(F.array_distinct("tags")).alias("tag"))
               .groupBy("archive", "tag").agg(F.count("*").alias("n")))
    total = selection.groupBy("archive").agg(F.count("*").alias("total"))
    return per_tag.join(total, "archive").withColumn("on_all", F.col("n") == F.col("total"))


# -- F1-F7, F13, F16: filters --------------------------------------------------

def filter_sessions(sessions: DataFrame, status: str | None = None, today: str | None = None,
                    tag: str | None = None) -> DataFrame:
    """Sessions by status, day of creation and tag, oldest first (F1)."""
    out = sessions
    if status:
        out = out.where(F.col("status") == status)
    if today:
        out = out.where(F.col("created").startswith(today))
    if tag:
        out = out.where(F.array_contains("tags", tag))
    return out.orderBy("created", "archive", "run_id")


def stale_open(sessions: DataFrame, now: Column, hours: float) -> DataFrame:
    """Sessions still open longer than they should be (F2)."""
    age = F.unix_timestamp(now) - F.unix_timestamp(instant(F.col("created")))
    return sessions.where((F.col("status") == "open") & (age > hours * 3600))


def appendable(today: str, now: Column) -> Column:
    """Open, created today or held."""
    return ((F.col("status") == "open") | F.col("created").startswith(today)
            | hold_active(F.col("hold_until"), now))


def within_days(today: str, days: int) -> Column:
    return F.substring("created", 1, 10) >= F.date_sub(F.lit(today).cast("date"), days).cast("string")


def session_mentions(word: str) -> Column:
    """The word in the id, the description or a tag, whatever its case."""
    needle = word.lower()
    return (F.lower("run_id").contains(needle)
            | F.lower(F.coalesce("description", F.lit(""))).contains(needle)
            | F.exists("tags", lambda t: F.lower(t).contains(needle)))


def session_gates(query: str = "", fields: tuple[str, ...] = ("description", "run_id", "tags"),
                  statuses: tuple[str, ...] = ("open", "closed", "crashed"), clean: bool = True,
                  dirty: bool = True, day_from: str | None = None,
                  day_to: str | None = None) -> Column:
    """Day range, status, problems and every search word at once."""
    known = ("open", "closed", "crashed")
    cond = F.col("status").isin(*statuses) if statuses else F.lit(False)
    if statuses:
        cond = cond | ~F.col("status").isin(*known)        # unknown follows "any shown"
    cond = cond & F.when(F.col("n_problems") > 0, F.lit(dirty)).otherwise(F.lit(clean))
    if day_from:
        day = F.to_date(instant(F.col("created"))).cast("string")
        cond = cond & day.between(day_from, day_to or day_from)
    parts = [F.array_join(f, " ") if f in ("tags", "user_tags") else F.coalesce(F.col(f), F.lit(""))
             for f in fields]
    blob = F.lower(F.concat_ws(" ", *parts))
    for word in query.lower().split():
        cond = cond & blob.contains(word)
    return cond


def in_date_range(timestamp: Column, date_from: str | None, date_to: str | None) -> Column:
    """Inclusive day bounds on an ISO text; an undated row meets no bound."""
    day = F.substring(timestamp, 1, 10)
    cond = F.lit(True)
    if date_from or date_to:
        cond = F.coalesce(day, F.lit("")) != ""
    if date_from:
        cond = cond & (day >= date_from)
    if date_to:
        cond = cond & (day <= date_to)
    return cond


def any_column_contains(df: DataFrame, needle: str) -> DataFrame:
    """Rows holding the text in any column (F11); letter case does not count."""
    cond = F.lit(False)
    for name, kind in df.dtypes:
        if not kind.startswith(("array", "map", "struct")):
            cond = cond | F.coalesce(F.lower(F.col(name).cast("string")).contains(needle.lower()),
                                     F.lit(False))
    return df.where(cond)


# -- O1-O6: order and paging ----------------------------------------------------

def item_order() -> list[Column]:
    """Newest first, undated last, duplicates in write order."""
    return [F.desc_nulls_last(instant(F.col("timestamp"))), F.asc("display_name"), F.asc("position")]


def item_order_by(by: str, descending: bool) -> list[Column]:
    """Date, title or status in either direction; undated rows always last."""
    if by == "date":
        at = instant(F.col("timestamp"))
        head = F.desc_nulls_last(at) if descending else F.asc_nulls_last(at)
    else:
        rank = F.lit(len(STATUS_RANK))
        for i, status in enumerate(STATUS_RANK):
            rank = F.when(F.col("status") == status, i).otherwise(rank)
        key = F.col("name") if by == "title" else rank
        head = F.desc(key) if descending else F.asc(key)
    return [head, F.asc("display_name"), F.asc("position")]


def session_order(newest_first: bool = True) -> list[Column]:
    """By the text of ``created``, as it was written (O3)."""
    return [F.desc("created") if newest_first else F.asc("created")]


def asset_order(mode: str = "recent") -> list[Column]:
    return {
        "name": [F.asc(F.lower(F.coalesce("name", F.lit(""))))],
        "size": [F.desc(F.coalesce("size", F.lit(0)))],
        "created": [F.desc(F.coalesce("created", F.lit("")))],
    }.get(mode, [F.desc(F.coalesce("scanned_at", "created", F.lit("")))])


def limited(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows, each saying whether more existed.

    One row too many is taken; ranking runs over at most ``limit + 1`` rows.
    """
    head = df.orderBy(*order).limit(limit + 1)
    ranked = head.withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    flagged = ranked.withColumn("truncated", F.max("_r").over(
        Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > limit)
    return flagged.where(F.col("_r") <= limit).drop("_r")


def page(df: DataFrame, order: list[Column], limit: int = 200, offset: int = 0) -> DataFrame:
    """One page of a table view; the size stays between 1 and 1000."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(1000, limit)))


# -- W10, P14: headers -----------------------------------------------------------

def bucket_headers(sessions: DataFrame, today: str) -> DataFrame:
    """The session before which a day header stands in the newest-first list."""
    named = sessions.select(
        "archive", "run_id", "created",
        day_bucket(F.col("created"), F.lit(today).cast("date")).alias("bucket"))
    walked = previous_in_groups(named, ["archive"], F.substring("created", 1, 10),
                                ["created", "run_id"], "bucket", "before", descending=True)
    return walked.where(~F.col("before").eqNullSafe(F.col("bucket"))).drop("before")
