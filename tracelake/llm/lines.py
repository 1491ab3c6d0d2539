"""Line dedup by site-relative frequency.

For each host, the documents holding a line are divided by all documents of the host; lines above the boilerplate ratio
are dropped from every document of that host. Lines are compared without blanks at their ends, by a 64-bit hash; blank
lines are neither counted nor dropped. A line counts once for a document, however often it stands there. Where a column
tells which rows are copies of one another, the copies count as one document, in both numbers, so that what a group of
copies repeats is not boilerplate.

Null texts stay null and have no lines; a null host is a host of its own; repeated rows count as documents of their
own unless such a column says otherwise. An empty table gives an empty result. Other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.session import stage

BLANKS = " \t\r"


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_keys(text: Column) -> Column:
    """Distinct keys of a text's lines that are not blank."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), bare), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def boilerplate(docs: DataFrame, max_ratio: float, min_pages: int, text_col: str, host_col: str,
                copy_col: str | None = None) -> DataFrame:
    """For each host the keys of its boilerplate lines, at most (distinct lines of a page / ``max_ratio``) of them."""
    host = F.col(host_col).cast("string").alias("host")
    pages, held = docs.select(host), F.explode(line_keys(F.col(text_col))).alias("line")
    if copy_col is None:
        held = docs.select(host, held)
    else:
        copy = F.col(copy_col).alias("copy")
        pages, held = docs.select(host, copy).distinct(), docs.select(host, copy, held).distinct()
    pages = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    pages = pages.withColumnRenamed("host", "_host")
    return (held.join(pages, held.host.eqNullSafe(pages._host)).where(F.col("n") > F.col("pages") * F.lit(max_ratio))
            .groupBy("host").agg(F.collect_set("line").alias("dropped")))


def site_line_dedup(docs: DataFrame, max_ratio: float = 0.05, min_pages: int = 5, text_col: str = "text",
                    host_col: str = "source", copy_col: str | None = None, may_empty: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and the columns ``n_lines`` and ``n_dropped``.

    Rows equal in ``copy_col`` are counted as one document. Unless a text ``may_empty``, one that is boilerplate only stays
    whole.

    The host's list is small and stored first, so Spark knows its size and sends it to all tasks only where it fits;
    otherwise the join splits hosts with many documents.
    """
    lists = stage(boilerplate(docs, max_ratio, min_pages, text_col, host_col, copy_col), "boilerplate")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text, host, dropped = docs[text_col], lists["host"], lists["dropped"]
    lines = F.split(text, "\n", -1)
    is_boiler = lambda x: F.array_contains(dropped, F.xxhash64(bare(x)))
    kept = F.when(dropped.isNull(), lines).otherwise(F.filter(lines, lambda x: ~is_boiler(x) | (bare(x) == "")))
    if not may_empty:
        kept = F.when(F.exists(kept, lambda x: bare(x) != ""), kept).otherwise(lines)
    # The row as one column, so that it may have columns of any names.
    done = docs.join(lists, docs[host_col].cast("string").eqNullSafe(host), "left").select(
        F.struct(*(docs[c].alias(c) for c in names)).alias("row"), kept.alias("kept"), F.size(lines).cast("long").alias("whole"))
    of = F.col("row").getField
    none = of(text_col).isNull()
    left = F.coalesce(F.size("kept"), F.lit(0)).cast("long")
    return done.select(*((F.array_join("kept", "\n") if c == text_col else of(c)).alias(c) for c in names),
                       F.when(none, 0).otherwise(F.col("whole")).alias("n_lines"),
                       F.when(none, 0).otherwise(F.col("whole") - left).alias("n_dropped"))
