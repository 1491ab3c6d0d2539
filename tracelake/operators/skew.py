"""Group operations that stay balanced when one group holds most of the rows.

A plain window function sends a whole group to one task. The helpers here work
in two levels instead: inside ``(group, slice)`` first, then over one small
aggregated row per slice. A slice is any expression that never decreases along
the wanted order, such as the day of a timestamp.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.session import stage, stage_counted

#: How many of the largest keys are treated as hot. Any other key holds less
#: than 1/1000 of the rows, so it needs no splitting; and a table of at most
#: this many keys is safe to broadcast whatever the data size.
HOT_KEYS = 1000
#: A key below this many rows is never worth splitting.
HOT_ROWS = 1_000_000
SALTS = 64
#: How many values of a group one row holds while they are folded.
FOLD = 1024


def rank_in_groups(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column],
                   out: str) -> DataFrame:
    """``row_number`` within each group, split over the group's slices."""
    sliced = df.withColumn("_slice", slice_by)
    local = sliced.withColumn(out, F.row_number().over(
        Window.partitionBy(*keys, "_slice").orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        local.join(offsets, [*keys, "_slice"])
        .withColumn(out, (F.col(out) + F.col("_off")).cast("bigint"))
        .drop("_slice", "_off")
    )


def rank_by_key(source: DataFrame, source_key: str, build: Callable[[DataFrame], DataFrame], key: str, keys: list[str],
                slice_by: Column, order: list[Column], out: str) -> DataFrame:
    """``row_number`` within each group of ``build(source)``, where no group has rows of two values of ``key``.

    ``build`` carries ``source_key`` along as ``key`` and joins on it, so that ranking needs no shuffle of its own. Only
    rows of keys too heavy for one task are ranked slice by slice. Rows without a group or a slice are left out, and
    those without a slice counted, as :func:`rank_in_groups` does.
    """
    weight = source.groupBy(source_key).agg(F.count("*").alias("_n")).where(F.col("_n") >= HOT_ROWS)
    hot, n_hot = stage_counted(weight.select(source_key), "hot-keys")
    whole = slice_by.isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    ranked = F.row_number().over(Window.partitionBy(key, *keys).orderBy(*order)).cast("bigint")
    if not n_hot:
        return build(source).withColumn(out, ranked).where(whole)
    # At most one key in HOT_ROWS rows is hot, so the list is safe to broadcast.
    rest = build(source.join(F.broadcast(hot), source_key, "left_anti")).withColumn(out, ranked).where(whole)
    heavy = build(source.join(F.broadcast(hot), source_key, "left_semi"))
    return rest.unionByName(rank_in_groups(heavy, [key, *keys], slice_by, order, out))


def running_sum(df: DataFrame, keys: list[str], slice_by: Column, order: list[Column],
                value: Column, out: str, slice_descending: bool = False) -> DataFrame:
    """Running total within each group, split over the group's slices."""
    sliced = df.withColumn("_slice", slice_by).withColumn("_v", value)
    upto = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn(out, F.sum("_v").over(upto))
    slice_order = F.desc("_slice") if slice_descending else F.asc("_slice")
    before = Window.partitionBy(*keys).orderBy(slice_order).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_s"))
        .withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0)))
        .drop("_s")
    )
    return (
        local.join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col(out) + F.col("_off"))
        .drop("_slice", "_v", "_off")
    )


def previous_in_groups(df: DataFrame, keys: list[str], slice_by: Column, order: list[str],
                       value: str, out: str, descending: bool = False) -> DataFrame:
    """``lag`` within each group, split over its slices.

    The first row of a slice looks at the last row of the slice before it, which
    is one aggregated row per slice.
    """
    turn = F.desc if descending else F.asc
    sliced = df.withColumn("_slice", slice_by)
    walk = Window.partitionBy(*keys, "_slice").orderBy(*[turn(c) for c in order])
    local = sliced.withColumn("_lag", F.lag(value).over(walk)).withColumn(
        "_first", F.row_number().over(walk) == 1)
    boxed, at = F.struct(F.col(value).alias("v")), F.struct(*order)
    last = (
        sliced.groupBy(*keys, "_slice")
        .agg((F.min_by(boxed, at) if descending else F.max_by(boxed, at)).alias("_last"))
        .withColumn("_before", F.lag("_last").over(
            Window.partitionBy(*keys).orderBy(turn("_slice"))))
        .drop("_last")
    )
    return (
        local.join(last, [*keys, "_slice"])
        .withColumn(out, F.when(F.col("_first"), F.col("_before.v")).otherwise(F.col("_lag")))
        .drop("_slice", "_lag", "_first", "_before")
    )


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], weight: str,
           spread: list[str], how: str = "left") -> DataFrame:
    """Join one aggregated row per key to all rows of that key.

    ``weight`` is the row count in ``per_key``. The largest keys are spread over
    ``SALTS`` tasks by a hash of the ``spread`` columns, with their aggregated
    row repeated once per salt; all other keys join as usual.
    """
    hot = (
        per_key.select(*keys, weight).orderBy(F.desc(weight)).limit(HOT_KEYS)
        .where(F.col(weight) >= HOT_ROWS)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    rows = df.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0)
    ).drop("_hot")
    repeated = per_key.withColumn("_salt", F.explode(
        F.when(F.col(weight) >= HOT_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1)))
        .otherwise(F.array(F.lit(0))))).withColumn("_salt", F.col("_salt").cast("bigint"))
    # A key heavy enough to be repeated but outside the hot list keeps salt 0,
    # which its repeated rows include, so no row is lost or doubled.
    return rows.join(repeated, [*keys, "_salt"], how).drop("_salt")


def multiset_hash(text: Column) -> list[Column]:
    """Two sums that identify a set of texts whatever their order.

    Each text contributes two 60-bit pieces of its SHA-256; sums combine on the
    map side, so no group is ever gathered to be sorted and concatenated.
    """
    digest = F.sha2(text, 256)
    return [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
              .cast("decimal(38,0)")) for i in range(2)
    ]


def fold_in_order(df: DataFrame, keys: list[str], order: str, value: str, start: Column,
                  combine: Callable[[Column, Column], Column]) -> DataFrame:
    """One ``value`` per group: all of its values combined in ascending ``order``, which no two rows of a group share.

    ``combine`` has to be associative, with ``start`` changing nothing. Runs of at most ``FOLD`` neighbours are
    combined first, wherever they lie, then the results likewise, until every group is short enough: a group of a
    billion rows takes three rounds, and no row ever holds more than ``FOLD`` values.
    """
    def folded() -> Column:
        return F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]), start, combine)

    part = stage(df.select(*keys, F.col(order).alias("_at"), F.col(value).alias("_v")), "fold")
    while (part.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > FOLD:
        placed = part.repartitionByRange(*keys, "_at").sortWithinPartitions(*keys, "_at").withColumn(
            "_block", F.floor(F.monotonically_increasing_id() / FOLD))
        # Numbers of places are fixed by writing them down; a lost task gives the same ones again.
        placed = stage(placed, "fold-places")
        part = stage(placed.groupBy(*keys, "_block").agg(F.min("_at").alias("_at"), folded().alias("_v")).drop("_block"), "fold")
    return part.groupBy(*keys).agg(folded().alias(value))
