"""Hard negatives by slots of scores.

An anchor's positives are the rows of its label that score best. Each positive asks for the best rows of other labels
whose score lies in a window below its own. The windows of one anchor overlap; their upper limits cut the scores into
disjoint slots, a slot being reached by the windows of all positives above it. Rows and anchors meet in blocks, and a
block keeps the best few of each slot only; the best of each slot over all blocks are found next, and then, from the
lowest slot up, a slot's rows go in front of those below it: the first few of what is there are the answer to the window
that begins at this slot, as far as they reach its lower limit. Two passes over the blocks, first for positives, then for
slots; anchors are a set number of the rows, and no list grows with the rows of a label or of a score.

Vectors are scaled, rounded down and kept as whole numbers; a score is their inner product, exact, and held at the
limits of 64 bits. A shorter vector counts as ending in zeros. Higher scores come first, equal ones by smaller id.

Rows without id or label, without vector, or with a null or non-finite component take no part. Rows equal in id, label
and vector are one row; rows that share an id alone are different rows, told apart by a digest, and anchors each. A
positive below zero has an empty window. Empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.session import stage

BLOCK_BYTES = 32 << 20    # numbers of the rows, or of the anchors, that meet in a task
FEW_ROWS = 2_048          # blocks are not made smaller than this,
BLOCKS = 48               # and not more than so many as long as they are smaller than they may be
CHUNK = 1 << 22           # scores held at a time
LARGEST = (1 << 63) - 1
FOUND = "anchor_id long, anchor_tag long, slot int, vec_id long, tag long, score long"


def scaled(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """Rows that take part, once each: vec_id, tag, label and the vector as whole numbers."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    odd = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    fit = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd
    some = rows.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))
    return some.distinct().withColumn("tag", F.xxhash64("label", "v"))


class Block:
    """Rows of one side of a cell, by ascending id, with their vectors as a matrix."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by([("vec_id", "ascending"), ("tag", "ascending")])
        self.table, self.n = table, table.num_rows
        self.ids, self.tags, self.labels = (table.column(c).to_numpy() for c in ("vec_id", "tag", "label"))
        lists = table.column("v").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        lens = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.vectors = np.zeros((self.n, int(lens.max(initial=0))), np.int64)
        self.vectors[np.arange(self.vectors.shape[1]) < lens[:, None]] = flat


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``one`` with all of ``two``."""
    width = min(one.shape[1], two.shape[1])
    one, two = one[:, :width], two[:, :width]
    top = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (one, two)]
    if top[0] * top[1] * width < 1 << 53:
        return (one.astype(np.float64) @ two.T.astype(np.float64)).astype(np.int64)
    exact = one.astype(object) @ two.T.astype(object)
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64) if exact.size else exact.astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, the highest first, equal ones in their order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.argsort(-scores[at], kind="stable")][:k]


def met(pick: Callable[[Block, int, Block, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The work of a cell: for each anchor, the rows that ``pick`` takes, as (slot, places)."""
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
        if not anchors.num_rows or not rows.num_rows:  # a block that no row was dealt to
            return packed(out)
        a, r = Block(anchors), Block(rows)
        step = max(1, CHUNK // r.n)
        for begin in range(0, a.n, step):
            scores = products(a.vectors[begin:begin + step], r.vectors)
            for i, own in enumerate(scores, begin):
                for slot, at in pick(a, i, r, own):
                    for column, v in zip(out, (a.ids[i], a.tags[i], slot, r.ids[at], r.tags[at], own[at])):
                        column.append(np.full(len(at), v) if np.ndim(v) == 0 else v)
        return packed(out)

    def packed(out: list[list[np.ndarray]]) -> pa.Table:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])
    return cell


def blocked(rows: DataFrame, anchors: DataFrame, shape: tuple[int, int], work: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """Every block of ``anchors`` with every block of ``rows``, each pair of blocks by one call of ``work``."""
    high, wide = shape
    of = lambda n: F.pmod(F.xxhash64("vec_id", "tag"), F.lit(n))
    along = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda df, a, r: df.withColumn("a", a).withColumn("r", r).withColumn(
        "cell", F.col("a") * wide + F.col("r")).drop("a", "r").repartition(min(high * wide, 20_000), "cell").groupBy("cell")
    # Both sides come of one table; new names of their columns keep them apart.
    left, right = dealt(anchors, of(high), along(wide)), dealt(rows.toDF(*rows.columns), along(high), of(wide))
    return left.cogroup(right).applyInArrow(work, FOUND)


def leading(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` rows of each group over all blocks."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "tag")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each anchor and positive, its first ``negatives`` rows of other labels between ``low`` and ``high`` percent of
    the positive's score. ``is_anchor`` is a condition on ``vec_id``."""
    spark = rows.sparkSession
    every = stage(scaled(rows, id_col, vector_col, label_col, scale), "vectors")
    anchors = every.where(is_anchor)
    size = every.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("v")).alias("width")).first()
    if not size.anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    most = max(1, BLOCK_BYTES // (8 * max(size.width, 1)))
    tall, wide = -(-size.anchors // most), max(-(-size.n // most), min(BLOCKS, -(-size.n // FEW_ROWS)))

    def same_label(a: Block, i: int, r: Block, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        at = np.flatnonzero((r.labels == a.labels[i]) & ((r.ids != a.ids[i]) | (r.tags != a.tags[i])))
        yield 0, at[best(scores[at], positives)]

    near = leading(blocked(every, anchors, (tall, wide), met(same_label)), positives, "anchor_id", "anchor_tag")
    # A window that can hold anything: its limits in whole scores, and the slot that begins at its upper one.
    floor = lambda c, p: F.expr(f"floor(cast({c} as decimal(38, 0)) * {p} / 100)").cast("long")
    ceil = lambda c, p: F.expr(f"ceil(cast({c} as decimal(38, 0)) * {p} / 100)").cast("long")
    windows = near.where("score >= 0").select(
        F.col("anchor_id"), F.col("anchor_tag"), F.struct((F.col("nth") - 1).alias("slot"), "vec_id", "score", floor("score", high).alias("upper"),
                                                          ceil("score", low).alias("lower")).alias("window"))
    # At most ``positives`` to an anchor.
    asked = stage(windows.groupBy("anchor_id", "anchor_tag").agg(F.array_sort(F.collect_list("window")).alias("windows")), "windows")
    asking = anchors.withColumnsRenamed({"vec_id": "anchor_id", "tag": "anchor_tag"}).join(asked, ["anchor_id", "anchor_tag"]).select(
        F.col("anchor_id").alias("vec_id"), F.col("anchor_tag").alias("tag"), "label", "v",
        F.transform("windows", lambda w: w["upper"]).alias("uppers"), F.array_min(F.transform("windows", lambda w: w["lower"])).alias("least"))

    def in_slots(a: Block, i: int, r: Block, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        uppers = np.array(a.table.column("uppers")[i].as_py(), np.int64)
        at = np.flatnonzero((r.labels != a.labels[i]) & (scores <= uppers[0]) & (scores >= a.table.column("least")[i].as_py()))
        # The last of the descending limits that a score does not pass.
        slots = np.searchsorted(-uppers, -scores[at], "right") - 1
        for slot in np.unique(slots):
            own = at[slots == slot]
            yield slot, own[best(scores[own], negatives)]

    slotted = leading(blocked(every, asking, (tall, wide), met(in_slots)), negatives, "anchor_id", "anchor_tag", "slot")
    each = F.struct("slot", "nth", "vec_id", "score")
    slotted = slotted.groupBy("anchor_id", "anchor_tag").agg(F.array_sort(F.collect_list(each)).alias("found"))

    def suffix(so_far: Column, window: Column) -> Column:
        own = F.filter("found", lambda x: x["slot"] == window["slot"])
        top = F.slice(F.concat(own, so_far["top"]), 1, negatives)
        hits = F.filter(top, lambda x: x["score"] >= window["lower"])
        answer = F.struct(window["vec_id"].alias("positive_id"), window["score"].alias("positive_score"), hits.alias("hits"))
        return F.struct(top.alias("top"), F.concat(so_far["answers"], F.array(answer)).alias("answers"))

    row = "struct<slot:int,nth:int,vec_id:bigint,score:bigint>"
    start = F.struct(F.array().cast(f"array<{row}>").alias("top"),
                     F.array().cast(f"array<struct<positive_id:bigint,positive_score:bigint,hits:array<{row}>>>").alias("answers"))
    answers = asked.join(slotted, ["anchor_id", "anchor_tag"]).select(
        "anchor_id", F.inline(F.aggregate(F.reverse("windows"), start, suffix, lambda x: x["answers"])))
    return answers.select("anchor_id", "positive_id", "positive_score", F.posexplode("hits").alias("at", "hit")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("negative_id"),
        "positive_score", F.col("hit.score").alias("negative_score"))
