"""Best-fit-decreasing packing of tokenized documents into sequences.

Documents become token ids; longer ones are cut into pieces of the full length. Pieces are placed from the longest to
the shortest, each in the open sequence it fits most tightly, found by a segment tree over remaining capacities.
Pieces of one length are interchangeable, so the tree is walked once for each run of equal pieces and equal sequences:
the plan depends on the number of pieces of each length, at most ``capacity`` numbers, and gives every piece the place
that placing them one by one would give. Spark counts the lengths, ranks the pieces of each, and looks places up.

A null or empty text is one piece holding the end token. Rows that repeat are packed each. An empty table packs into
nothing. Other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import per_batch
from tracelake.llm.token_ids import token_ids
from tracelake.session import stage

PIECES = "doc_id long, piece int, start long, length long, ids binary"
PLAN = "length long, first long, last long, sequence long, each long, at long"
SLICE = 2_000


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every row: place in the document and ids (little-endian, four bytes each)."""
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = token_ids(tokenizer).encode(batch.column(1), end_id)
        begins = np.concatenate([[0], ends[:-1]])
        n = -(-(ends - begins) // capacity)
        doc = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = nth * capacity
        length = np.minimum(capacity, (ends - begins)[doc] - start)
        data, at = ids.astype("<u4").tobytes(), (begins[doc] + start) * 4
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), pa.array(nth, pa.int32()), pa.array(start), pa.array(length),
             pa.array([data[b:e] for b, e in zip(at, at + 4 * length)], pa.binary())],
            names=["doc_id", "piece", "start", "length", "ids"])

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), cut, PIECES)


class Tightest:
    """A segment tree over capacities: the smallest one, from a given size on, that an open sequence has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def mark(self, capacity: int, there: bool) -> None:
        i = self.leaves + capacity
        self.open[i] = there
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def find(self, size: int) -> int | None:
        i = self.leaves + size
        if self.open[i]:
            return size
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length, best fit, longest first.

    A row (length, first, last, sequence, each, at) puts pieces of ranks ``first`` to ``last`` into sequences from
    ``sequence`` on, ``each`` to a sequence, the first of them ``at`` tokens from its start.
    """
    tree = Tightest(capacity)
    # Sequences of equal remaining capacity, as ranges (first, number).
    free: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    out, made = [], 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if not free[room]:
                tree.mark(room, True)
            free[room].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.find(size)
            if room is None:
                room, first, n = capacity, made, -(-left // (capacity // size))
                made += n
            else:
                first, n = free[room].popleft()
                if not free[room]:
                    tree.mark(room, False)
            each = room // size  # a sequence just used stays the tightest while another piece fits
            full = min(n, left // each)
            some = left - full * each if full < n else 0
            taken = full * each + some
            out.append((size, rank, rank + taken - 1, first, each, capacity - room))
            rank, left = rank + taken, left - taken
            add(room - each * size, first, full)
            if some:
                add(room - some * size, first + full, 1)
            rest = full + (some > 0)
            if rest < n:
                if not free[room]:
                    tree.mark(room, True)
                free[room].appendleft((first + rest, n - rest))
    return out


def placed(cut: DataFrame, capacity: int) -> DataFrame:
    """Sequence and offset of every piece. ``cut`` is a stored table of (doc_id, piece, length, tie) and other columns."""
    spark = cut.sparkSession
    # At most ``capacity`` rows, whatever the input.
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(plan(counts, capacity), PLAN)
    slices = spark.createDataFrame([(s, max(1, n // SLICE)) for s, n in counts.items()], "length long, slices long")

    # Ranks within a length: within slices of it, plus the rows in the slices before.
    dealt = cut.join(F.broadcast(slices), "length").withColumn("slice", F.pmod("tie", "slices")).drop("slices")
    before = dealt.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "tie")
    ranked = (dealt.withColumn("_r", F.row_number().over(order) - 1)
              .join(before.select("length", "slice", "before"), ["length", "slice"])
              .withColumn("rank", F.col("_r") + F.coalesce("before", F.lit(0))))
    # The plan has at most ``capacity`` rows for each length.
    found = ranked.join(F.broadcast(table.withColumnRenamed("length", "_length")),
                        (F.col("length") == F.col("_length")) & F.col("rank").between(F.col("first"), F.col("last")))
    nth = F.col("rank") - F.col("first")
    return found.select(*cut.columns, (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
                        (F.col("at") + F.pmod(nth, "each") * F.col("length")).cast("long").alias("offset"))


def best_fit_packing(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1,
                     id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` tokens; each piece has its ids and their checksum.

    Places are found on narrow rows; ids are joined to them at the end, and only if asked for.
    """
    cut = pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    cut = stage(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    checksum = F.crc32("ids")
    narrow = cut.select("row", "doc_id", "piece", "start", "length", checksum.alias("ids_crc32"),
                        F.xxhash64("row").alias("tie"))
    out = placed(stage(narrow, "narrow-pieces"), capacity).drop("tie")
    return (out.join(cut.select("row", "ids"), "row") if with_ids else out).drop("row")
