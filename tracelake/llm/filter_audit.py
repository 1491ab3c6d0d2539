"""Audit of document filters: what each removes, in every order of applying them.

A document fails some of the filters, whatever the order, so all that an order does depends on how many documents of a
part fail which set of filters: the cells of a mask. Cells are counted over all documents; then each cell is folded
along every order of the array of orders, which goes to all tasks with the plan. A fold gives one weighted struct for
each place of each order (600 of them for five filters), and the structs of a part's cells, at most 32, are added up
element by element.

The fifth filter fails documents whose whole text a smaller id has, anywhere in the table. Copies are counted before
they are brought together, by text digest, part and marks, so a text that a third of all rows share is a few rows.

A null text is empty, a null or empty part is the part ''. Rows that share id and text are no copies of each other but
are counted each. A row without an id has no smaller id and is none: it never fails for a copy, and no label is its own.
Of several labels of a document, one that says 1 is enough; null labels say nothing. An empty table has no parts. Other
columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPIED = 1 << 4           # the bit of the filter that looks at other documents
BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
SUMS = f"struct<{','.join(f'{f}:bigint' for f in FIGURES)}>"


def own_failures(text: Column, words: Column, bits: tuple[int, ...] = (1, 2, 4, 8)) -> Column:
    """Bits of the filters that a text fails by itself: short, repetitive, shouting, marked."""
    count = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    fails = (count < 100, F.size(F.array_distinct(words)) * 100 < count * 80, capitals * 100 > F.char_length(text) * 10,
             text.rlike(r"[#$%&*|]"))
    return reduce(Column.__add__, [F.when(f, b).otherwise(0) for f, b in zip(fails, bits)])


def marked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One narrow row per document: its id, text digest, part, own failures, and its labels."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", BLANKS), ""))
    rows = rows.select("doc_id", "part", F.sha2(F.col("t").cast("binary"), 256).alias("digest"),
                       own_failures(F.col("t"), F.col("w")).alias("mask"))
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    return rows.join(told, "doc_id", "left").fillna(False, ["good", "toxic"])


def cells(rows: DataFrame) -> DataFrame:
    """Documents, good and toxic ones among them, of each part and set of failed filters."""
    marks = ["digest", "part", "mask", "good", "toxic"]
    each = rows.groupBy("doc_id", *marks).agg(F.count(F.lit(1)).alias("n"))
    alike = each.groupBy(*marks, F.col("doc_id").isNull().alias("nameless")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))
    # What is left of a text is at most a row for each part and marks.
    alike = alike.withColumn("smallest", F.min("first").over(Window.partitionBy("digest")))
    originals = F.when(F.col("nameless"), F.col("n")).when(F.col("first") == F.col("smallest"), F.col("at_first")).otherwise(0)
    two = F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")),
                  F.struct((F.col("mask") + COPIED).alias("mask"), (F.col("n") - originals).alias("n")))
    counted = alike.select("part", "good", "toxic", F.inline(two)).where("n > 0")
    only = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), only("good").alias("good"), only("toxic").alias("toxic"))


def folded(cell: Column, orders: Column) -> Column:
    """A cell's figures at every place of every order, one after the other."""
    mask, n = cell["mask"], cell["n"]

    def applied(so_far: Column, bit: Column) -> Column:
        before = so_far["before"]
        fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
        weight = lambda when, what: F.when(when, what).otherwise(F.lit(0).cast("long"))
        figures = (weight(~fails & ~earlier, n), weight(fails & ~earlier, n), weight(fails & earlier, n), weight(mask == bit, n),
                   weight(fails & ~earlier, cell["good"]), weight(fails & ~earlier, cell["toxic"]))
        step = F.struct(*[v.alias(name) for name, v in zip(FIGURES, figures)])
        return F.struct(before.bitwiseOR(bit).alias("before"), F.concat(so_far["steps"], F.array(step)).alias("steps"))

    start = F.struct(F.lit(0).alias("before"), F.array().cast(f"array<{SUMS}>").alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, applied, lambda x: x["steps"])))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Figures of every filter at every place of every order, for each part.

    ``counted`` has (part, mask, n, good, toxic), where the bits of ``mask`` are the failed ones of ``filters``, in
    their order. ``shapley`` is what a filter removes, summed over all orders.
    """
    ways = list(permutations(range(len(filters))))
    orders = F.lit([[1 << i for i in w] for w in ways])
    names = F.lit(["".join(filters[i] for i in w) for w in ways])
    places = len(ways) * len(filters)

    zero = F.struct(*[F.lit(0).cast("long").alias(f) for f in FIGURES])
    added = lambda x, y: F.struct(*[(x[f] + y[f]).alias(f) for f in FIGURES])
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    parts = parts.select("part", F.aggregate("cells", F.array_repeat(zero, places),
                                             lambda total, cell: F.zip_with(total, folded(cell, orders), added)).alias("sums"))
    share = lambda bit: F.aggregate(F.zip_with(F.flatten(orders), "sums", lambda b, s: F.when(b == bit, s["removed"]).otherwise(0)),
                                    F.lit(0).cast("long"), lambda x, y: x + y)
    shares = F.create_map(*[v for i, f in enumerate(filters) for v in (F.lit(f), share(1 << i))])
    rows = parts.select("part", shares.alias("shares"), F.posexplode("sums").alias("place", "s"))
    order, step = F.get(names, F.floor(F.col("place") / len(filters)).cast("int")), F.col("place") % len(filters) + 1
    rows = rows.select("part", order.alias("filter_order"), step.cast("int").alias("step"), "s.*", "shares")
    return rows.withColumn("shapley", F.col("shares")[F.substring("filter_order", F.col("step"), F.lit(1))]).drop("shares")


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        part_col: str = "lang") -> DataFrame:
    """The audit of the five filters over all ``docs``; ``labels`` has doc_id, quality and toxic."""
    return audit(cells(marked(docs, labels, id_col, text_col, part_col)))
