"""Removal of text that stands earlier in the corpus, by suffix arrays.

Every 100 bytes of a document hold an anchor: the stretch of ``GRAM`` bytes with the least hash among those inside. Equal
strings of that length have equal anchors at equal places, so each string belongs to one anchor, and the strings of an
anchor form one stretch of text around it, its context. Contexts are dealt out by their anchor's hash. Copies of a
whole context are one class, kept as its first occurrence; the others are covered wholly. Where an anchor has several
classes, an enhanced suffix array of their contexts is built: the suffixes at which the classes' left extensions differ
are sorted, and a scan of their common prefixes with a stack walks the tree of intervals. An interval of suffixes that
share ``LENGTH`` bytes or more is a maximal repeat with all of its occurrences; all but the first of them are covered.

Documents are ordered by id, then by a hash of the text; null ids come last. Rows equal in id and text are one document
and get equal rows. A null text has no bytes. Texts shorter than ``LENGTH`` keep all bytes. An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import parts, per_batch, text_key, utf8, values
from tracelake.session import stage, stage_counted

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM      # how far before an anchor a string of it can start
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A place holds, from the high bits down: text hash (16), position of the anchor (32), how far before it its first (7)
#: and last (7) string start, and whether it is a copy (1).
TIE, POSITION, FIRST, LAST = 47, 15, 8, 1
PAD = 255                 # never a byte of UTF-8
BLOCK = 4_096             # contexts sorted at once; more than that only for a single anchor
CROWD = 50_000            # contexts of one anchor that a task may sort; the strings of others are dealt out one by one
ANCHORS = "h long, c long, node long, at long"
FOUND = "node long, tie int, begin long, end long"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2 to the 64."""
    if not _powers or len(_powers[0]) < n:
        n = 1 << n.bit_length()
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
                      for b in (BASE, BASE_INVERSE)]
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any stretches of a byte string."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the texts that stand one after the other in ``data``.

    Returns for each its text, position, hash, first and last start of its strings, and its context's hash; positions are
    those in ``data``.
    """
    n = len(data)
    bits = np.uint64(max(1, n.bit_length()))
    hashes = Hashes(data)
    at = np.arange(n - GRAM + 1)
    low = (hashes.sums[GRAM:] - hashes.sums[:n - GRAM + 1]) * hashes.down[:n - GRAM + 1]
    # The order among grams, and the leftmost of equal ones.
    low = (mixed(low) >> bits << bits) | at.astype(np.uint64)
    reach = 1
    while reach * 2 <= SPAN + 1:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < SPAN + 1:
        low = np.minimum(low[:len(low) - (SPAN + 1 - reach)], low[SPAN + 1 - reach:])
    of = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # the anchor of the string starting here
    # Starts whose string lies within a text.
    count = np.maximum(ends - starts - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(starts)), count)
    begin = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    anchor = of[begin]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    a, lo, hi = anchor[first], begin[first], begin[last]
    shape = mixed(((a - lo) * 128 + (hi - a + SPAN)).astype(np.uint64))
    return text[first], a, hashes.of(a, a + GRAM), lo, hi, mixed(hashes.of(lo, hi + LENGTH) ^ shape)


def anchored(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Anchors of a few whole texts. Copies of a context among them are marked, so that they need not meet others."""
    texts = values(batch, "text")
    node, tie = (np.array(values(batch, c), np.int64) for c in ("node", "tie"))
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    if not len(sizes) or sizes.max() < LENGTH:
        empty = pa.array([], pa.int64())
        return pa.RecordBatch.from_arrays([empty] * 4, names=["h", "c", "node", "at"])
    text, a, h, lo, hi, c = anchors(np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends)
    place = (a - (ends - sizes)[text]) << POSITION | (a - lo) << FIRST | (a - hi) << LAST | tie[text] << TIE
    node = node[text]
    order = np.lexsort((place, node, c, h))
    h, c, node, place = h[order].view(np.int64), c[order].view(np.int64), node[order], place[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    once = np.ones(len(h), bool)
    once[1:] = ~(same[1:] & (node[1:] == node[:-1]) & (place[1:] == place[:-1]))
    place = place | same
    return pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (h, c, node, place)], names=["h", "c", "node", "at"])


def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by (h, c, node, at): copies, with h null, and classes whose anchor has other classes too."""
    def out(h: pa.Array, node: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([h, pa.array(node), pa.array(at)], names=["h", "node", "at"])

    before = np.zeros((0, 4), np.int64)   # the last row, to compare with
    first = np.zeros((0, 3), np.int64)    # the last class, whose successor is not known yet
    joined = False                        # whether that class has the anchor of the one before it
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        marked = (rows[:, 3] & 1) == 1
        copies = rows[marked]
        rows = rows[~marked]
        if len(rows):
            both = np.concatenate([before, rows])
            same = np.zeros(len(both), bool)
            same[1:] = (both[1:, :2] == both[:-1, :2]).all(axis=1)
            again = np.zeros(len(both), bool)
            again[1:] = (both[1:] == both[:-1]).all(axis=1)
            fresh = slice(len(before), None)
            copies = np.concatenate([copies, both[fresh][same[fresh] & ~again[fresh]]])
            heads = np.concatenate([first, both[fresh][~same[fresh]][:, [0, 2, 3]]])
            if len(heads):
                with_next = np.zeros(len(heads), bool)
                with_next[:-1] = heads[:-1, 0] == heads[1:, 0]
                with_last = np.concatenate([[joined if len(first) else False], with_next[:-1]])
                wanted = (with_next | with_last)[:-1]
                some = heads[:-1][wanted]
                if len(some):
                    yield out(pa.array(some[:, 0]), some[:, 1], some[:, 2])
                first, joined = heads[-1:], bool(with_last[-1])
            before = both[-1:]
        if len(copies):
            yield out(pa.nulls(len(copies), pa.int64()), copies[:, 2], copies[:, 3])
    if joined:
        yield out(pa.array(first[:, 0]), first[:, 1], first[:, 2])


def extents(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of the anchor, and of the first and last string of it, from a place."""
    a = (at >> POSITION) & 0xFFFFFFFF
    return a, a - ((at >> FIRST) & 127), a - ((at >> LAST) & 127)


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the anchors of each document."""
    for batch in (p for b in batches for p in parts(b, "text")):
        lists = batch.column(batch.schema.get_field_index("wanted"))
        flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        h, at = (flat.field(i).to_numpy() for i in range(2))
        doc = np.repeat(np.arange(len(counts)), counts)
        _, lo, hi = extents(at)
        texts = values(batch, "text")
        cut = [texts[d][x:y] for d, x, y in zip(doc.tolist(), lo.tolist(), (hi + LENGTH).tolist())]
        node = batch.column(batch.schema.get_field_index("node")).to_numpy()[doc]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(node), pa.array(at), pa.array(cut, pa.binary())],
                                         names=["h", "node", "at", "context"])


class Interval:
    """A run of sorted suffixes with a common prefix, while the scan is inside it."""

    __slots__ = ("depth", "begin", "first", "left", "later")

    def __init__(self, depth: int, begin: int, first: int, left: int):
        self.depth, self.begin, self.first, self.left = depth, begin, first, left
        self.later: list[int] = []

    def take(self, other: Interval, order: list[int]) -> None:
        """Add a child: keep the earliest occurrence of both, and whether all have one byte on their left."""
        if order[other.first] < order[self.first]:
            self.later.append(self.first)
            self.first = other.first
        else:
            self.later.append(other.first)
        if other.left != self.left:
            self.left = -1


def intervals(common: list[int], order: list[int], left: list[int]) -> Iterator[tuple[Interval, int]]:
    """Intervals of the common-prefix tree, children first, with their last suffix.

    ``common[i]`` is the prefix that suffixes i - 1 and i share. ``later`` of an interval are the first occurrences of its
    children other than its own: every suffix but the very first is later in exactly one interval, the deepest that
    holds an earlier one.
    """
    stack: list[Interval] = []
    for i in range(1, len(order) + 1):
        depth = common[i] if i < len(order) else 0
        node = Interval(0, i - 1, i - 1, left[i - 1])
        while stack and stack[-1].depth > depth:
            top = stack.pop()
            top.take(node, order)
            yield top, i - 1
            node = top
        if stack and stack[-1].depth == depth:
            stack[-1].take(node, order)
        elif depth:
            stack.append(Interval(depth, node.begin, node.first, node.left))


def sorted_suffixes(group: np.ndarray, before: np.ndarray, back: np.ndarray, texts: list[bytes]):
    """The enhanced suffix array of contexts, which are ordered by group and within it by first occurrence.

    Returns context and column of each suffix in sorted order, common prefixes (0 where shorter than ``LENGTH``), the byte
    on the left (a number of its own where there is none), with the anchors of all contexts in column ``SPAN``.
    """
    m, width = len(texts), SPAN + LENGTH
    size = np.array([len(t) for t in texts])
    x = np.full(m * width, PAD, np.uint8)
    first_column = SPAN - before
    flat = np.repeat(np.arange(m) * width + first_column - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    x[flat] = np.frombuffer(b"".join(texts), np.uint8)
    x = x.reshape(m, width)
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    differs = np.zeros((m, SPAN + 1), bool)
    differs[1:, 1:] = x[1:, :SPAN] != x[:-1, :SPAN]
    differs[heads] = False
    differs[np.arange(m), first_column] = True
    diverse = np.logical_or.reduceat(differs, heads, axis=0)
    number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, m)))
    columns = np.arange(SPAN + 1)
    row, column = np.nonzero(diverse[number] & (columns >= first_column[:, None]) & (columns <= (SPAN - back)[:, None]))
    # Suffixes are compared within a group and a column: equal strings have their anchor at the same place.
    data = x.tobytes()
    keys = [b"%08x%02x" % (g, c) + data[r * width + c:(r + 1) * width]
            for g, r, c in zip(number[row].tolist(), row.tolist(), column.tolist())]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    del keys
    row, column = row[order], column[order]
    common = np.zeros(len(row), np.int64)
    end = first_column + size
    for at in range(1, len(row), 50_000):
        i = np.arange(at, min(at + 50_000, len(row)))
        one, two, c = row[i - 1], row[i], column[i]
        equal = (x[one] == x[two]) | (np.arange(width) < c[:, None])
        shared = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        shared = np.minimum(np.minimum(shared, end[one]), end[two]) - c
        common[i] = np.where((number[one] == number[two]) & (column[i - 1] == c) & (shared >= LENGTH), shared, 0)
    inner = column > first_column[row]
    left = np.where(inner, x[row, np.maximum(column - 1, 0)].astype(np.int64), -2 - np.arange(len(row)))
    return row, column, common, left


def maximal_repeats(group: np.ndarray, before: np.ndarray, back: np.ndarray, texts: list[bytes]
                    ) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[int]]]:
    """Maximal repeats of at least ``LENGTH`` bytes: length, contexts and columns of all occurrences, and which of them
    have their nearest earlier occurrence in this repeat."""
    row, column, common, left = sorted_suffixes(group, before, back, texts)
    runs = np.flatnonzero(common)
    if not len(runs):
        return
    # Only stretches of suffixes that share enough with a neighbour.
    new = np.flatnonzero(np.r_[True, np.diff(runs) > 1])
    for i, j in zip(runs[new] - 1, runs[np.append(new[1:], len(runs)) - 1] + 1):
        for node, last in intervals(common[i:j].tolist(), row[i:j].tolist(), left[i:j].tolist()):
            if node.left < 0:  # bytes on the left differ, or one has none: it cannot be made longer
                here = slice(i + node.begin, i + last + 1)
                yield node.depth, row[here], column[here], [k - node.begin for k in node.later]


def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered stretches from contexts that come sorted by (h, node, at); whole anchors at a time."""
    held: list[pa.RecordBatch] = []

    def done(block: pa.Table) -> pa.RecordBatch:
        h, node, at = (block.column(i).to_numpy() for i in range(3))
        a, lo, hi = extents(at)
        out_row, out_begin, out_size = [], [], []
        for length, rows, columns, later in maximal_repeats(h, a - lo, a - hi, block.column(3).to_pylist()):
            for k in later:
                out_row.append(rows[k])
                out_begin.append(a[rows[k]] - SPAN + columns[k])
                out_size.append(length)
        rows = np.array(out_row, np.int64)
        begin = np.array(out_begin, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(node[rows]), pa.array((at[rows] >> TIE).astype(np.int32)), pa.array(begin),
             pa.array(begin + np.array(out_size, np.int64))], names=["node", "tie", "begin", "end"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            table = pa.Table.from_batches(held)
            h = table.column(0).to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0  # the last anchor may go on
            if cut:
                yield done(table.slice(0, cut))
                held = table.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield done(pa.Table.from_batches(held))


def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What is left of each text without its covered stretches, and the runs of these."""
    rows = []
    for text, spans in zip(values(batch, "text"), values(batch, "spans")):
        runs: list[dict[str, int]] = []
        for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
            if runs and begin <= runs[-1]["end"]:
                runs[-1]["end"] = max(runs[-1]["end"], end)
            else:
                runs.append({"begin": begin, "end": end})
        past = [0, *(r["end"] for r in runs)]
        upto = [*(r["begin"] for r in runs), len(text)]
        rows.append((len(text), b"".join(text[b:e] for b, e in zip(past, upto)), runs))
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")),
                                       *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))],
                                      names=["doc_id", "n_bytes", "kept", "spans"])


def node(id_col: str, text_col: str) -> Column:
    """The id, or for null a number behind all ids, made from the text."""
    return F.coalesce(F.col(id_col).cast("long"),
                      F.shiftrightunsigned(text_key(text_col), 2).bitwiseOR(F.lit(1 << 62).cast("long")))


def covered(docs: DataFrame) -> DataFrame:
    """Stretches (node, tie, begin, end) of the documents (node, tie, text) that stand earlier in the corpus."""
    met = F.when(F.col("at").bitwiseAND(1) == 1, F.xxhash64("node", "at")).otherwise(F.col("h"))
    rows = per_batch(docs, anchored, ANCHORS).repartition(met).sortWithinPartitions("h", "c", "node", "at")
    found = stage(rows.mapInArrow(classed, "h long, node long, at long"), "contexts")
    tie = F.shiftright("at", TIE).cast("int").alias("tie")
    anchor = F.shiftright("at", POSITION).bitwiseAND(0xFFFFFFFF)
    copies = found.where("h is null").select(
        "node", tie, (anchor - F.shiftright("at", FIRST).bitwiseAND(127)).alias("begin"),
        (anchor - F.shiftright("at", LAST).bitwiseAND(127) + LENGTH).alias("end"))
    wanted = found.where("h is not null").select(F.col("node").alias("_node"), tie.alias("_tie"), F.struct("h", "at").alias("p"))
    wanted = wanted.groupBy("_node", "_tie").agg(F.collect_list("p").alias("wanted"))
    around = (docs.join(wanted, (F.col("node") == F.col("_node")) & (F.col("tie") == F.col("_tie")))
              .select("node", "text", "wanted").mapInArrow(contexts, "h long, node long, at long, context binary"))
    crowded, n = stage_counted(found.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
                               .where(F.col("n") > CROWD).select("h"), "crowded")
    out = copies
    if n:
        around = stage(around, "around")
        out = out.unionByName(by_string(around.join(crowded, "h", "left_semi")))
        around = around.join(crowded, "h", "left_anti")
    return out.unionByName(around.repartition("h").sortWithinPartitions("h", "node", "at").mapInArrow(sort_blocks, FOUND))


def by_string(around: DataFrame) -> DataFrame:
    """Covered stretches of anchors with too many contexts for one task: each string is dealt out by its own digest.

    The first occurrence of each string is found with partial sums, so no task holds what one string or anchor has.
    """
    at = around.select("node", F.shiftright("at", TIE).cast("int").alias("tie"), "context",
                       (F.shiftright("at", POSITION).bitwiseAND(0xFFFFFFFF) - F.shiftright("at", FIRST).bitwiseAND(127)).alias("first"),
                       F.explode(F.sequence(F.lit(0), F.octet_length("context") - LENGTH)).alias("i"))
    at = at.select(F.sha2(F.substring("context", F.col("i") + 1, F.lit(LENGTH)), 256).alias("string"),
                   F.struct("node", "tie", (F.col("first") + F.col("i")).alias("begin")).alias("place"))
    earliest = at.groupBy("string").agg(F.min("place").alias("earliest"))
    return at.join(earliest, "string").where("place > earliest").select(
        "place.*", (F.col("place.begin") + LENGTH).alias("end"))


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: its bytes, those that are kept (a cut may divide a character), and the runs that are removed."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), node(id_col, text_col).alias("node"),
                        text_key(text_col).bitwiseAND(0xFFFF).cast("int").alias("tie"), utf8(text_col).alias("text"))
    spans = covered(texts.drop("doc_id")).groupBy(F.col("node").alias("_node"), F.col("tie").alias("_tie")).agg(
        F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = texts.join(spans, (F.col("node") == F.col("_node")) & (F.col("tie") == F.col("_tie")), "left")
    return per_batch(joined.select("doc_id", "text", "spans"), cut_out,
                     "doc_id long, n_bytes long, kept binary, spans array<struct<begin:long,end:long>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: its bytes, how many are removed in how many runs, and the SHA-256 of the rest."""
    return kept_texts(docs, id_col, text_col).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
