"""Benchmark decontamination by a broadcast hash set of word windows.

Every window of consecutive words of a benchmark item is hashed; the windows of each document are looked up in the set
of hashes, and what is found is compared word by word. Documents, or the words hit, can then be removed. All of it is
DataFrame expressions.

Null texts have no words. Rows equal in id and text are the same document and get equal rows. Items without words match
nothing; an item without id counts as the id ''. Empty tables give no hits. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import text_key
from tracelake.session import stage_counted

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Windows that are broadcast, and their bytes; beyond either, places and hashes alone are shuffled to look them up.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 256 << 20


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; the built-in function does the same for plain ASCII, faster."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, CAPITALS, CAPITALS.lower())))


def words_of(text: Column) -> Column:
    """The words of a text; only the first and last part of the split can be empty."""
    parts = F.split(lowered(F.coalesce(text, F.lit(""))), f"{GAP}+", -1)
    first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def window_hash(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(size)))


def windows_of(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: length, hash, words and the items that hold them."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                             words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    each = (items.withColumn("len", n).select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
            .select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("window")))
    by_len = F.col("len")
    hashes = F.transform("window", lambda x: F.xxhash64(x))
    key = F.coalesce(*(F.when(by_len == k, window_hash(hashes, F.lit(0), k)) for k in range(1, size + 1)))
    return each.groupBy("len", "window").agg(F.collect_set("item").alias("items")).withColumn("hash", key)


def looked_up(at: DataFrame, windows: DataFrame) -> DataFrame:
    """The rows of documents themselves, and the places where a window of a small table is found."""
    # Not written as an equality, which would make the words a join key and cut them out for every row.
    verified = F.when(F.slice("w", F.greatest(F.col("i") + 1, F.lit(1)), F.col("len")) == F.col("window"), True).otherwise(False)
    same = (F.col("hash") == F.col("_hash")) & (F.col("len") == F.col("_len")) & verified
    return at.join(F.broadcast(windows), same, "left").where("i = -1 or items is not null").select(
        "doc_id", "text_key", "n", "i", "len", "items")


def looked_up_apart(at: DataFrame, rows: DataFrame, windows: DataFrame) -> DataFrame:
    """As :func:`looked_up`, for a table of any size: places and hashes travel without words, those found are then
    brought back to the words of their document, and only the words of these windows travel on."""
    key = (F.col("hash") == F.col("_hash")) & (F.col("len") == F.col("_len"))
    places = at.where("i >= 0").select("doc_id", "text_key", "i", "len", "hash")
    places = places.join(windows.select("_hash", "_len"), key, "left_semi").groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("i", "len", "hash")).alias("places"))
    places = places.withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    met = rows.join(places, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")))
    said = F.transform("places", lambda p: F.struct(p["i"].alias("i"), p["len"].alias("len"), p["hash"].alias("hash"),
                                                    F.slice("w", p["i"] + 1, p["len"]).alias("said")))
    found = met.select("doc_id", "text_key", "n", F.inline(said)).join(windows, key & (F.col("said") == F.col("window")))
    columns = ["doc_id", "text_key", "n", "i", "len", "items"]
    themselves = rows.select("doc_id", "text_key", "n", F.lit(-1).alias("i"), F.lit(None).cast("int").alias("len"),
                             F.lit(None).cast("array<string>").alias("items"))
    return themselves.unionByName(found.select(*columns))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: n_words, the windows found as (first word, length), and the items found."""
    windows, n = stage_counted(windows_of(benchmark, size, item_col, item_text_col), "windows")
    windows = windows.select(F.col("len").alias("_len"), F.col("hash").alias("_hash"), "window", "items")
    held = F.sum(F.octet_length(F.to_json(F.struct("window", "items"))))
    sizes = windows.agg(F.collect_set("_len").alias("lengths"), held.alias("bytes")).first()  # ``size`` numbers at most
    lengths = sorted(sizes.lengths) or [size]
    small = n <= BROADCAST_WINDOWS and (sizes.bytes or 0) <= BROADCAST_BYTES

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"),
                       words_of(F.col(text_col)).alias("w"))
    rows = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n", F.size("w"))
    # One row of each document stands for the document itself, at place -1.
    last = F.greatest(F.col("n") - min(lengths), F.lit(-1))
    at = rows.select("doc_id", "text_key", "w", "h", "n", F.explode(F.sequence(F.lit(-1), last, F.lit(1))).alias("i"))
    fits = lambda k: (F.col("i") >= 0) & (F.col("i") + k <= F.col("n"))
    found = lambda k: F.when(fits(k), window_hash(F.col("h"), F.col("i"), k))
    if len(lengths) == 1:
        at = at.withColumn("len", F.lit(lengths[0])).withColumn("hash", found(lengths[0]))
    else:
        at = at.withColumn("v", F.explode(F.array(*(F.struct(F.lit(k).alias("len"), found(k).alias("hash")) for k in lengths))))
        at = at.where((F.col("i") >= 0) | (F.col("v.len") == lengths[0])).select("*", "v.len", "v.hash").drop("v")
    got = looked_up(at, windows) if small else looked_up_apart(at, rows, windows)
    whole = got.groupBy("doc_id", "text_key").agg(
        F.sum(F.when(F.col("i") == -1, 1)).alias("copies"), F.max("n").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("i") >= 0, F.struct("i", "len")))).alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return whole.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_c", "copies")


def n_hit(windows: str = "windows") -> Column:
    """Words covered by windows that are sorted by place."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def more(acc: Column, x: Column) -> Column:
        end = x["i"] + x["len"]
        new = F.greatest(end - F.greatest(acc["end"], x["i"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["total"] + new).alias("total"))

    return F.aggregate(windows, start, more, lambda acc: acc["total"])


def without_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words, and the gaps before them, cut from the text."""
    spans = found.where(F.size("windows") > 0).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"),
                                                      F.col("windows").alias("_w")).dropDuplicates(["_d", "_k"])
    # Columns are named by their table, so that ``docs`` may have any others.
    text, windows = docs[text_col], spans["_w"]
    joined = docs.join(spans, docs[id_col].cast("long").eqNullSafe(spans["_d"]) & (text_key(text) == spans["_k"]), "left")
    units = F.regexp_extract_all(text, F.lit(f"({GAP}*{WORD}+)"), F.lit(1))
    tail = F.regexp_extract(text, f"({GAP}*)\\z", 1)
    hit = lambda i: F.exists(windows, lambda s: (i >= s["i"]) & (i < s["i"] + s["len"]))
    cut = F.concat(F.array_join(F.filter(units, lambda x, i: ~hit(i)), ""), tail)
    return joined.select(*(F.when(windows.isNull(), text).otherwise(cut).alias(c) if c == text_col else docs[c].alias(c)
                           for c in docs.columns))


def clean_documents(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window was found."""
    bad = found.where(F.size("windows") > 0).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["_d"]) & (text_key(docs[text_col]) == bad["_k"]), "left_anti")
