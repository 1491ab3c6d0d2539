"""Near-duplicate detection with b-bit MinHash.

A document is the set of its distinct word shingles; one with fewer words than a shingle has its whole sequence as the
only one. Documents of equal sets are one class, and only classes are compared. Bands of minima propose candidates; of
each minimum the low bits are kept, packed into bit planes, and the share of equal ones, corrected for chance
collisions, estimates the similarity. What may be similar is compared on the full sets.

Each class is first compared with the first one that it shares a bucket with, then, as long as that joins many, with a
few members of its buckets' largest components. Classes still outside a bucket's largest component are joined with all
classes of unsettled buckets by their rare shingles: of two sets as similar as the threshold, the smaller one's rarest
ninth and the larger one's rarest fifth have a shingle in common, and two if each part is one shingle longer. That finds
every similar pair, whatever a bucket holds; no bucket is capped. A pair as similar as the threshold of 0.8 shares no bucket with probability
(1 - 0.8^5)^38 = 3e-7.

Null and empty texts, and those without words, have no shingles and are linked with nothing. A null id is replaced by a
negative number made from the text. Rows equal in id and text are one document; where several texts share an id, each is
a document, those but one named by a number behind the ids. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import in_small_batches, parts, per_batch, text_key, utf8, values
from tracelake.session import stage, stage_counted

BANDS, ROWS = 38, 5
HASHES = 192              # the first BANDS * ROWS make the bands, all of them the estimate
BITS = 4
MARGIN = 0.14             # over four and a half standard deviations of the estimate
TRIES = 8                 # members of the largest component that a class outside it is compared with in a round
SHORT = 150               # shingles up to which sets meet on two rare ones instead of one
REMEMBER = 100_000        # words whose hashes a worker keeps, some 20 MB
MIX = np.uint64(0x9E3779B97F4A7C15)
SIGN_BYTES = 1 << 20      # of text at a time: bands and planes of many short texts are larger than these
SIGNED = "doc_id long, text_key long, node long, n_shingles long, s1 long, s2 long, bands array<long>, planes array<long>"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()
_seeds = np.random.default_rng(7)
FACTOR = (_seeds.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
SHIFT = _seeds.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(h))
    out = h[:len(h) - size + 1].copy()
    for k in range(1, size):
        out = mixed(out) + h[k:len(h) - size + 1 + k]
    return np.unique(mixed(out))


def minima(hashes: np.ndarray) -> np.ndarray:
    """Least value of the set under each of ``HASHES`` permutations."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        some = FACTOR[:, None] * x[at:at + 512] + SHIFT[:, None]
        np.minimum(low, some.min(axis=1), out=low)
    return low


def signed(named: DataFrame, words: int) -> DataFrame:
    """Sizes, set digests, band keys and bit planes of every row of (doc_id, text_key, node, text)."""
    salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = values(batch, "text")
        n = np.zeros(len(texts), np.int64)
        sums = np.zeros((2, len(texts)), np.uint64)
        lows = np.zeros((len(texts), HASHES), np.uint32)
        for i, text in enumerate(texts):
            found = shingles(text, words)
            if len(found):
                n[i], lows[i] = len(found), minima(found)
                sums[:, i] = found.sum(dtype=np.uint64), mixed(found ^ MIX).sum(dtype=np.uint64)
        bands = np.broadcast_to(salt, (len(texts), BANDS)).copy()
        for r in range(ROWS):
            bands = mixed(bands ^ lows[:, r:BANDS * ROWS:ROWS].astype(np.uint64)) + salt
        planes = [np.packbits((lows >> np.uint32(b)) & np.uint32(1), axis=1).view(">u8") for b in range(BITS)]
        planes = np.concatenate(planes, axis=1).astype(np.uint64)

        def lists(a: np.ndarray) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()),
                                            pa.array(a.ravel().view(np.int64)))

        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
             lists(bands), lists(planes)], names=["doc_id", "text_key", "node", "n_shingles", "s1", "s2", "bands", "planes"])

    return per_batch(named, sign, SIGNED, limit=SIGN_BYTES)


def with_nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, node, text) of every row, one node for each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), utf8(text_col).alias("text"))
    # Ids of several texts are few or none, and stored, so that Spark knows it.
    several = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.min("text_key").alias("first_key"), F.max("text_key").alias("last_key")).where("first_key < last_key")
    several = stage(several.select("_id", "first_key"), "ids-of-several")
    joined = rows.join(several, F.col("doc_id") == F.col("_id"), "left")
    plain = F.col("doc_id").isNotNull() & (F.col("first_key").isNull() | (F.col("first_key") == F.col("text_key")))
    # Behind the ids, so that a document of its own id is the smaller one.
    made = F.shiftrightunsigned(F.xxhash64("doc_id", "text_key"), 2).bitwiseOR(F.lit(1 << 62).cast("long"))
    nameless = -1 - F.shiftrightunsigned("text_key", 1)
    return joined.select("doc_id", "text_key", F.when(F.col("doc_id").isNull(), nameless).when(plain, F.col("doc_id")).otherwise(made).alias("node"), "text")


def estimate(a: str, b: str) -> Column:
    """Similarity from two classes' bit planes: the share of minima with equal low bits, less chance."""
    per = HASHES // 64
    differ = []
    for k in range(per):
        planes = [F.get(a, F.lit(p * per + k)).bitwiseXOR(F.get(b, F.lit(p * per + k))) for p in range(BITS)]
        differ.append(F.bit_count(reduce(Column.bitwiseOR, planes)))
    equal = 1 - reduce(lambda x, y: x + y, differ) / HASHES
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def may_link(a: str, b: str, percent: int) -> Column:
    """Sizes allow the similarity, and the estimate does not rule it out; names are those of structs of class columns."""
    small, large = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return (small * 100 >= large * percent) & (estimate(f"{a}.planes", f"{b}.planes") >= percent / 100 - MARGIN)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar. ``texts`` has (node, text)."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in (p for b in batches for p in parts(b, "x", "y", limit=2 * SIGN_BYTES)):
            keep = []
            for x, y in zip(values(batch, "x"), values(batch, "y")):
                if known[0] != x:
                    known = x, shingles(x, words)
                one, two = known[1], shingles(y, words)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Both joins read the same exchange of texts. A first class of many members is sent with each of them, and the
    # members, which are many different keys, decide where the rows go.
    firsts = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    seconds = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    met = pairs.join(firsts, "a").join(seconds, "b").select("a", "b", "x", "y")
    return in_small_batches(met).mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """For every node of ``edges`` (a, b) its component, named by one of its nodes.

    Each round every node moves to the neighbour of least hash, itself included, and edges move along; hashes change
    with the round, so that chains of any shape shrink by a constant factor. Every round is a stored table.
    """
    moves = []
    while True:
        turn = F.lit(len(moves))
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, turn).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        move = stage(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(
            F.col("a").alias("v"), F.least("m", rank("a"))["v"].alias("to")), "moves")
        moves.append(move)
        of = lambda c: move.select(F.col("v").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        edges, left = stage_counted(edges.join(of("a"), "a").join(of("b"), "b").where("a_to <> b_to").select(
            F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        if not left:
            break
    out = moves[-1]
    for move in reversed(moves[:-1]):
        further = out.select(F.col("v").alias("to"), F.col("to").alias("end"))
        out = move.join(further, "to", "left").select("v", F.coalesce("end", "to").alias("to"))
    return stage(out, "components")


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, named by their smallest node, and the signed row of each of these."""
    key = ["n_shingles", "s1", "s2"]
    some = rows.where("n_shingles > 0")
    classes = some.groupBy(*key).agg(F.min("node").alias("rep"), F.min(F.coalesce("doc_id", "node")).alias("name"))
    short = F.transform("bands", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))
    own = some.join(classes, key).where("node = rep").dropDuplicates(["rep"])
    return classes, own.select("rep", F.struct(F.col("n_shingles").alias("n"), "planes", short.alias("bands")).alias("class"), "bands")


def buckets(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets (rep, place, band, first) that two classes or more share, and the classes in them with what they need."""
    banded = own.select("rep", F.posexplode("bands").alias("place", "band"))
    leaders = banded.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    shared = stage(banded.join(leaders.select("band", "first"), "band"), "buckets")
    return shared, stage(own.select("rep", "class").join(shared.select("rep").distinct(), "rep", "left_semi"), "classes")


def copy_labels(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, copy): documents that look like copies by bands and bit planes mostly have one label.

    A class has the label of the first class that it shares a bucket with, if the estimate allows it. Nothing is
    confirmed, so the labels count copies and decide nothing about a document.
    """
    rows = stage(signed(with_nodes(docs, id_col, text_col), words), "signed")
    classes, own = classes_of(rows)
    shared, signs = buckets(own)
    pairs = shared.groupBy("rep").agg(F.min("first").alias("a")).where("a <> rep")
    a = signs.select(F.col("rep").alias("a"), F.col("class").alias("class_a"))
    b = signs.select("rep", F.col("class").alias("class_b"))
    alike = pairs.join(a, "a").join(b, "rep").where(may_link("class_a", "class_b", percent)).select("rep", "a")
    named = classes.join(alike, "rep", "left").withColumn("copy", F.coalesce("a", "rep"))
    key = ["n_shingles", "s1", "s2"]
    named = named.select(*(F.col(k).alias(f"_{k}") for k in key), "copy")
    out = rows.select("doc_id", "text_key", "node", *key).join(named, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    return out.select("doc_id", "text_key", F.coalesce("copy", "node").alias("copy"))


def rare_pairs(rest: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) among the classes of ``rest`` (rep, part, largest) of which one is outside a largest component.

    Every pair as similar as the threshold is there, unless its classes are in one component.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, "text", limit=SIGN_BYTES)):
            found = [shingles(t, words) for t in values(batch, "text")]
            lens = np.array([len(x) for x in found], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint64), *found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(lens)), lens))), pa.array(np.repeat(lens, lens)),
                                              pa.array(flat.view(np.int64))], names=["rep", "size", "shingle"])

    members = rest.groupBy("rep").agg(F.max(F.col("part") != F.col("largest")).alias("outside"), F.first("part").alias("part"))
    posts = texts.withColumnRenamed("node", "rep").join(members.select("rep"), "rep", "left_semi").select("rep", "text")
    posts = stage(in_small_batches(posts).mapInArrow(each, "rep long, size long, shingle long"), "shingles")
    # A shingle of one class alone takes its place among the rarest, and meets nothing.
    often = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("often", "shingle"))
    ranked = posts.join(often, "shingle").withColumn("rank", rank).where("often > 1").select("rep", "size", "rank", "shingle")
    # Two sets share at least ``least`` shingles if they are similar: one of a larger set's ``size - least + 1`` rarest, and
    # two of its ``size - least + 2`` rarest. The shingles of short texts are common ones, so these meet on two.
    at_least = lambda size, share: F.ceil(size * share[0] / share[1]).cast("long")
    larger, smaller = (percent, 100), (2 * percent, 100 + percent)
    kept = ranked.where(F.col("rank") <= F.col("size") - at_least(F.col("size"), larger) + 2)
    short = kept.where(F.col("size") * percent <= SHORT * 100).groupBy("rep", "size").agg(
        F.array_sort(F.collect_list(F.struct("rank", "shingle"))).alias("rare"))
    two = F.flatten(F.transform("rare", lambda p, i: F.transform(F.slice("rare", i + 2, F.size("rare")), lambda q: F.struct(
        F.xxhash64(p["shingle"], q["shingle"]).alias("key"), q["rank"].alias("rank")))))
    keys = short.select("rep", "size", F.lit(2).alias("of"), F.inline(two)).unionByName(
        kept.where(F.col("size") > SHORT).where(F.col("rank") <= F.col("size") - at_least(F.col("size"), larger) + 1)
        .select("rep", "size", F.lit(1).alias("of"), F.col("shingle").alias("key"), "rank"))
    keys = stage(keys.join(members, "rep"), "rare")
    first = F.when(F.col("size") <= SHORT, F.col("of") == 2).otherwise(F.col("of") == 1)
    small = keys.where(first & (F.col("rank") <= F.col("size") - at_least(F.col("size"), smaller) + F.col("of")))
    named = lambda df, c: df.select("key", "of", F.struct("size", "rep").alias(c), F.col("rank").alias(f"rank_{c}"),
                                    F.col("outside").alias(f"out_{c}"), F.col("part").alias(f"part_{c}"))
    x, y = F.col("x.size"), F.col("y.size")
    room = F.col("of") + F.least(x - F.col("rank_x"), y - F.col("rank_y")) >= at_least(x + y, (percent, 100 + percent))
    fits = (F.col("x") < F.col("y")) & (x * 100 >= y * percent) & room
    met = named(small, "x").join(named(keys, "y"), ["key", "of"]).where(fits & (F.col("part_x") != F.col("part_y")) & (F.col("out_x") | F.col("out_y")))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Every row with its set size, its component (named by the smallest id), and whether it has that id (``kept``).

    ``first`` is true for one document of each component, also where ids are missing or shared.
    """
    named = with_nodes(docs, id_col, text_col)
    rows = stage(signed(named, words), "signed")
    key = ["n_shingles", "s1", "s2"]
    classes, own = classes_of(rows)
    shared, signs = buckets(own)
    members = shared.select(F.col("rep").alias("node")).distinct()
    texts = stage(named.select("node", "text").join(members, "node", "left_semi").dropDuplicates(["node"]), "texts")

    def sign(c: str) -> DataFrame:
        return signs.select(F.col("rep").alias(c), F.col("class").alias(f"class_{c}"))

    def linked(pairs: DataFrame) -> tuple[DataFrame, int]:
        likely = pairs.join(sign("a"), "a").join(sign("b"), "b").where(may_link("class_a", "class_b", percent)).select("a", "b")
        return stage_counted(confirmed(stage(likely, "pairs"), texts, words, percent), "links")

    # Each class with the first of the classes it shares a bucket with.
    links, n = linked(shared.groupBy("rep").agg(F.min("first").alias("a")).where("a <> rep").select("a", F.col("rep").alias("b")))
    labels = components(links) if n else links.select(F.col("a").alias("v"), F.col("b").alias("to"))
    # As long as it joins many: what is outside the largest component of a bucket with a few members of that one.
    turn = 0
    while True:
        places = shared.join(labels.select(F.col("v").alias("rep"), "to"), "rep", "left").select(
            "band", "rep", F.coalesce("to", "rep").alias("part"))
        any_of = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep"))["rep"].alias("one")
        sizes = places.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"), any_of)
        top = sizes.groupBy("band").agg(F.max(F.struct("n", "part", "one")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        rest = stage(places.join(top.select("band", F.col("top.part").alias("largest"), F.col("top.one").alias("one")), "band"), "rest")
        outside = rest.where("part <> largest").groupBy("rep").agg(F.array_sort(F.collect_set("one")).alias("ones"))
        outside, left = stage_counted(outside.select(F.explode(F.slice("ones", 1, TRIES)).alias("a"), F.col("rep").alias("b")), "outside")
        if not left:
            break
        new, m = linked(outside)
        if m:
            links = links.unionByName(new)
            labels = components(links)
        turn += 1
        if m * 10 < left:
            break
    # Every class that is still outside, with all classes of such buckets, by rare shingles.
    if left:
        parts_now = rest.drop("part").join(labels.select(F.col("v").alias("rep"), "to"), "rep", "left").withColumn("part", F.coalesce("to", "rep"))
        one_now = labels.select(F.col("v").alias("one"), F.col("to").alias("_one_to"))
        parts_now = parts_now.join(one_now, "one", "left").withColumn("largest", F.coalesce("_one_to", "one"))
        new, m = linked(rare_pairs(parts_now, texts, words, percent))
        if m:
            labels = components(links.unionByName(new))

    # From classes back to rows, each component named by its smallest id.
    named = classes.join(labels.select(F.col("v").alias("rep"), "to"), "rep", "left").withColumn("part", F.coalesce("to", "rep"))
    smallest = named.groupBy("part").agg(F.min("name").alias("component_id"), F.min("rep").alias("chosen"))
    named = named.join(smallest, "part").select(*(F.col(k).alias(f"_{k}") for k in key), "component_id", "chosen")
    out = rows.select("doc_id", "text_key", "node", *key).join(named, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    own_name = F.coalesce("doc_id", "node")
    component = F.coalesce("component_id", own_name)
    return out.select("doc_id", "text_key", "node", "n_shingles", component.alias("component_id"), (own_name == component).alias("kept"),
                      (F.col("node") == F.coalesce("chosen", "node")).alias("first"))
