"""Token ids in files of interleaved asymmetric numeral systems.

Documents stand in the files by ascending id, each one's token ids followed by an end id. One static table of
frequencies, counted over all ids and scaled to a power of two, lies beside the files and serves all blocks. A block is
a run of whole documents and is decoded without any other: its ids are dealt out to lanes in turn, each lane a state of
its own, and all lanes go forward together and share one stream of words. A file ends in checkpoints, which say where
each block begins and how many ids stand before it, so any block can be read alone; blocks, ids and the table carry
checksums.

A null text is empty and has the end id alone. Rows that share an id come in the order of a hash of their ids, repeated
rows each; rows without an id come first. An empty table makes no files. Other columns are not looked at.

Layout of a file, all numbers little-endian: ``HEAD``; then for each block ``BLOCK``, the packed list of its documents,
the states of its lanes (64 bits each), the words (32 bits each); then for each block ``CHECKPOINT``; then ``TAIL``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import filesystem, parts, per_batch
from tracelake.llm.token_ids import token_ids
from tracelake.operators.skew import running_sum
from tracelake.session import stage, stage_counted, staging_root

SCALE = 20                # frequencies add up to 2^20, far more than there are symbols
LOW = 31                  # states lie in [2^31, 2^63)
LANES = 1024
BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 26
LEAST_FILE = 1 << 18
MAGIC, TABLE_MAGIC, TAIL_MAGIC = b"TLTOKEN1", b"TLFREQS1", b"TLENDED1"
HEAD = struct.Struct("<8sI")               # sign, checksum of the table
BLOCK = struct.Struct("<QQQIIII")          # ids, documents, words, lanes, bytes of the list, checksum of the ids, of the body
CHECKPOINT = struct.Struct("<QQQ")         # offset and size of the block, ids before it
TAIL = struct.Struct("<QQI8s")             # blocks, ids of the file, checksum of the checkpoints, sign
TABLE_NAME = "frequencies.bin"
FILES = "path string, number int, blocks long, tokens long"
BLOCKS = "number int, path string, offset long, size long, before long, tokens long"
READ = "doc_id long, start long, n_tokens long, ids binary"


class Table(NamedTuple):
    """Symbols with their frequencies, ascending; frequencies add up to ``1 << SCALE``."""

    symbols: np.ndarray
    freqs: np.ndarray

    def packed(self) -> bytes:
        body = zlib.compress(self.symbols.astype("<u4").tobytes() + self.freqs.astype("<u4").tobytes())
        return TABLE_MAGIC + struct.pack("<II", len(self.symbols), zlib.crc32(body)) + body

    @staticmethod
    def unpacked(data: bytes) -> Table:
        n, told = struct.unpack_from("<II", data, len(TABLE_MAGIC))
        body = data[len(TABLE_MAGIC) + 8:]
        if not data.startswith(TABLE_MAGIC) or zlib.crc32(body) != told:
            raise ValueError("damaged table of frequencies")
        both = np.frombuffer(zlib.decompress(body), "<u4")
        return Table(both[:n].astype(np.uint32), both[n:].astype(np.uint64))

    def before(self) -> np.ndarray:
        return (np.cumsum(self.freqs) - self.freqs).astype(np.uint64)


def scaled(counts: dict[int, int], scale: int = SCALE) -> Table:
    """Frequencies in proportion to counts, at least one each."""
    if len(counts) > 1 << scale:
        raise ValueError("more symbols than frequencies")
    symbols = np.array(sorted(counts), np.uint32)
    exact = np.array([counts[int(s)] for s in symbols], np.float64)
    freqs = np.maximum(1, np.floor(exact * ((1 << scale) / exact.sum()))).astype(np.int64)
    left = (1 << scale) - int(freqs.sum())
    order = np.argsort(-exact, kind="stable")
    if left > 0:
        freqs[order[0]] += left
    for i in order:       # what the rare ones got too much is taken from the frequent ones
        if left >= 0:
            break
        taken = min(-left, int(freqs[i]) - 1)
        freqs[i] -= taken
        left += taken
    return Table(symbols, freqs.astype(np.uint64))


class Coder:
    """Encodes and decodes runs of symbols with one table."""

    def __init__(self, table: Table):
        self.table, self.below = table, table.before()
        self.index = np.zeros(int(table.symbols.max()) + 1, np.int64)
        self.index[table.symbols] = np.arange(len(table.symbols))
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.table.symbols), dtype=np.int32), self.table.freqs.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """States and words of ``ids`` dealt out to ``lanes``; the last round is filled up with the commonest symbol."""
        rounds = -(-len(ids) // lanes)
        places = np.full(rounds * lanes, int(np.argmax(self.table.freqs)), np.int64)
        places[:len(ids)] = self.index[ids]
        places = places.reshape(rounds, lanes)
        states, words = np.full(lanes, 1 << LOW, np.uint64), []
        room, half, low, shift = np.uint64(LOW - SCALE + 32), np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(SCALE)
        for at in places[::-1]:
            freq = self.table.freqs[at]
            full = states >= (freq << room)
            words.append((states[full] & low).astype("<u4"))
            states = np.where(full, states >> half, states)
            quotient = states // freq
            states = (quotient << shift) + (states - quotient * freq) + self.below[at]
        return states, np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")

    def decode(self, n: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        lanes = len(states)
        rounds = -(-n // lanes)
        out, at, states = np.empty((rounds, lanes), np.int32), 0, states.astype(np.uint64)
        mask, shift, half, least = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32), np.uint64(1 << LOW)
        for r in range(rounds):
            slot = states & mask
            symbol = self.slots[slot]
            out[r] = symbol
            states = self.table.freqs[symbol] * (states >> shift) + slot - self.below[symbol]
            short = np.flatnonzero(states < least)
            if at + len(short) > len(words):
                raise ValueError("damaged block: words are missing")
            states[short] = (states[short] << half) | words[at:at + len(short)]
            at += len(short)
        if at != len(words) or (states != least).any():
            raise ValueError("damaged block: states do not end as they began")
        return self.table.symbols[out.ravel()[:n]]


def packed_block(coder: Coder, docs: list[int | None], lens: list[int], ids: np.ndarray) -> bytes:
    named = np.array([0 if d is None else d for d in docs], "<i8").tobytes()
    listed = zlib.compress(named + np.array([d is None for d in docs], "u1").tobytes() + np.array(lens, "<u8").tobytes(), 1)
    states, words = coder.encode(ids, max(1, min(LANES, len(ids) // 64)))
    body = listed + states.astype("<u8").tobytes() + words.tobytes()
    return BLOCK.pack(len(ids), len(docs), len(words), len(states), len(listed), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def unpacked_block(coder: Coder, data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents of a block, the lengths and ids of them."""
    n, docs, n_words, lanes, listed, told, body = BLOCK.unpack_from(data)
    at = BLOCK.size
    if zlib.crc32(memoryview(data)[at:]) != body:
        raise ValueError("damaged block: body")
    plain = zlib.decompress(data[at:at + listed])
    names, nameless = np.frombuffer(plain, "<i8", docs), np.frombuffer(plain, "u1", docs, 8 * docs)
    lens = np.frombuffer(plain, "<u8", docs, 9 * docs).astype(np.int64)
    states = np.frombuffer(data, "<u8", lanes, at + listed)
    ids = coder.decode(n, states, np.frombuffer(data, "<u4", n_words, at + listed + 8 * lanes))
    if zlib.crc32(ids.astype("<u4").tobytes()) != told:
        raise ValueError("damaged block: ids")
    return [None if x else int(d) for d, x in zip(names, nameless)], lens, ids


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Every row's id, a number of its own, and its token ids, in two bytes each where the vocabulary allows."""
    def ids_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = token_ids(tokenizer)
        narrow = np.uint16 if max(known.size, end_id + 1) <= 1 << 16 else np.uint32
        ids, ends = known.encode(batch.column(1), end_id)
        data, width = ids.astype(narrow).tobytes(), np.dtype(narrow).itemsize
        begins = np.concatenate([[0], ends[:-1]])
        cut = pa.array([data[b * width:e * width] for b, e in zip(begins, ends)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), cut, pa.array(ends - begins), pa.array(np.full(len(ends), width, np.int32))],
                                          names=["doc_id", "ids", "n", "width"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return per_batch(rows, ids_of, "doc_id long, ids binary, n long, width int").withColumn("row", F.monotonically_increasing_id())


def unpacked_ids(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}").astype(np.uint32)


def counted(rows: DataFrame) -> dict[int, int]:
    """How often each token id stands in ``rows``: at most as many as the vocabulary has."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in (p for b in batches for p in parts(b, "ids")):
            for width in set(batch.column(1).to_pylist()):
                data = b"".join(x for x, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w == width)
                got = np.bincount(unpacked_ids(data, width))
                size = max(len(total), len(got))
                total = np.pad(total, (0, size - len(total))) + np.pad(got, (0, size - len(got)))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["id", "n"])

    sums = rows.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in sums.collect()}


class Writer:
    """Writes one file, block by block, and moves it into place when it is closed."""

    def __init__(self, folder: str, number: int, attempt: int, table: bytes):
        self.fs, root = filesystem(folder)
        name = f"part-{number:06d}.ids"
        self.draft, self.place, self.path, self.number = f"{root}/.draft-{number}-{attempt}", f"{root}/{name}", f"{folder}/{name}", number
        self.root, self.table, self.coder = root, table, Coder(Table.unpacked(table))
        self.out: pa.NativeFile | None = None
        self.points: list[tuple[int, int, int]] = []
        self.at, self.tokens = HEAD.size, 0
        self.begin()

    def begin(self) -> None:
        self.docs: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_TOKENS:
            self.block()

    def block(self) -> None:
        if self.out is None:
            self.fs.create_dir(self.root, recursive=True)
            self.out = self.fs.open_output_stream(self.draft, compression=None)
            self.out.write(HEAD.pack(MAGIC, zlib.crc32(self.table)))
        data = packed_block(self.coder, self.docs, list(map(len, self.ids)), np.concatenate(self.ids))
        self.out.write(data)
        self.points.append((self.at, len(data), self.tokens))
        self.at, self.tokens = self.at + len(data), self.tokens + self.held
        self.begin()

    def close(self) -> list[tuple[str, int, int, int]]:
        if self.docs:
            self.block()
        if self.out is None:
            return []
        listed = b"".join(CHECKPOINT.pack(*p) for p in self.points)
        self.out.write(listed + TAIL.pack(len(self.points), self.tokens, zlib.crc32(listed), TAIL_MAGIC))
        self.out.close()
        self.fs.move(self.draft, self.place)
        return [(self.path, self.number, len(self.points), self.tokens)]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token ids of all ``docs`` into files in ``folder``, by ascending id, and return the list of files.

    A file is one range of ids, named by its place among the ranges and moved into place when complete, so a task that is
    run again replaces its file.
    """
    spark = docs.sparkSession
    rows = stage(tokenized(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    counts = counted(rows)
    if not counts:
        return spark.createDataFrame([], FILES)
    table = scaled(counts)
    packed = table.packed()
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{TABLE_NAME}", compression=None) as out:
        out.write(packed)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        file = Writer(folder, context.partitionId(), context.taskAttemptId(), packed)
        for batch in (p for b in batches for p in parts(b, "ids")):
            for doc, ids, width in zip(*(batch.column(i).to_pylist() for i in range(3))):
                file.add(doc, unpacked_ids(ids, width))
        done = file.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(
            (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in FILES.split(", ")])

    tokens = sum(counts.values())
    files = max(-(-tokens // FILE_TOKENS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // LEAST_FILE)))
    # The number of the row splits rows of one id, which no range of ids could.
    keys = [F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("row")]
    ranged = rows.withColumn("tie", F.xxhash64("ids")).repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    return stage(ranged.select("doc_id", "ids", "width").mapInArrow(write, FILES), "token-files")


@lru_cache(maxsize=4)
def coder_of(folder: str, checksum: int) -> Coder:
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{TABLE_NAME}") as file:
        data = file.read()
    if zlib.crc32(data) != checksum:
        raise ValueError("the table of frequencies is not that of the files")
    return Coder(Table.unpacked(data))


def checkpoints(path: str) -> list[tuple[int, int, int, int]]:
    """Blocks of a file: offset, size, ids before, ids of the whole file."""
    fs, name = filesystem(path)
    with fs.open_input_file(name) as file:
        end = file.size()
        file.seek(end - TAIL.size)
        blocks, tokens, told, sign = TAIL.unpack(file.read(TAIL.size))
        if sign != TAIL_MAGIC:
            raise ValueError(f"{path} is cut off")
        file.seek(end - TAIL.size - blocks * CHECKPOINT.size)
        listed = file.read(blocks * CHECKPOINT.size)
    if zlib.crc32(listed) != told:
        raise ValueError(f"damaged checkpoints of {path}")
    return [(*p, tokens) for p in CHECKPOINT.iter_unpack(listed)]


def read_block(path: str, offset: int, size: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents of the block at a checkpoint, the lengths and ids of them."""
    fs, name = filesystem(path)
    with fs.open_input_file(name) as file:
        sign, table = HEAD.unpack(file.read(HEAD.size))
        if sign != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        file.seek(offset)
        data = file.read(size)
    return unpacked_block(coder_of(path.rpartition("/")[0], table), data)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files in ``folder``: its id, the number of ids before it, and its own ids.

    Files are listed, their checkpoints read, and blocks dealt out to be decoded independently.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder).select("path")

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(int(p.rpartition("-")[2].removesuffix(".ids")), p, *x) for p in batch.column(0).to_pylist() for x in checkpoints(p)]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                             names=[x.split()[0] for x in BLOCKS.split(", ")])

    blocks, n = stage_counted(files.mapInArrow(points, BLOCKS), "checkpoints")
    totals = blocks.where("before = 0").select("number", "tokens").distinct()
    starts = running_sum(totals, [], F.floor(F.col("number") / 1000), [F.col("number")], F.col("tokens"), "until").select(
        "number", (F.col("until") - F.col("tokens")).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, lens, ids = read_block(row["path"], row["offset"], row["size"])
                ends = np.cumsum(lens)
                plain = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(row["first"] + row["before"] + ends - lens), pa.array(lens),
                     pa.array([plain[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), lens.tolist())], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    # Blocks are little to send and much to read: a few of them to a task, and enough tasks for all cores.
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, n // 256)))
    return blocks.join(starts, "number").drop("tokens").repartition(tasks, "path", "offset").mapInArrow(read, READ)


def token_files(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Write ``docs`` to files of token ids in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = f"{staging_root(spark)}/tracelake-tokens-{uuid.uuid4().hex}"
    if not write_token_files(docs, folder, tokenizer, end_id, id_col, text_col).limit(1).count():
        return spark.createDataFrame([], READ)
    return read_token_files(spark, folder)
