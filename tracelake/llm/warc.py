"""Archives of web pages: a writer of one compressed member per record and a splittable reader.

A reading task gets a byte range of an archive. It looks for the sign that starts a compressed member, decodes what
follows far enough to see the headers of a record, and takes the record if it starts inside the range, reading past the
range's end where the record does. So every record is read by exactly one task, whatever the ranges, and archives need
no index. A sign inside compressed data does not decode to such headers.

Pages with equal payloads of at least ``least`` bytes are stored once: the one with the smallest id is the response,
the others refer to it. Ids that are null come last; pages that share the smallest id are all responses. A null html
is an empty payload, a null url an empty address. Empty tables make no archives and no records; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import filesystem, parts, utf8
from tracelake.session import stage, stage_counted, staging_root

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
READ = 1 << 18
NIL = -1
RECORDS = ("path string, offset long, page_id long, uri string, record_type string, refers_to long, payload_digest string, "
           "payload_bytes long, payload binary")
WRITTEN = "path string, records long, bytes long"


def record(page_id: int | None, url: str, payload: bytes, digest: str, response_id: int | None, size: int) -> bytes:
    """One record as a compressed member; ``response_id`` makes it a revisit, whose payload is left out."""
    revisit = response_id is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    heads = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
             "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}",
             f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {name}"]
    if revisit:
        heads += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"X-Refers-To-Page: {response_id}"]
    heads += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def with_roles(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages with payload, digest, and the id of the response they revisit, if they do."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        utf8("html").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # One id for each digest, combined before the shuffle, so that many equal pages are a few rows.
    first = (rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("digest").alias("_digest"), "first"))
    rows = rows.join(first, F.col("digest") == F.col("_digest"), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "digest", "size", F.when(other, F.col("first")).alias("refers_to"),
                       F.when(other, F.lit(b"").cast("binary")).otherwise(F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, folder: str, least: int = 100, max_bytes: int = 1 << 30) -> DataFrame:
    """Write ``pages`` as archives into ``folder`` and return the list of files.

    A file is named after its partition and moved into place when complete, so a task that is run again replaces its
    files and leaves no second copy. The list is stored, so that reading it does not write again.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, done, number, size, n = None, [], 0, 0, 0
        draft = f"{root}/.draft-{context.partitionId()}-{context.taskAttemptId()}"

        def close() -> None:
            nonlocal out, number, size, n
            out.close()
            name = f"part-{context.partitionId():05d}-{number:03d}.warc.gz"
            fs.move(draft, f"{root}/{name}")
            done.append((f"{folder}/{name}", n, size))
            out, number, size, n = None, number + 1, 0, 0

        for batch in (p for b in batches for p in parts(b, "payload", "url")):
            for row in batch.to_pylist():
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["size"])
                if out is None:
                    out = fs.open_output_stream(draft, compression=None)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= max_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["path", "records", "bytes"])

    return stage(with_roles(pages, least).mapInArrow(write, WRITTEN), "archives")


def headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Member:
    """A compressed member that starts at an offset, decoded piece by piece."""

    def __init__(self, file: pa.NativeFile, offset: int):
        self.file, self.at = file, offset
        self.unpack = zlib.decompressobj(31)
        self.rest = bytearray()

    def more(self) -> bytes:
        """The next decoded bytes; none at the member's end. At most a few times ``READ`` are held."""
        while not self.unpack.eof:
            if not (data := self.unpack.unconsumed_tail):
                self.file.seek(self.at)
                data = self.file.read(READ)
                if not data:
                    raise zlib.error("cut off")
                self.at += len(data)
            if out := self.unpack.decompress(data, 4 * READ):
                return out
        return b""

    def head(self) -> dict[str, str] | None:
        """The record's headers, however long, or None if this is no record; a record that breaks off is an error."""
        end, searched = -1, 0
        try:
            while end < 0:
                if len(self.rest) >= len(VERSION) and not self.rest.startswith(b"WARC/"):
                    return None
                if not (out := self.more()):
                    raise zlib.error("no end of headers")
                self.rest += out
                end = self.rest.find(b"\r\n\r\n", searched)
                searched = max(0, len(self.rest) - 3)
        except zlib.error as e:
            if self.rest.startswith(b"WARC/"):
                raise ValueError(f"damaged record: {e}") from e
            return None
        head, self.rest = bytes(self.rest[:end]), bytes(self.rest[end + 4:])
        return headers(head) if head.startswith(b"WARC/") else None

    def block(self) -> Iterator[bytes]:
        if self.rest:
            yield bytes(self.rest)
        while out := self.more():
            yield out

    def end(self) -> int:
        return self.at - len(self.unpack.unused_data)


def read_record(member: Member, head: dict[str, str], payloads: bool) -> tuple:
    """Fields of a record; the payload is checked against its digest and only kept if asked for."""
    left = int(head["content-length"])
    start, http, kept, digest, size = b"", None, [], hashlib.sha256(), 0
    for data in member.block():
        data, left = data[:left], left - min(left, len(data))
        if http is None:
            start += data
            if b"\r\n\r\n" not in start:
                continue
            http, _, data = start.partition(b"\r\n\r\n")
        digest.update(data)
        size += len(data)
        if payloads:
            kept.append(data)
    revisit = head["warc-type"] == "revisit"
    told = head["warc-payload-digest"].removeprefix("sha256:")
    if left or not revisit and digest.hexdigest() != told:
        raise ValueError(f"damaged record {head.get('warc-record-id')}")
    page = None if head["x-page-id"] == "null" else int(head["x-page-id"])
    refers = int(head["x-refers-to-page"]) if revisit else None
    size = int(headers(http or b"")["content-length"]) if revisit else size
    return page, head.get("warc-target-uri", ""), head["warc-type"], refers, told, size, b"".join(kept) if payloads else None


def starts(file: pa.NativeFile, begin: int, end: int) -> Iterator[int]:
    """Offsets in a range where the sign of a member stands."""
    at = begin
    while at < end:
        file.seek(at)
        data = file.read(min(READ, end - at) + len(MAGIC) - 1)
        if len(data) < len(MAGIC):
            return
        i = data.find(MAGIC)
        while i >= 0 and at + i < end:
            yield at + i
            i = data.find(MAGIC, i + 1)
        at += min(READ, end - at)


def records_in(path: str, begin: int, end: int, payloads: bool) -> Iterator[tuple]:
    """Records that start in a byte range of an archive."""
    fs, name = filesystem(path)
    with fs.open_input_file(name) as file:
        past = begin
        while past < end:
            for offset in starts(file, past, end):
                member = Member(file, offset)
                head = member.head()
                if head is not None and "content-length" in head:
                    break
            else:
                return
            yield path, offset, *read_record(member, head, payloads)
            past = member.end()


def splits(files: DataFrame, split_bytes: int) -> DataFrame:
    """Byte ranges of files given as (path, length)."""
    return (files.where("length > 0")
            .select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("begin"))
            .select("path", "begin", F.least(F.col("begin") + split_bytes, "length").alias("end")))


def read_archives(spark: SparkSession, folder: str, split_bytes: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``folder``, read by byte ranges."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true")
             .load(folder).select("path", "length"))  # the listing only: contents are not read
    ranges = splits(files, split_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                for got in records_in(r["path"], r["begin"], r["end"], payloads):
                    rows.append(got)
                    size += 200 + len(got[-1] or b"")
                    if size > 8 << 20:
                        yield packed(rows)
                        rows, size = [], 0
        yield packed(rows)

    # A range is little to send and much to read: a few of them to a task, and enough tasks for all cores.
    ranges, n = stage_counted(ranges, "ranges")
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, n // 16)))
    return ranges.repartition(tasks, F.col("path"), F.col("begin")).mapInArrow(read, RECORDS)


def archived_pages(pages: DataFrame, split_bytes: int = 16 << 20, least: int = 100) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back by byte ranges."""
    spark = pages.sparkSession
    folder = f"{staging_root(spark)}/tracelake-warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("/"):
        folder = f"/{folder}"
    if write_archives(pages, folder, least).limit(1).count() == 0:
        return spark.createDataFrame([], RECORDS)
    return read_archives(spark, folder, split_bytes, payloads=False)
