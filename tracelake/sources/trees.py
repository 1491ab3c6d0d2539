"""Archives as trees of files: a source that lists and reads them, and a sink for documents.

Spark's file source hides names that start with a dot, which here are trash and seals, and lists on the driver. This
source shows every name and lists in its tasks: a partition is a share of one year's sessions, of an archive's assets,
or of its code store. A filter on ``archive`` or ``year`` leaves whole partitions out.

Layout below the root: ``<archive>/data/<year>/<session>/...`` with ``.trash`` folders and one ``.seal.yaml`` a year,
``<archive>/assets/<asset>/...``, ``<archive>/code/manifests/...`` and ``<archive>/code/blobs/...``.

Files may lie in packs: a pack is a Parquet file, written by one task, that holds files below the folder it lies in by
their paths, so that a record of some hundred bytes takes no file of its own. Both forms are listed alike.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

from tracelake.functions import ids
from tracelake.functions.text import SIDECAR_SUFFIX
from tracelake.sources.documents import ANNOTATIONS_FILE, ASSET_FILE, DATA_FOLDER, SESSION_FILE, TRASH_FOLDER

FORMAT = "archive_tree"
# Names in an archive.
SEAL_FILE = ".seal.yaml"
ASSETS, CODE, MANIFESTS, BLOBS = "assets", "code", "manifests", "blobs"
#: A row is a file, or with a null name a folder. ``owner`` is the session, the asset or the part of the code store.
ROW = ("archive string, area string, year int, owner string, trashed boolean, name string, path string, size bigint, "
       "mtime timestamp, content string")
ROWS = pa.schema([(n, pa.string()) for n in ("archive", "area")] + [("year", pa.int32()), ("owner", pa.string()), ("trashed", pa.bool_())] + [
    (n, pa.string()) for n in ("name", "path")] + [("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("content", pa.string())])
RECORDS = (SESSION_FILE, ANNOTATIONS_FILE, ASSET_FILE, SEAL_FILE)
PACK, DRAFT = ".pack-", ".draft-"
PACKED = pa.schema([("path", pa.string()), ("content", pa.string()), ("size", pa.int64())])
#: The folders that may hold packs, and what a path below one of them says.
PACK_FOLDER = rf"^(?P<folder>[^/]+/(?:{DATA_FOLDER}/[0-9]+|{ASSETS}|{CODE}/[^/]+))/+(?P<rest>.+)$"
PACK_PLACE = rf"^(?:(?P<owner>[^/]+)/)?(?P<trash>{TRASH_FOLDER.replace(".", "[.]")}/)?(?P<name>[^/]+)$"
#: Most bytes of a pack, of one folder's and of all files that a task holds before it writes them, and most packs it holds open.
PACK_BYTES, GROUP_BYTES, HELD_BYTES, OPEN_PACKS = 128 << 20, 4 << 20, 64 << 20, 256


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, sign, rest = path.partition("://")
    if not sign:
        return pafs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + sign + rest)


def listed(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return sorted(fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.base_name)


def is_document(name: str, area: str, owner: str | None) -> bool:
    """Whether a file is a record, which is small and whose content is wanted."""
    if area == CODE:
        return owner == MANIFESTS
    return name in RECORDS or name.endswith(SIDECAR_SUFFIX)


def is_pack(info: pafs.FileInfo) -> bool:
    return info.type == pafs.FileType.File and info.base_name.startswith(PACK)


@dataclass
class Share(InputPartition):
    """Every entry of a folder whose name falls to this one of ``of`` shares."""

    archive: str
    area: str
    year: int | None
    number: int
    of: int


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.shares = int(options.get("shares", "8"))
        self.content = options.get("content", "false").lower() == "true"
        self.tests: list[Filter] = []
        self.area, self.suffix = options.get("area", ""), options.get("suffix", "")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("year",), ("archive",)):
                self.tests.append(f)
            else:
                yield f

    def wanted(self, archive: str, year: int | None) -> bool:
        for f in self.tests:
            v = archive if f.attribute == ("archive",) else year
            if v is None:
                return False
            ok = {EqualTo: lambda: v == f.value, In: lambda: v in f.value, GreaterThan: lambda: v > f.value,
                  GreaterThanOrEqual: lambda: v >= f.value, LessThan: lambda: v < f.value, LessThanOrEqual: lambda: v <= f.value}
            if not ok[type(f)]():
                return False
        return True

    def partitions(self) -> list[Share]:
        """Shares of the years, assets and stores there are; sessions and files are listed by the tasks."""
        fs, root = filesystem(self.path)
        out = []
        for archive in listed(fs, root):
            if archive.type != pafs.FileType.Directory or archive.base_name.startswith("."):
                continue
            name = archive.base_name
            years = [int(y.base_name) for y in listed(fs, f"{root}/{name}/{DATA_FOLDER}") if y.base_name.isdigit() and y.type == pafs.FileType.Directory]
            places = [(DATA_FOLDER, y) for y in years] + [(ASSETS, None), (CODE, None)]
            places = [(area, y) for area, y in places if self.area in ("", area)]
            out += [Share(name, area, year, k, self.shares) for area, year in places if self.wanted(name, year) for k in range(self.shares)]
        return out or [Share("", DATA_FOLDER, 0, 0, 1)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        loose = []
        for found in self.found(share):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            if found is None:
                continue
            loose.append(dict(zip(ROWS.names, found, strict=True)))
            if len(loose) == 1000:
                yield pa.RecordBatch.from_pylist(loose, ROWS)
                loose = []
        if loose:
            yield pa.RecordBatch.from_pylist(loose, ROWS)

    def found(self, share: Share) -> Iterator[tuple | pa.RecordBatch | None]:
        """A row for each file and folder of a share, and what its packs hold."""
        fs, root = filesystem(self.path)
        base = f"{root}/{share.archive}/{share.area}"
        mine = lambda name: zlib.crc32(name.encode()) % share.of == share.number
        if not share.archive:
            return
        if share.area == CODE:
            for owner in (MANIFESTS, BLOBS):
                for info in listed(fs, f"{base}/{owner}"):
                    if mine(info.base_name):
                        yield from self.packed(fs, share, owner, info) if is_pack(info) else self.below(fs, share, owner, info, False)
            return
        for info in listed(fs, base if share.year is None else f"{base}/{share.year}"):
            if not mine(info.base_name):
                continue
            if is_pack(info):
                yield from self.packed(fs, share, None, info)
                continue
            if info.type == pafs.FileType.File:
                yield self.row(fs, share, None, info, False)
                continue
            owner = info.base_name
            yield self.row(fs, share, owner, info, False)
            for inner in listed(fs, info.path):
                if inner.base_name == TRASH_FOLDER and inner.type == pafs.FileType.Directory:
                    for gone in listed(fs, inner.path):
                        yield from self.below(fs, share, owner, gone, True)
                else:
                    yield from self.below(fs, share, owner, inner, False)

    def below(self, fs: pafs.FileSystem, share: Share, owner: str, info: pafs.FileInfo, trashed: bool) -> Iterator[tuple]:
        if info.type == pafs.FileType.File:
            yield self.row(fs, share, owner, info, trashed)
        elif share.area == CODE:            # blobs may lie in folders named after their first letters
            for inner in listed(fs, info.path):
                yield from self.below(fs, share, owner, inner, trashed)

    def packed(self, fs: pafs.FileSystem, share: Share, part: str | None, pack: pafs.FileInfo) -> Iterator[pa.RecordBatch]:
        """The files of a pack, and a row for each folder they lie in; ``part`` is the part of the code store."""
        base = pack.path.rpartition("/")[0]
        when = datetime.fromtimestamp((pack.mtime_ns or 0) / 1e9, timezone.utc)
        wants = self.content and (share.area != CODE or part == MANIFESTS)
        owners: set[str] = set()
        with fs.open_input_file(pack.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=10000, columns=["path", "size"] + ["content"] * wants):
                path, n = batch.column("path"), batch.num_rows
                if share.area == CODE:
                    owner, trashed, name = pa.repeat(pa.scalar(part), n), pa.repeat(False, n), pc.replace_substring_regex(path, "^.*/", "")
                else:
                    at = pc.extract_regex(path, PACK_PLACE)
                    owner, trash, name = (pc.struct_field(at, k) for k in ("owner", "trash", "name"))
                    owner, trashed = pc.if_else(pc.equal(owner, ""), None, owner), pc.not_equal(trash, "")
                    if not self.suffix:
                        below = pc.unique(pc.replace_substring_regex(pc.filter(path, pc.match_substring(path, "/")), "/.*$", ""))
                        owners.update(below.to_pylist())
                record = pa.repeat(True, n) if share.area == CODE else pc.or_(
                    pc.is_in(name, pa.array(RECORDS)), pc.fill_null(pc.ends_with(name, SIDECAR_SUFFIX), False))
                content = pc.if_else(record, batch.column("content"), None) if wants else pa.nulls(n, pa.string())
                rows = pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(share.archive, pa.string()), n), pa.repeat(pa.scalar(share.area, pa.string()), n),
                    pa.repeat(pa.scalar(share.year, pa.int32()), n), owner, trashed, name,
                    pc.binary_join_element_wise(pa.scalar(base), path, "/"), batch.column("size"),
                    pa.repeat(pa.scalar(when, pa.timestamp("us", "UTC")), n), content], schema=ROWS)
                yield rows.filter(pc.fill_null(pc.ends_with(name, self.suffix), False))
        names = sorted(owners)
        for k in range(0, len(names), 10000):
            yield pa.RecordBatch.from_pylist([{"archive": share.archive, "area": share.area, "year": share.year, "owner": o, "trashed": False,
                                               "path": f"{base}/{o}"} for o in names[k:k + 10000]], ROWS)

    def row(self, fs: pafs.FileSystem, share: Share, owner: str | None, info: pafs.FileInfo, trashed: bool) -> tuple | None:
        folder = info.type == pafs.FileType.Directory
        if self.suffix and (folder or not info.base_name.endswith(self.suffix)):
            return None
        content = None
        if self.content and not folder and is_document(info.base_name, share.area, owner):
            with fs.open_input_stream(info.path) as file:
                content = file.read().decode("utf-8", "replace")
        when = None if folder else datetime.fromtimestamp((info.mtime_ns or 0) / 1e9, timezone.utc)
        return (share.archive, share.area, share.year, owner, trashed, None if folder else info.base_name, info.path,
                None if folder else info.size, when, content)


@dataclass
class Written(WriterCommitMessage):
    journal: str
    documents: int


class DocumentWriter(DataSourceWriter):
    """Writes (path, content) rows as files below the root.

    Each file is moved into place when it is complete, so a task that is run again replaces what it wrote before. A task
    leaves a journal of its files; a job that fails as a whole removes them by it, one that succeeds the journals.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = filesystem(self.path)
        made, folders = [], set()
        for row in rows:
            place = f"{root}/{row.path}"
            folder, _, name = place.rpartition("/")
            if folder not in folders:
                fs.create_dir(folder, recursive=True)
                folders.add(folder)
            draft = f"{folder}/{DRAFT}{context.taskAttemptId()}-{name}"
            with fs.open_output_stream(draft, compression=None) as out:
                out.write((row.content or "").encode())
            fs.move(draft, place)
            made.append(row.path)
        journal = f"{root}/.journal-{self.job}-{context.partitionId()}"
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(journal, compression=None) as out:
            out.write("\n".join(made).encode())
        return Written(journal, len(made))

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.journal)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m is None:
                continue
            with fs.open_input_stream(m.journal) as file:
                for name in filter(None, file.read().decode().split("\n")):
                    fs.delete_file(f"{root}/{name}")
            fs.delete_file(m.journal)


@dataclass
class WrittenPacks(WriterCommitMessage):
    drafts: list[str]


class PackWriter(DataSourceArrowWriter):
    """Writes (path, content) rows into packs, some for each folder and task; no path may be given twice.

    Packs are drafts until the whole job commits and gives them their names, which is a rename for each pack.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenPacks:
        fs, root = filesystem(self.path)
        out = Packs(fs, root)
        for batch in batches:
            out.add(batch)
        return out.closed()

    def commit(self, messages: list[WrittenPacks | None]) -> None:
        fs, _ = filesystem(self.path)
        for draft in (d for m in messages if m is not None for d in m.drafts):
            folder, _, name = draft.rpartition("/")
            fs.move(draft, f"{folder}/{PACK}{name.removeprefix(DRAFT)}")

    def abort(self, messages: list[WrittenPacks | None]) -> None:
        fs, _ = filesystem(self.path)
        for draft in (d for m in messages if m is not None for d in m.drafts):
            fs.delete_file(draft)


class Packs:
    """The packs one task writes: at most one open for each folder, a group of rows at a time."""

    def __init__(self, fs: pafs.FileSystem, root: str):
        self.fs, self.root = fs, root
        self.held: dict[str, list[pa.Table]] = {}
        self.bytes: dict[str, int] = {}
        self.open: dict[str, tuple[pq.ParquetWriter, pafs.NativeFile]] = {}
        self.written: dict[str, int] = {}
        self.drafts: list[str] = []

    def add(self, batch: pa.RecordBatch) -> None:
        path, content = pc.fill_null(batch.column("path"), ""), pc.fill_null(batch.column("content"), "")
        at = pc.extract_regex(path, PACK_FOLDER)
        # What lies in none of these folders is kept at the root by its whole path.
        folder = pc.fill_null(pc.struct_field(at, "folder"), "").dictionary_encode()
        rest = pc.coalesce(pc.struct_field(at, "rest"), path)
        rows = pa.Table.from_arrays([pc.replace_substring_regex(rest, "/+", "/"), content, pc.cast(pc.binary_length(content), pa.int64())], schema=PACKED)
        order = pc.sort_indices(folder.indices)
        rows, begin = rows.take(order), 0
        counts = {c["values"]: c["counts"] for c in pc.value_counts(folder.indices).to_pylist()}
        for code, name in enumerate(folder.dictionary.to_pylist()):
            part = rows.slice(begin, counts[code])
            begin += counts[code]
            self.held.setdefault(name, []).append(part)
            self.bytes[name] = self.bytes.get(name, 0) + part.get_total_buffer_size() * part.num_rows // max(1, rows.num_rows)
            if self.bytes[name] > GROUP_BYTES:
                self.flush(name)
        if sum(self.bytes.values()) > HELD_BYTES:
            for name in [*self.held]:
                self.flush(name)

    def flush(self, name: str) -> None:
        rows, size = pa.concat_tables(self.held.pop(name)), self.bytes.pop(name)
        if name not in self.open:
            if len(self.open) >= OPEN_PACKS:
                self.close()
            folder = f"{self.root}/{name}".rstrip("/")
            self.fs.create_dir(folder, recursive=True)
            self.drafts.append(f"{folder}/{DRAFT}{uuid.uuid4().hex}")
            stream = self.fs.open_output_stream(self.drafts[-1], compression=None)
            self.open[name], self.written[name] = (pq.ParquetWriter(stream, PACKED, compression="zstd"), stream), 0
        self.open[name][0].write_table(rows)
        self.written[name] += size
        if self.written[name] > PACK_BYTES:
            self.close(name)

    def close(self, *names: str) -> None:
        for name in names or [*self.open]:
            for end in self.open.pop(name):
                end.close()

    def closed(self) -> WrittenPacks:
        for name in [*self.held]:
            self.flush(name)
        self.close()
        return WrittenPacks(self.drafts)


class ArchiveTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if overwrite:
            raise ValueError("documents are added to a tree; take another folder for another tree")
        return (PackWriter if self.options.get("packed", "false").lower() == "true" else DocumentWriter)(dict(self.options))


def read_tree(spark: SparkSession, path: str, content: bool = False, shares: int = 8, area: str = "", suffix: str = "") -> DataFrame:
    """Every file and folder of the archives below ``path``, with the content of records if asked for.

    ``area`` takes one area only, ``suffix`` only the files whose names end so, and no folders.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveTree)
    asked = {"path": path, "content": str(content).lower(), "shares": str(shares), "area": area, "suffix": suffix}
    return spark.read.format(FORMAT).options(**asked).load()


def write_documents(documents: DataFrame, path: str, packed: bool = False) -> None:
    """Write (path, content) rows as files below ``path``, each by itself or in packs.

    Of rows with one path the last written is kept; packs take each path once.
    """
    documents.sparkSession.dataSource.register(ArchiveTree)
    documents.select("path", "content").write.format(FORMAT).mode("append").option("path", path).option("packed", str(packed).lower()).save()


def session_files(tree: DataFrame) -> DataFrame:
    """Files of sessions with valid ids, hidden names and folders left out."""
    role = (F.when(F.col("name") == SESSION_FILE, "session").when(F.col("name") == ANNOTATIONS_FILE, "annotations")
            .when(F.col("name").endswith(SIDECAR_SUFFIX), "sidecar").otherwise("data"))
    shown = tree.where((F.col("area") == DATA_FOLDER) & F.col("owner").rlike(ids.RUN_ID) & F.col("name").isNotNull() & ~F.col("name").startswith("."))
    return shown.select("archive", "year", F.col("owner").alias("run_id"), "name", role.alias("role"), "size", "mtime", "trashed")


def session_folders(tree: DataFrame) -> DataFrame:
    """Folders of sessions with valid ids, with or without a record."""
    found = tree.where((F.col("area") == DATA_FOLDER) & F.col("name").isNull() & F.col("owner").rlike(ids.RUN_ID))
    # Several packs may hold files of one folder.
    return found.groupBy("archive", "year", F.col("owner").alias("run_id")).agg(F.min("path").alias("path"))


def _records(tree: DataFrame, area: str, name: Column, *columns: Column) -> DataFrame:
    return tree.where((F.col("area") == area) & name & F.col("content").isNotNull()).select("archive", *columns, "content")


def sidecar_documents(tree: DataFrame) -> DataFrame:
    """Sidecars of sessions and of their trash."""
    filename = F.expr(f"substring(name, 1, length(name) - {len(SIDECAR_SUFFIX)})")
    return _records(tree, DATA_FOLDER, F.col("name").endswith(SIDECAR_SUFFIX), "year", F.col("owner").alias("run_id"), filename.alias("filename"), "trashed")


def session_documents(tree: DataFrame) -> DataFrame:
    return _records(tree, DATA_FOLDER, (F.col("name") == SESSION_FILE) & ~F.col("trashed"), "year", F.col("owner").alias("folder"))


def seal_documents(tree: DataFrame) -> DataFrame:
    """Seals of the years."""
    return _records(tree, DATA_FOLDER, (F.col("name") == SEAL_FILE) & F.col("owner").isNull(), "year")


def asset_documents(tree: DataFrame) -> DataFrame:
    return _records(tree, ASSETS, F.col("name") == ASSET_FILE, F.col("owner").alias("folder"))


def asset_folders(tree: DataFrame) -> DataFrame:
    """Folders of assets, with or without a record."""
    return tree.where((F.col("area") == ASSETS) & F.col("owner").isNotNull()).select("archive", F.col("owner").alias("asset_id")).distinct()


def asset_files(tree: DataFrame) -> DataFrame:
    """The file each asset stands for: whatever is shown in its folder besides the record."""
    shown = F.col("name").isNotNull() & ~F.col("name").startswith(".") & (F.col("name") != ASSET_FILE)
    return tree.where((F.col("area") == ASSETS) & F.col("owner").isNotNull() & shown).select(
        "archive", F.col("owner").alias("asset_id"), F.col("name").alias("live_name"))


def manifest_documents(tree: DataFrame) -> DataFrame:
    """Manifests of the code store by the id their file is named after."""
    shown = F.col("name").endswith(".json") & ~F.col("name").startswith(".") & (F.col("owner") == MANIFESTS)
    return _records(tree, CODE, shown, F.expr("substring(name, 1, length(name) - 5)").alias("manifest"))


def blobs(tree: DataFrame) -> DataFrame:
    """Stored blobs: the digest each file is named after, and its bytes."""
    return tree.where((F.col("area") == CODE) & (F.col("owner") == BLOBS) & F.col("name").isNotNull() & ~F.col("name").startswith(".")).select(
        "archive", F.col("name").alias("digest"), F.col("size").alias("bytes"))
