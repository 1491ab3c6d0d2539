"""Reading catalog documents: file trees, JSON and YAML records.

Every reader is two steps. ``scan_*`` lists or loads files with Spark's own
file source; ``parse_*`` turns (path, content) rows into typed columns and works
as well on a table of raw documents. Unreadable documents are set apart with the
reason, never dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import ids, policy
from tracelake.functions.text import SIDECAR_SUFFIX, clean_tags, strip
from tracelake.functions.refs import parse_refs

# Names of the documents and folders of an archive.
SESSION_FILE = "session.yaml"
ANNOTATIONS_FILE = "annotations.yaml"
ASSET_FILE = "asset.json"
ARCHIVE_FILE = "archive.yaml"
DATA_FOLDER = "data"
TRASH_FOLDER = ".trash"
KINDS = ("standard", "intake", "fragment")
OVERWRITE_POLICIES = ("duplicate", "overwrite", "cancel")

REF = "struct<user:string,archive:string,session:string,file:string,collection:string,asset:string,sha256:string,fidelity:string>"
SIDECAR_SCHEMA = f"""created string, produced_by struct<repo:string,commit:string,dirty:boolean,entry_point:string,code:string,
  source:string,origin:string,imported_by:string,imported_at:string>, derived_from array<{REF}>, inputs string, sha256 string,
  original_name string, duplicate_index int"""
SIDECAR_KEYS = ("created", "produced_by", "derived_from", "inputs", "sha256", "original_name", "duplicate_index")
ASSET_SCHEMA = f"""id string, created string, name string, policy string, period_days int, max_snapshots int,
  max_snapshot_bytes bigint, auto_max_bytes bigint, origin string, imported_by string, size bigint, mtime double,
  sha256 string, scanned_at string, derived_from array<{REF}>,
  snapshots array<struct<sha256:string,at:string,by:string,bytes:bigint,note:string,trigger:string,pending_gc:boolean>>"""


# -- scanning ------------------------------------------------------------------------

def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of everything below ``root``.

    Contents are not read: the column is pruned before the scan. Spark's file
    source hides names that start with a dot or an underscore.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length", "modificationTime")


def scan_documents(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, content) of the small documents that match ``glob``."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .load(root).select("path", F.decode("content", "UTF-8").alias("content")))


def scan_trash(spark: SparkSession, root: str) -> DataFrame:
    """Sidecars in the trash of each session, which a plain scan does not see."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", f"*{SIDECAR_SUFFIX}")
            .load(f"{root.rstrip('/')}/{DATA_FOLDER}/*/*/{TRASH_FOLDER}")
            .select("path", F.decode("content", "UTF-8").alias("content")))


def place_of(path: Column) -> dict[str, Column]:
    """Year, session and name that a path below ``data/`` says, and its role."""
    below = rf"/{DATA_FOLDER}/(\d+)/([^/]+)/(?:\.trash/)?([^/]+)$"
    name = F.regexp_extract(path, below, 3)
    trashed = path.contains(f"/{TRASH_FOLDER}/")
    return {
        "year": F.regexp_extract(path, below, 1).try_cast("int"),
        "run_id": F.regexp_extract(path, below, 2),
        "name": name,
        "role": F.when(name == SESSION_FILE, "session").when(name == ANNOTATIONS_FILE, "annotations")
        .when(name.endswith(SIDECAR_SUFFIX), "sidecar").otherwise("data"),
        "trashed": trashed,
    }


def file_inventory(files: DataFrame, archive: Column) -> DataFrame:
    """Files of an archive's sessions (S1): only digit years and valid ids count."""
    placed = files.select(archive.alias("archive"), *[c.alias(n) for n, c in place_of(F.col("path")).items()],
                          F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return placed.where(F.col("year").isNotNull() & F.col("run_id").rlike(ids.RUN_ID) & ~F.col("name").startswith("."))


# -- JSON records -----------------------------------------------------------------------

def _unknown(content: Column, known: tuple[str, ...]) -> Column:
    """Keys this version does not know, kept as they are."""
    return F.map_filter(F.from_json(content, "map<string,string>"), lambda k, v: ~k.isin(*known))


def parse_sidecars(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed sidecars and the unreadable rest.

    ``source`` reads as script when absent, and ``source_recorded`` says whether
    it was really written; a default is not a fact. ``documents`` keeps its other
    columns.
    """
    keep = [c for c in documents.columns if c != "content"]
    valid = F.try_parse_json("content")
    got = F.from_json("content", SIDECAR_SCHEMA)
    whole = documents.withColumn("_v", valid.isNotNull()).withColumn("_d", got)
    bad = ~F.col("_v") | F.col("_d.created").isNull()
    good = whole.where(~bad).select(
        *keep, "_d.created", *[F.col(f"_d.produced_by.{n}").alias(n) for n in (
            "repo", "commit", "dirty", "entry_point", "code", "origin", "imported_by", "imported_at")],
        F.coalesce("_d.produced_by.source", F.lit("script")).alias("source"),
        F.get_json_object("content", "$.produced_by.source").isNotNull().alias("source_recorded"),
        F.coalesce("_d.derived_from", F.from_json(F.lit("[]"), f"array<{REF}>")).alias("derived_from"),
        F.get_json_object("content", "$.inputs").alias("inputs"), "_d.sha256", "_d.original_name", "_d.duplicate_index",
        _unknown(F.col("content"), SIDECAR_KEYS).alias("extra"))
    return good, whole.where(bad).select(*keep, F.when(~F.col("_v"), "not JSON").otherwise("no created").alias("error"))


def sidecar_edges(sidecars: DataFrame) -> DataFrame:
    """One row per derived_from entry, in order."""
    return sidecars.select("archive", "run_id", "filename", F.posexplode("derived_from").alias("ord", "r")).select(
        "archive", "run_id", "filename", "ord", *[F.col(f"r.{p}").alias(f"ref_{p}") for p in (
            "user", "archive", "session", "file", "collection", "asset", "sha256", "fidelity")])


def parse_assets(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asset records and the unreadable rest."""
    keep = [c for c in documents.columns if c != "content"]
    whole = documents.withColumn("_v", F.try_parse_json("content").isNotNull()).withColumn(
        "_d", F.from_json("content", ASSET_SCHEMA))
    bad = ~F.col("_v") | F.col("_d.id").isNull()
    return whole.where(~bad).select(*keep, "_d.*"), whole.where(bad).select(*keep, F.lit("not an asset record").alias("error"))


def asset_snapshots(assets: DataFrame) -> DataFrame:
    return assets.select("archive", F.col("id").alias("asset_id"), F.posexplode("snapshots").alias("pos", "s")).select(
        "archive", "asset_id", (F.col("pos") + 1).alias("ord"), "s.*").withColumn(
        "pending_gc", F.coalesce("pending_gc", F.lit(False)))


def parse_manifests(documents: DataFrame) -> DataFrame:
    """(manifest, entry, path, blob) of every file of every manifest."""
    got = documents.select("manifest", F.from_json("content", "entry string, files map<string,string>").alias("d"))
    return got.where("d is not null").select("manifest", F.col("d.entry").alias("entry"), F.explode("d.files").alias("path", "blob"))


def blob_inventory(files: DataFrame) -> DataFrame:
    """Stored blobs by the last part of their path."""
    digest = F.substring_index("path", "/", -1)
    return files.select(digest.alias("digest"), F.col("length").alias("bytes")).where(~F.col("digest").startswith("."))


# -- YAML records -------------------------------------------------------------------------

def yaml_to_json(documents: DataFrame) -> DataFrame:
    """Replace YAML ``content`` by JSON text; ``error`` says what is unreadable.

    The one step here that needs Python: batches of documents go through it and
    nothing else does.
    """
    schema = documents.select([c for c in documents.columns if c != "content"]).schema
    schema = schema.add("json", "string").add("error", "string")

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        def one(text: str) -> tuple[str | None, str | None]:
            try:
                return json.dumps(yaml.load(text, Loader=loader), default=lambda v: v.isoformat()), None
            except (yaml.YAMLError, ValueError, AttributeError, TypeError) as e:
                return None, str(e).splitlines()[0]

        for batch in batches:
            pairs = [one(t) for t in batch.pop("content")]
            yield batch.assign(json=[p[0] for p in pairs], error=[p[1] for p in pairs])

    return documents.mapInPandas(convert, schema)


SESSION_SCHEMA = """run_id string, created string, status string, tags array<string>, description string, hold_until string,
  related_runs array<struct<user:string,archive:string,session:string,file:string>>,
  history array<struct<action:string,at:string,by:string,file:string,note:string>>,
  renames array<struct<`from`:string,`to`:string,at:string>>"""


def parse_sessions(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session records and the unreadable rest (S3)."""
    got = yaml_to_json(documents).withColumn("_d", F.from_json("json", SESSION_SCHEMA))
    bad = F.col("error").isNotNull() | F.col("_d.run_id").isNull()
    keep = [c for c in documents.columns if c != "content"]
    record = got.where(~bad).select(*keep, F.col("_d.run_id").alias("record_id"), *[f"_d.{n}" for n in (
        "created", "status", "description", "hold_until", "related_runs", "history", "renames")],
        F.coalesce("_d.tags", F.array().cast("array<string>")).alias("tags"))
    return record, got.where(bad).select(*keep, F.coalesce("error", F.lit("no run_id")).alias("error"))


def parse_annotations(documents: DataFrame) -> DataFrame:
    """Notes on sessions and files; junk is passed over, unreadable files are empty."""
    # Entries are taken as text first, so that one bad entry spoils only itself.
    got = yaml_to_json(documents).select(
        "archive", "run_id", F.from_json("json", "session string, artifacts map<string,string>").alias("d"))
    session = got.select("archive", "run_id", F.lit(None).cast("string").alias("filename"), F.col("d.session").alias("t"))
    files = got.select("archive", "run_id", F.explode("d.artifacts").alias("filename", "t"))
    rows = session.unionByName(files).where("t is not null").withColumn(
        "e", F.from_json("t", "tags string, comment string"))
    tags = F.coalesce(clean_tags(F.from_json("e.tags", "array<string>")), F.array().cast("array<string>"))
    return rows.select("archive", "run_id", "filename", tags.alias("tags"),
                       F.coalesce(strip(F.col("e.comment")), F.lit("")).alias("comment")).where(
        (F.size("tags") > 0) | (F.col("comment") != ""))


def parse_collections(documents: DataFrame) -> DataFrame:
    """Entries of collections; an entry is a reference or one with a note."""
    got = yaml_to_json(documents).select("archive", "collection", F.from_json(
        "json", "title string, description string, entries array<string>").alias("d"))
    rows = got.select("archive", "collection", F.col("d.title").alias("title"), F.posexplode("d.entries").alias("ord", "e"))
    ref = F.get_json_object("e", "$.ref")
    return parse_refs(rows.select("archive", "collection", "title", "ord", F.coalesce(ref, "e").alias("ref"),
                                  F.coalesce(F.get_json_object("e", "$.note"), F.lit("")).alias("note")), "ref")


def parse_searches(documents: DataFrame) -> DataFrame:
    """Saved searches."""
    got = yaml_to_json(documents).select("archive", "name", F.from_json(
        "json", "title string, query string, fields array<string>, date_from string, date_to string, created string, modified string").alias("d"))
    return got.where("d is not null").select("archive", "name", "d.*")


def parse_settings(documents: DataFrame, local_user: str) -> DataFrame:
    """Archive settings with safe values for typos.

    ``documents`` has folder and content. A missing name or owner falls back to
    the folder and the local user; an unknown kind stops the job, since guessing
    it would hand out rights.
    """
    schema = """name string, user string, kind string, created string, merged_at string, merged_to string, on_overwrite string,
      asset_policy string, asset_periodic_above bigint, asset_manual_above bigint, asset_period_days int,
      asset_max_snapshots int, asset_max_snapshot_bytes bigint, asset_cap_action string"""
    got = yaml_to_json(documents).select("folder", F.from_json("json", schema).alias("d"))
    d = {n: F.col(f"d.{n}") for n in ("name", "user", "kind", "on_overwrite", "asset_policy", "asset_cap_action")}

    def known(value: Column, choices: tuple[str, ...], default: str) -> Column:
        return F.when(value.isin(*choices), value).otherwise(default)

    def filled(value: Column, instead: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(instead)

    kind = F.coalesce(d["kind"], F.lit("standard"))
    return got.select(
        "folder", filled(d["name"], F.substring_index("folder", "/", -1)).alias("archive"),
        filled(d["user"], F.lit(local_user)).alias("owner"), (F.coalesce(d["user"], F.lit("")) != "").alias("owner_declared"),
        F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(
            F.lit("unknown archive kind: "), kind)).cast("string")).alias("kind"),
        known(d["on_overwrite"], OVERWRITE_POLICIES, "duplicate").alias("on_overwrite"),
        known(d["asset_policy"], policy.POLICIES[1:], policy.DEFAULT_POLICY).alias("asset_policy"),
        known(d["asset_cap_action"], policy.CAP_ACTIONS, "mark").alias("cap_action"),
        F.coalesce("d.asset_periodic_above", F.lit(policy.DEFAULT_PERIODIC_ABOVE)).alias("periodic_above"),
        F.coalesce("d.asset_manual_above", F.lit(policy.DEFAULT_MANUAL_ABOVE)).alias("manual_above"),
        F.coalesce("d.asset_period_days", F.lit(policy.DEFAULT_PERIOD_DAYS)).alias("period_days"),
        F.coalesce("d.asset_max_snapshots", F.lit(0)).alias("max_snapshots"),
        F.coalesce("d.asset_max_snapshot_bytes", F.lit(0).cast("bigint")).alias("max_snapshot_bytes"))


def parse_seals(documents: DataFrame) -> DataFrame:
    """Year seals (S10). The files start with a dot, which Spark's file source
    hides, so they come as a table of (archive, year, content)."""
    got = yaml_to_json(documents).select("archive", "year", F.from_json("json", "digest string, sessions bigint, sealed string").alias("d"))
    return got.where("d.digest is not null").select("archive", "year", "d.*")
