"""Integrity audit: every kind of inconsistency is one query over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import identity
from tracelake.functions.text import hash_bytes, hash_text
from tracelake.functions.times import hold_garbled
from tracelake.operators.items import ITEM, SESSION
from tracelake.operators.lineage import NODE

# States a session may have, and what to do about each finding.
STATUSES = ("open", "closed", "crashed")
INFO_KINDS = (
    "renamed_ref", "unresolved_cross_archive_ref", "unpinned_asset_ref", "unscanned_asset_rename",
    "annotation_without_file", "dangling_collection_entry", "unresolvable_collection_entry",
    "no_owner", "unqualified_owner",
)
FIXES = {
    "missing_session_yaml": "restore the session record or move the folder away",
    "duplicate_id": "renumber or remove the extra folder",
    "unreadable_session_yaml": "repair the session record",
    "id_mismatch": "make the recorded id equal the folder name",
    "invalid_status": "record a valid status",
    "garbled_hold_until": "release the hold",
    "orphan": "adopt the file with a stub record",
    "unreadable_sidecar": "repair the sidecar",
    "missing_artifact": "recover the file from the trash or drop its sidecar",
    "checksum_mismatch": "reseal if the edit was meant, else restore the bytes",
    "dangling_derived_from": "restore the target or drop the reference",
    "dangling_related_run": "restore the target or drop the reference",
    "self_reference": "drop the reference",
    "renamed_ref": "optionally rewrite the reference to the new name",
    "unresolved_cross_archive_ref": "register the archive so it can be checked",
    "dangling_code_ref": "restore the manifest or accept the loss",
    "missing_code_blob": "restore the code store from a backup",
    "dangling_asset_ref": "restore the asset or drop the reference",
    "missing_asset_blob": "restore the blob store from a backup",
    "unpinned_asset_ref": "commit the asset so later references are pinned",
    "orphan_asset_dir": "restore the record or move the directory away",
    "unreadable_asset": "repair the asset record",
    "missing_asset_file": "restore the file or remove the asset",
    "unscanned_asset_rename": "scan the asset",
    "annotation_without_file": "restore the file or drop the note",
    "dangling_collection_entry": "remove the entry or restore its target",
    "unresolvable_collection_entry": "remove the entry or restore its target",
    "year_seal_mismatch": "seal again if the change was meant, else unseal",
    "no_owner": "declare an owner",
    "unqualified_owner": "qualify the owner with an authority",
}
COLUMNS = ["kind", "severity", "archive", "session", "file", "detail", "fix"]


def issues(df: DataFrame, kind: str | Column, session: str | None = None, file: str | None = None,
           detail: Column | None = None) -> DataFrame:
    """Rows of ``df`` as findings; severity and advice follow from the kind."""
    none = F.lit(None).cast("string")
    name = F.lit(kind) if isinstance(kind, str) else kind
    kinds = [kind] if isinstance(kind, str) else FIXES
    fix = none
    for k in kinds:
        fix = F.when(name == k, FIXES[k]).otherwise(fix)
    return df.select(
        name.alias("kind"),
        F.when(name.isin(*INFO_KINDS), "info").otherwise("error").alias("severity"),
        "archive", (F.col(session) if session else none).alias("session"),
        (F.col(file) if file else none).alias("file"),
        (none if detail is None else detail).alias("detail"), fix.alias("fix"))


def tagged(**tables: DataFrame) -> DataFrame:
    """Rows of several tables under each other, each with a true column named after its table."""
    out = None
    for tag, table in tables.items():
        marked = table.withColumn(tag, F.lit(True))
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
    return out


def any_of(*tags: str) -> list[Column]:
    return [F.coalesce(F.bool_or(t), F.lit(False)).alias(t) for t in tags]


# -- sessions (C1-C6) ---------------------------------------------------------

def session_issues(folders: DataFrame, records: DataFrame, rejects: DataFrame, sessions: DataFrame) -> DataFrame:
    """What is wrong with session folders and with what their records say.

    ``folders`` are the folders listed, ``records`` and ``rejects`` those whose
    record could and could not be read, each with ``path``; a folder in neither
    has no record. ``sessions`` are the readable records.
    """
    place = [*SESSION, "path"]
    paths = tagged(_listed=folders.select(*place), _read=records.select(*place), _bad=rejects.select(*place)).groupBy(
        *place).agg(*any_of("_listed", "_read", "_bad"))
    state = F.when(F.col("_bad"), "unreadable_session_yaml").when(F.col("_listed") & ~F.col("_read"), "missing_session_yaml")
    by_folder = paths.withColumn("_kind", state)
    twice = folders.groupBy(*SESSION).agg(F.countDistinct("path").alias("n")).where("n > 1")
    # One look at a record finds all that is wrong with it.
    status, hold = F.col("status"), F.col("hold_until")
    says = lambda kind, what: F.struct(F.lit(kind).alias("_kind"), what.alias("said"))
    wrong = F.array(
        F.when(F.col("record_id") != F.col("run_id"), says("id_mismatch", F.col("record_id"))),
        F.when(~status.isin(*STATUSES), says("invalid_status", status)),
        F.when(hold_garbled(hold), says("garbled_hold_until", hold)))
    recorded = sessions.select(*SESSION, F.inline(F.filter(wrong, lambda x: x.isNotNull())))
    return (
        issues(by_folder.where("_kind is not null"), F.col("_kind"), "run_id", None, F.col("path"))
        .unionByName(issues(twice, "duplicate_id", "run_id", None, F.concat(F.col("n").cast("string"), F.lit(" folders"))))
        .unionByName(issues(recorded, F.col("_kind"), "run_id", None, F.col("said")))
    )


# -- files and sidecars (C7-C10) ----------------------------------------------

def paired(files: DataFrame, sidecars: DataFrame, rejects: DataFrame, recorded: DataFrame) -> DataFrame:
    """Every name in sessions with a record: its file, its sidecar, and ``found``, what is wrong with the two.

    ``sidecars`` are the readable ones, ``rejects`` the others; neither holds any
    from the trash. A name counts as ``checked`` if both are in place: only such
    sidecars are looked into further. Hashes are told where they differ.

    One exchange brings the three together, before anything is grouped: names hardly repeat, so grouping them first would
    only sort them. Hashes travel as bytes.
    """
    rows = tagged(
        _file=files.select(*SESSION, F.col("name").alias("filename"), hash_bytes(F.col("sha256")).alias("actual_sha256")),
        _car=sidecars.select(*NODE, hash_bytes(F.col("sha256")).alias("sha256"), "code"), _bad=rejects.select(*NODE)).repartition(*NODE)
    names = rows.groupBy(*NODE).agg(F.max("actual_sha256").alias("actual_sha256"), F.max("sha256").alias("sha256"),
                                    F.max("code").alias("code"), *any_of("_file", "_car", "_bad"))
    found = (F.when(F.col("_bad"), "unreadable_sidecar").when(~F.col("_car"), "orphan").when(~F.col("_file"), "missing_artifact")
             .when(F.col("sha256") != F.col("actual_sha256"), "checksum_mismatch"))
    told = [F.when(F.col("found") == "checksum_mismatch", hash_text(F.col(h))).alias(h) for h in ("sha256", "actual_sha256")]
    judged = names.withColumn("found", found).select(*NODE, *told, "code", "found", F.col("_file").alias("in_place"),
                                                     (F.col("_file") & F.col("_car") & ~F.col("_bad")).alias("checked"))
    return judged.join(recorded.select(*SESSION), SESSION, "left_semi")


def artifact_issues(pairs: DataFrame) -> DataFrame:
    drift = F.when(F.col("found") == "checksum_mismatch", F.concat(
        F.substring("actual_sha256", 1, 12), F.lit(" is not "), F.substring("sha256", 1, 12)))
    return issues(pairs.where("found is not null"), F.col("found"), "run_id", "filename", drift)


# -- references (C11-C15, C21) --------------------------------------------------

def reference_targets(pairs: DataFrame, recorded: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """All a local reference can lead to, one row per (archive, to_session, to_file).

    A session that is meant whole has the empty file name. ``current_name`` is
    what a file that was renamed is called now, if that is there.
    """
    renamed = names.join(files.select(*SESSION, F.col("name").alias("current_name")), [*SESSION, "current_name"], "left_semi")
    rows = tagged(
        there=recorded.select(*SESSION, F.lit("").alias("to_file")).unionByName(
            pairs.where("in_place").select(*SESSION, F.col("filename").alias("to_file"))),
        _moved=renamed.select(*SESSION, F.col("old_name").alias("to_file"), "current_name"))
    return rows.withColumnRenamed("run_id", "to_session").repartition("archive", "to_session", "to_file").groupBy("archive", "to_session", "to_file").agg(
        *any_of("there"), F.max("current_name").alias("current_name"))


def reference_issues(edges: DataFrame, related: DataFrame, archives: DataFrame, targets: DataFrame) -> DataFrame:
    """Dangling, renamed, self and unreachable references.

    Asset edges are judged elsewhere, and only by their own rules. A reference
    into another archive is never verified, only reported when that archive is
    out of reach. Every reference is resolved once; at most one kind is true of
    it. Keys are never null, so that no task gets all references of one sort.
    """
    derived = edges.where("ref_asset is null").select(
        *SESSION, "filename", "ref_archive", "ref_session", "ref_file", F.lit("dangling_derived_from").alias("_gone"))
    runs = related.select(
        *SESSION, F.lit(None).cast("string").alias("filename"), "ref_archive", "ref_session", "ref_file",
        F.lit("dangling_related_run").alias("_gone"))
    refs = derived.unionByName(runs).withColumns({
        "to_archive": F.coalesce("ref_archive", "archive"), "to_session": F.coalesce("ref_session", "run_id"),
        "to_file": F.coalesce("ref_file", F.lit(""))})
    reach = archives.groupBy(F.col("archive").alias("to_archive")).agg(F.bool_or("reachable").alias("reachable"))
    got = refs.join(targets, ["archive", "to_session", "to_file"], "left").join(reach, "to_archive", "left")
    foreign = F.col("ref_archive").isNotNull()
    itself = (F.col("ref_file") == F.col("filename")) & (F.col("to_session") == F.col("run_id"))
    kind = (F.when(foreign, F.when(~F.coalesce("reachable", F.lit(False)), "unresolved_cross_archive_ref"))
            .when(itself, "self_reference").when(F.coalesce("there", F.lit(False)), None)
            .when(F.col("current_name").isNotNull() & F.col("ref_file").isNotNull(), "renamed_ref").otherwise(F.col("_gone")))
    target = F.concat_ws("/", "to_session", "ref_file")
    detail = (F.when(foreign, F.col("ref_archive")).when(F.col("_kind") == "renamed_ref", F.concat(target, F.lit(" -> "), "current_name"))
              .when(F.col("_kind") != "self_reference", target))
    return issues(got.withColumn("_kind", kind).where("_kind is not null"), F.col("_kind"), "run_id", "filename", detail)


# -- captured code (C16, C17) ----------------------------------------------------

def code_issues(sidecars: DataFrame, manifests: DataFrame, manifest_files: DataFrame,
                blobs: DataFrame) -> DataFrame:
    """Manifests that are gone, and manifests listing bytes that are gone.

    Missing paths are counted and their first three named once per manifest,
    both with partial aggregation, before sidecars join.
    """
    using = sidecars.where("code is not null").select(*NODE, F.col("code").alias("manifest"))
    dangling = using.join(manifests.select("manifest"), "manifest", "left_anti")
    absent = manifest_files.join(blobs.select(F.col("digest").alias("blob")), "blob", "left_anti")
    first = (
        absent.withColumn("_r", F.row_number().over(Window.partitionBy("manifest").orderBy("path")))
        .where("_r <= 3").groupBy("manifest")
        .agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("shown"))
    )
    counted = absent.groupBy("manifest").agg(F.count("*").alias("n")).join(first, "manifest")
    broken = using.join(counted, "manifest")
    more = F.when(F.col("n") > 3, F.concat(F.lit(" and "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return (
        issues(dangling, "dangling_code_ref", "run_id", "filename", F.col("manifest"))
        .unionByName(issues(broken, "missing_code_blob", "run_id", "filename", F.concat(F.col("shown"), more)))
    )


# -- assets (C18-C20, C22-C26) ----------------------------------------------------

def asset_ref_issues(edges: DataFrame, records: DataFrame, blobs: DataFrame) -> DataFrame:
    """References to assets without a readable record, to lost bytes, and to no bytes at all."""
    known = records.select("archive", F.col("asset_id").alias("ref_asset"), F.lit(True).alias("_known")).distinct()
    stored = blobs.select(F.col("digest").alias("_sought"), F.lit(True).alias("_stored")).distinct()
    refs = edges.where("ref_asset is not null").select(*NODE, "ref_asset", "ref_sha256", "ref_fidelity")
    sha = F.col("ref_sha256")
    # References without bytes get keys of their own, which spreads them.
    got = refs.withColumn("_sought", F.coalesce(sha, F.concat_ws("/", *NODE))).join(
        known, ["archive", "ref_asset"], "left").join(stored, "_sought", "left")
    kind = (F.when(F.col("_known").isNull(), "dangling_asset_ref").when(sha.isNull(), "unpinned_asset_ref")
            .when((F.col("ref_fidelity") == "pinned") & F.col("_stored").isNull(), "missing_asset_blob"))
    detail = F.when(F.col("_kind") == "missing_asset_blob", F.concat("ref_asset", F.lit(" @ "), F.substring("ref_sha256", 1, 12))).otherwise(
        F.col("ref_asset"))
    return issues(got.withColumn("_kind", kind).where("_kind is not null"), F.col("_kind"), "run_id", "filename", detail)


def asset_issues(folders: DataFrame, records: DataFrame, rejects: DataFrame, live: DataFrame, snapshots: DataFrame,
                 blobs: DataFrame) -> DataFrame:
    """What is wrong with the folders of assets; drift is never a finding, being edited is what assets are for.

    ``folders`` are those listed, ``records`` and ``rejects`` what could and could
    not be read, ``live`` the (archive, asset_id, live_name) of the files in them.
    """
    key = ["archive", "asset_id"]
    one = tagged(_listed=folders.select(*key), _read=records.select(*key, "name"), _bad=rejects.select(*key),
                 _live=live.select(*key, "live_name")).groupBy(*key).agg(
        F.max("name").alias("name"), F.max("live_name").alias("live_name"), *any_of("_listed", "_read", "_bad"))
    kind = (F.when(F.col("_bad"), "unreadable_asset").when(~F.col("_read"), F.when(F.col("_listed"), "orphan_asset_dir"))
            .when(F.col("live_name").isNull(), "missing_asset_file")
            .when((F.col("name") != "") & (F.col("live_name") != F.col("name")), "unscanned_asset_rename"))
    detail = F.when(F.col("_kind") == "missing_asset_file", F.col("name")).when(
        F.col("_kind") == "unscanned_asset_rename", F.concat("name", F.lit(" -> "), "live_name"))
    retained = snapshots.where("not pending_gc").join(records.select(*key), key, "left_semi")
    lost = retained.join(blobs.select(F.col("digest").alias("sha256")), "sha256", "left_anti")
    return issues(one.withColumn("_kind", kind).where("_kind is not null"), F.col("_kind"), None, "asset_id", detail).unionByName(
        issues(lost, "missing_asset_blob", None, "asset_id", F.concat_ws(" ", F.substring("sha256", 1, 12), F.col("ord").cast("string"))))


# -- notes, collections, seals, owners (C27-C30) -----------------------------------

def annotation_issues(annotations: DataFrame, files: DataFrame) -> DataFrame:
    named = annotations.where("filename is not null").select(*SESSION, F.col("filename").alias("name"))
    return issues(named.join(files.select(*ITEM), ITEM, "left_anti"), "annotation_without_file", "run_id", "name")


def entry_status(entries: DataFrame, archives: DataFrame, sessions: DataFrame, files: DataFrame,
                 collections: DataFrame) -> DataFrame:
    """What each parsed collection entry leads to (J5 for collections)."""
    home = entries.withColumn("to_archive", F.coalesce("ref_archive", "archive"))
    known = archives.select(F.col("archive").alias("to_archive"), "reachable")
    in_session = sessions.select(F.col("archive").alias("to_archive"), F.col("run_id").alias("ref_session"),
                                 F.lit(True).alias("_s"))
    in_file = files.select(F.col("archive").alias("to_archive"), F.col("run_id").alias("ref_session"),
                           F.col("name").alias("ref_file"), F.lit(True).alias("_f"))
    in_coll = collections.select(F.col("archive").alias("to_archive"),
                                 F.col("collection").alias("ref_collection"), F.lit(True).alias("_c"))
    got = (home.join(known, "to_archive", "left").join(in_session, ["to_archive", "ref_session"], "left")
           .join(in_file, ["to_archive", "ref_session", "ref_file"], "left")
           .join(in_coll, ["to_archive", "ref_collection"], "left"))
    foreign = F.col("to_archive") != F.col("archive")
    return got.withColumn("problem", F.when(F.col("ref_error").isNotNull(), F.concat(
        F.lit("malformed: "), F.col("ref_error")))
        .when(foreign & ~F.coalesce("reachable", F.lit(False)), "archive out of reach")
        .when(F.col("ref_collection").isNotNull(), F.when(F.col("_c").isNull(), "no such collection"))
        .when(F.col("ref_session").isNull() & F.col("ref_file").isNull(), F.lit(None))
        .when(F.col("_s").isNull(), "session not found")
        .when(F.col("ref_file").isNotNull() & F.col("_f").isNull(), "file is missing"))


def collection_issues(judged: DataFrame) -> DataFrame:
    out_of_reach = F.col("problem").startswith("malformed") | (F.col("problem") == "archive out of reach")
    kind = F.when(out_of_reach, "unresolvable_collection_entry").otherwise("dangling_collection_entry")
    return issues(judged.where("problem is not null"), kind, None, None, F.concat(
        F.col("collection"), F.lit(" lists "), F.col("ref"), F.lit(": "), F.col("problem")))


def seal_issues(digests: DataFrame, seals: DataFrame) -> DataFrame:
    """Sealed years whose content is no longer what was sealed."""
    now = digests.select("archive", "year", F.col("digest").alias("_now"), F.col("sessions").alias("_n"))
    both = seals.join(now, ["archive", "year"], "left").where(~F.col("digest").eqNullSafe(F.col("_now")))
    count = F.coalesce("_n", F.lit(0))
    detail = F.when(count != F.col("sessions"), F.concat(
        F.col("year").cast("string"), F.lit(": "), F.col("sessions").cast("string"), F.lit(" -> "),
        count.cast("string"), F.lit(" sessions"))).otherwise(F.concat(
            F.col("year").cast("string"), F.lit(": same number of sessions, other content")))
    return issues(both, "year_seal_mismatch", None, None, detail)


def owner_issues(archives: DataFrame) -> DataFrame:
    owner = F.col("owner")
    bare = ~identity.explicit(owner) | (identity.authority_of(owner) == identity.LOCAL_AUTHORITY)
    kind = F.when(F.coalesce(owner, F.lit("")) == "", "no_owner").otherwise("unqualified_owner")
    return issues(archives.where((F.coalesce(owner, F.lit("")) == "") | bare), kind, None, None,
                  F.coalesce(owner, F.lit("")))


def summary(found: DataFrame) -> DataFrame:
    """Errors and notes; only errors fail an audit."""
    return found.groupBy("severity").agg(F.count("*").alias("n"))
