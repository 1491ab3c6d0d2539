"""The audit by detection: every kind planted once, in tables with odd rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import audit as au
from tracelake.operators import transfer as tr


def table(spark, columns, *rows):
    return spark.createDataFrame(list(rows), columns)


PLACES = "archive string, run_id string, path string"
RECORDS = "archive string, run_id string, record_id string, status string, hold_until string"
FILES = "archive string, run_id string, name string, sha256 string"
CARS = "archive string, run_id string, filename string, sha256 string, code string"
BAD_CARS = "archive string, run_id string, filename string"
EDGES = ("archive string, run_id string, filename string, ref_archive string, ref_session string, ref_file string, ref_asset string, "
         "ref_sha256 string, ref_fidelity string")


def found(df):
    return sorted(((r.kind, r.archive, r.session, r.file, r.detail) for r in df.collect()), key=str)


def test_sessions_are_judged_by_what_is_listed_and_read(spark):
    folders = table(spark, PLACES, ("A", "S1", "p1"), ("A", "S1", "p1"), ("A", "S2", "p2"), ("A", "S3", "p3"), ("A", "S3", "p4"), (None, "S4", "p5"))
    records = table(spark, PLACES, ("A", "S1", "p1"), ("A", "S3", "p3"))
    rejects = table(spark, PLACES, ("A", "S2", "p2"), ("A", "S2", "p2"))
    sessions = table(spark, RECORDS, ("A", "S1", "S9", "paused", "next week"), ("A", "S3", "S3", "open", None), ("A", "S5", None, None, ""))
    assert found(au.session_issues(folders, records, rejects, sessions)) == sorted([
        ("duplicate_id", "A", "S3", None, "2 folders"), ("garbled_hold_until", "A", "S1", None, "next week"), ("id_mismatch", "A", "S1", None, "S9"),
        ("invalid_status", "A", "S1", None, "paused"), ("missing_session_yaml", "A", "S3", None, "p4"), ("missing_session_yaml", None, "S4", None, "p5"),
        ("unreadable_session_yaml", "A", "S2", None, "p2")], key=str)
    none = folders.limit(0)
    assert found(au.session_issues(none, none, none, sessions.limit(0))) == []


@pytest.fixture
def pairs(spark):
    files = table(spark, FILES, ("A", "S1", "good.csv", "x"), ("A", "S1", "good.csv", "x"), ("A", "S1", "alone.csv", "x"), ("A", "S1", "edited.csv", "12345678901234"),
                  ("A", "S1", "odd.csv", "x"), ("A", "S2", "unrecorded.csv", "x"), ("A", "S1", "unsealed.csv", "x"), ("A", "S1", "now.csv", "x"))
    cars = table(spark, CARS, ("A", "S1", "good.csv", "x", "c1"), ("A", "S1", "edited.csv", "abcdefghijklmn", None), ("A", "S1", "gone.csv", "x", "c2"),
                 ("A", "S2", "lost.csv", "x", None), ("A", "S1", "unsealed.csv", None, None), ("A", "S1", "now.csv", "x", None))
    rejects = table(spark, BAD_CARS, ("A", "S1", "odd.csv"), ("A", "S1", "odder.csv"))
    return files, au.paired(files, cars, rejects, table(spark, PLACES, ("A", "S1", "p1"), ("A", "S1", "p2")))


def test_files_and_sidecars_meet_once(spark, pairs):
    files, both = pairs
    assert found(au.artifact_issues(both)) == sorted([
        ("orphan", "A", "S1", "alone.csv", None), ("checksum_mismatch", "A", "S1", "edited.csv", "123456789012 is not abcdefghijkl"),
        ("missing_artifact", "A", "S1", "gone.csv", None), ("unreadable_sidecar", "A", "S1", "odd.csv", None),
        ("unreadable_sidecar", "A", "S1", "odder.csv", None)], key=str)
    assert {r.filename for r in both.where("checked").collect()} == {"good.csv", "edited.csv", "unsealed.csv", "now.csv"}


def test_a_reference_is_resolved_once_and_found_wrong_in_one_way(spark, pairs):
    files, both = pairs
    recorded = table(spark, PLACES, ("A", "S1", "p1"))
    names = table(spark, "archive string, run_id string, old_name string, current_name string", ("A", "S1", "old.csv", "now.csv"), ("A", "S1", "older.csv", "never.csv"))
    edge = lambda f, a=None, s=None, r=None, asset=None: ("A", "S1", f, a, s, r, asset, None, None)
    edges = table(spark, EDGES, edge("good.csv", r="good.csv"), edge("good.csv", r="alone.csv"), edge("good.csv", r="old.csv"), edge("good.csv", r="older.csv"),
                  edge("good.csv", s="S1"), edge("good.csv", s="S7"), edge("good.csv", s="S2", r="unrecorded.csv"), edge("good.csv", a="FAR", s="S7", r="x"),
                  edge("good.csv", a="NEAR", s="S7", r="x"), edge("good.csv", r="label.svg", asset="AF-1"))
    related = table(spark, "archive string, run_id string, ref_archive string, ref_session string, ref_file string",
                    ("A", "S1", None, "S1", None), ("A", "S1", None, "S8", None), ("A", "S1", "FAR", "S8", None))
    archives = table(spark, "archive string, reachable boolean", ("A", True), ("NEAR", True), ("FAR", False))
    targets = au.reference_targets(both, recorded, files, names)
    assert found(au.reference_issues(edges, related, archives, targets)) == sorted([
        ("self_reference", "A", "S1", "good.csv", None), ("renamed_ref", "A", "S1", "good.csv", "S1/old.csv -> now.csv"),
        ("dangling_derived_from", "A", "S1", "good.csv", "S1/older.csv"), ("dangling_derived_from", "A", "S1", "good.csv", "S7"),
        ("dangling_derived_from", "A", "S1", "good.csv", "S2/unrecorded.csv"), ("unresolved_cross_archive_ref", "A", "S1", "good.csv", "FAR"),
        ("dangling_related_run", "A", "S1", None, "S8"), ("unresolved_cross_archive_ref", "A", "S1", None, "FAR")], key=str)
    assert found(au.reference_issues(edges.limit(0), related.limit(0), archives, targets)) == []


def test_assets_and_references_to_them(spark):
    key = "archive string, asset_id string"
    records = table(spark, key + ", name string", ("A", "AF1", "a.svg"), ("A", "AF2", "b.svg"), ("A", "AF3", "c.svg"))
    folders = table(spark, key, *[("A", f"AF{i}") for i in (1, 1, 2, 3, 4, 5)])
    rejects = table(spark, key, ("A", "AF4"))
    live = table(spark, key + ", live_name string", ("A", "AF1", "a.svg"), ("A", "AF2", "bb.svg"), ("A", "AF5", "e.svg"))
    snapshots = table(spark, key + ", ord bigint, sha256 string, pending_gc boolean", ("A", "AF1", 1, "kept", False), ("A", "AF1", 2, "lost", False),
                      ("A", "AF1", 3, "freed", True), ("A", "AF4", 1, "unread", False))
    blobs = table(spark, "digest string", ("kept",))
    assert found(au.asset_issues(folders, records, rejects, live, snapshots, blobs)) == sorted([
        ("unreadable_asset", "A", None, "AF4", None), ("orphan_asset_dir", "A", None, "AF5", None), ("missing_asset_file", "A", None, "AF3", "c.svg"),
        ("unscanned_asset_rename", "A", None, "AF2", "b.svg -> bb.svg"), ("missing_asset_blob", "A", None, "AF1", "lost 2")], key=str)
    edge = lambda asset, sha, how: ("A", "S1", "f", None, None, "label", asset, sha, how)
    edges = table(spark, EDGES, edge("AF1", "kept", "pinned"), edge("AF1", "lost", "pinned"), edge("AF1", "lost", "observed"), edge("AF1", None, "pinned"),
                  edge("AF9", "kept", "pinned"), edge(None, None, None))
    assert found(au.asset_ref_issues(edges, records, blobs)) == sorted([
        ("missing_asset_blob", "A", "S1", "f", "AF1 @ lost"), ("unpinned_asset_ref", "A", "S1", "f", "AF1"), ("dangling_asset_ref", "A", "S1", "f", "AF9")], key=str)


def test_a_manifest_of_any_size_has_the_id_of_its_text(spark):
    size = 30_000
    big = spark.range(size).select(F.lit("big").alias("manifest"), F.lit("run.py").alias("entry"), F.concat(F.lit("dir/ü"), F.col("id")).alias("path"),
                                   F.col("id").cast("string").alias("blob"))
    odd = table(spark, "manifest string, entry string, path string, blob string", ("none", None, None, None), ("twice", "e", 'a"b', "x"), ("twice", "e", 'a"b', "x"),
                ("null blob", "e", "p", None), (None, "e", "p", "b"))
    got = {r.manifest: r.id for r in text.manifest_rows(big.unionByName(odd).repartition(7)).collect()}
    said = lambda entry, files: hashlib.sha256(json.dumps({"entry": entry, "files": files}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got == {"big": said("run.py", {f"dir/ü{i}": str(i) for i in range(size)}), "none": said(None, {}), "twice": said("e", {'a"b': "x"}),
                   "null blob": said("e", {"p": None})}
    assert text.manifest_rows(odd.limit(0)).count() == 0


def test_exports_that_are_not_made_say_why(spark):
    asked = table(spark, "archive string, request string", ("A", "r1"), ("A", "r1"), ("A", "r2"), ("I", "r1"), ("X", "r1"), ("A", "r3"))
    picked = table(spark, "archive string, request string, run_id string", ("A", "r1", "S1"), ("A", "r1", "S1"), ("A", "r1", "S2"), ("I", "r1", "I1"), ("A", "r3", None))
    archives = table(spark, "archive string, kind string", ("A", "standard"), ("I", "intake"))
    got = {(r.archive, r.request): (r.n_sessions, r.refused) for r in tr.export_requests(asked, picked, archives).collect()}
    assert got == {("A", "r1"): (2, None), ("A", "r2"): (0, "empty selection"), ("A", "r3"): (0, "empty selection"),
                   ("I", "r1"): (1, "intake ids are provisional, merge first"), ("X", "r1"): (0, "unknown archive")}
    assert tr.export_requests(asked.limit(0), picked, archives).count() == 0


def test_names_meet_before_anything_is_grouped_and_hashes_only_travel_where_they_differ(spark, pairs, capsys):
    _, both = pairs
    assert {r.filename: (r.sha256, r.actual_sha256) for r in both.where("sha256 is not null or actual_sha256 is not null").collect()} == {
        "edited.csv": ("abcdefghijklmn", "12345678901234")}
    files = table(spark, FILES, ("A", "S1", "a.csv", "0" * 64), ("A", "S1", "b.csv", "0" * 63 + "1"))
    cars = table(spark, CARS, ("A", "S1", "a.csv", "0" * 64, None), ("A", "S1", "b.csv", "f" * 64, None))
    real = au.paired(files, cars, table(spark, BAD_CARS, ("A", "S1", "z")), table(spark, PLACES, ("A", "S1", "p1")))
    assert found(au.artifact_issues(real))[0][-1] == "000000000000 is not ffffffffffff"
    capsys.readouterr()
    real.explain()
    plan = capsys.readouterr().out
    assert plan.index("partial_max") < plan.index("REPARTITION_BY_COL") and plan.rindex("partial_") < plan.index("REPARTITION_BY_COL")
