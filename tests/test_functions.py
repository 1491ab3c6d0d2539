"""Column functions against values worked out by hand or by plain Python."""

import hashlib
import json

from pyspark.sql import functions as F

from tracelake.functions import identity, ids, refs, text, times


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_references_in_every_spelling(spark):
    cases = {
        "raw.csv": (None, None, None, "raw.csv", None, None, None),
        " S-26-0012 ": (None, None, "S-26-0012", None, None, None, None),
        "S-26-0012 / raw.csv": (None, None, "S-26-0012", "raw.csv", None, None, None),
        "lab|S-26-0012/raw.csv": (None, "lab", "S-26-0012", "raw.csv", None, None, None),
        "AF-26-0017": (None, None, None, None, None, "AF-26-0017", None),
        "collections/big set": (None, None, None, None, "big set", None, None),
        "PROV://kai@lab/shared/S-26-0002/cal.json": ("kai@lab", "shared", "S-26-0002", "cal.json", None, None, None),
        "prov://kai@lab/shared": ("kai@lab", "shared", None, None, None, None, None),
        "prov://kai@lab/shared/assets/AF-26-0001": ("kai@lab", "shared", None, None, None, "AF-26-0001", None),
        "": (None,) * 6 + ("empty",),
        "a|b|c": (None,) * 6 + ("multiple_archive_separators",),
        "a/b/c": (None,) * 6 + ("too_many_segments",),
        "x|": (None,) * 6 + ("nothing_after_archive",),
        "prov://kai": (None,) * 6 + ("bad_uri",),
        "prov://k/a/s/f/g": (None,) * 6 + ("too_many_segments",),
        "prov://k/a/collections": (None,) * 6 + ("bad_sibling_uri",),
    }
    df = refs.parse_refs(spark.createDataFrame([(k,) for k in cases], "t string"), "t")
    got = {r.t: tuple(r[1:]) for r in df.collect()}
    assert got == cases


def test_canonical_spelling_is_shortest(spark):
    df = spark.createDataFrame([("S-26-0001 / a.csv",), ("AF-26-0001",), ("assets/AF-26-0001",), ("a/b/c",),
                                ("prov://u/A/S-26-0001/f",), ("A | x.csv",)], "t string")
    got = {r.t: r.canonical for r in refs.canonical_refs(df, "t").collect()}
    assert got == {"S-26-0001 / a.csv": "S-26-0001/a.csv", "AF-26-0001": "assets/AF-26-0001",
                   "assets/AF-26-0001": "assets/AF-26-0001", "a/b/c": None,
                   "prov://u/A/S-26-0001/f": "prov://u/A/S-26-0001/f", "A | x.csv": "A|x.csv"}


def test_ids(spark):
    rows = [("12",), ("26-0012",), ("s-26-0012",), ("I-26-7",), ("123456",), ("x",)]
    got = values(spark, rows, "t string", ids.expand_run_id(F.col("t"), 2026))
    assert [g[0] for g in got] == ["S-26-0012", "S-26-0012", "S-26-0012", "I-26-0007", "S-26-123456", None]
    got = values(spark, [("raw.csv",), ("data.tar.gz",), ("README",), (".hidden",)], "t string",
                 ids.duplicate_name(F.col("t"), F.lit(2)))
    assert [g[0] for g in got] == ["raw-002.csv", "data.tar-002.gz", "README-002", ".hidden-002"]


def test_manifest_id_equals_canonical_json(spark):
    files = {"b/é.py": "1" * 64, "a/x\".py": "2" * 64, "a/😀.py": "3" * 64}
    want = hashlib.sha256(json.dumps({"entry": "a/x", "files": files}, sort_keys=True,
                                     separators=(",", ":")).encode()).hexdigest()
    row = (("a/x", [(k, v) for k, v in files.items()]),)
    got = values(spark, row, "entry string, files array<struct<path:string,blob:string>>",
                 text.manifest_id(F.col("entry"), F.col("files")))
    assert got == [(want,)]


def test_sizes_round_half_to_even(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 5 * 1024 ** 3, 2 * 1024 ** 5]
    got = [g[0] for g in values(spark, [(s,) for s in sizes], "n bigint", text.human_size(F.col("n")))]
    assert got == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "5.0 GB", "2048.0 TB"]


def test_orcid_check_digit(spark):
    rows = [("0000-0002-1825-0097@orcid.org",), ("0000-0002-1825-0098@orcid.org",), ("grant",), ("x@localid",), ("a b",)]
    got = values(spark, rows, "t string", identity.identity_error(F.col("t")), identity.identity_warning(F.col("t")))
    assert got == [(None, None), ("bad_orcid_check_digit", None), (None, "local_only"), ("alias_reserved", None),
                   ("illegal_character", None)]


def test_tags_and_durations(spark):
    got = values(spark, [(["  a   b ", "a b", "x,y", "", " c"],)], "t array<string>",
                 text.clean_tags(F.col("t")), text.bad_tags(F.col("t")))
    assert got == [(["a b", "c"], ["x,y", ""])]
    got = values(spark, [("2h",), ("1.5d",), ("45",), ("soon",)], "t string", times.duration_seconds(F.col("t")))
    assert [g[0] for g in got] == [7200.0, 129600.0, 45.0, None]


def test_hold_states(spark):
    now = F.lit("2026-01-01T00:00:00+00:00").cast("timestamp")
    rows = [("forever",), ("2026-01-01T00:30:00+01:00",), ("2026-01-02T00:00:00+00:00",), ("junk",), (None,)]
    got = values(spark, rows, "h string", times.hold_active(F.col("h"), now), times.hold_garbled(F.col("h")))
    assert got == [(True, False), (False, False), (True, False), (False, True), (False, False)]


def test_hashes_as_bytes_are_told_apart_and_come_back(spark):
    texts = [None, "", "ab", "é" * 3, "0123456789abcdef" * 4, "0123456789ABCDEF" * 4, "0" * 64, "g" * 64, "a" * 63, "a" * 64 + "\n"]
    packed = text.hash_bytes(F.col("t"))
    got = values(spark, [(t,) for t in texts], "t string", "t", text.hash_text(packed), packed)
    assert [u for _, u, _ in got] == texts
    assert len({bytes(b) for _, _, b in got if b is not None}) == len(texts) - 1 and len(got[4][2]) == 33
