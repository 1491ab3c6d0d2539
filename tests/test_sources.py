"""Reading a real file tree, and the writers."""

import json
import os

from pyspark.sql import functions as F

from tracelake.sources import documents as dc
from tracelake.sources import sinks


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def tree(root):
    put(root, "data/2026/S-26-0001/session.yaml", "run_id: S-26-0001\ncreated: 2026-01-02T03:04:05+01:00\nstatus: open\n")
    put(root, "data/2026/S-26-0001/raw.csv", "1,2\n")
    put(root, "data/2026/S-26-0001/raw.csv.meta.json", json.dumps(
        {"created": "2026-01-02", "produced_by": {"repo": "r"}, "derived_from": [{"file": "x"}], "future": 1}))
    put(root, "data/2026/S-26-0001/bad.csv.meta.json", "{")
    put(root, "data/2026/S-26-0001/.trash/old.csv.meta.json", json.dumps({"created": "2025", "produced_by": {"source": "external"}}))
    put(root, "data/misc/S-26-0002/x.csv", "no year")
    put(root, "data/2026/S-26-0003/session.yaml", "run_id: [")


def test_file_tree(spark, tmp_path):
    root = str(tmp_path / "lake")
    tree(root)
    names = dc.file_inventory(dc.scan_files(spark, root), F.lit("lake")).select("run_id", "name", "role").collect()
    assert {tuple(r) for r in names} == {
        ("S-26-0001", "session.yaml", "session"), ("S-26-0001", "raw.csv", "data"), ("S-26-0001", "raw.csv.meta.json", "sidecar"),
        ("S-26-0001", "bad.csv.meta.json", "sidecar"), ("S-26-0003", "session.yaml", "session")}
    cars, rejects = dc.parse_sidecars(dc.scan_documents(spark, root, "*.meta.json"))
    (car,) = cars.collect()
    assert (car.source, car.source_recorded, car.extra, car.derived_from[0].file) == ("script", False, {"future": "1"}, "x")
    assert rejects.count() == 1
    (old,) = dc.parse_sidecars(dc.scan_trash(spark, root))[0].collect()
    assert old.source_recorded and ".trash" in old.path
    good, bad = dc.parse_sessions(dc.scan_documents(spark, root, "session.yaml"))
    assert [(r.record_id, r.created) for r in good.collect()] == [("S-26-0001", "2026-01-02T03:04:05+01:00")]
    assert bad.count() == 1


def test_catalog_is_partitioned_on_disk(spark, tmp_path):
    table = spark.createDataFrame([("A", 2025, 1), ("A", 2026, 2)], "archive string, year int, v int")
    sinks.write_catalog({"t": table}, str(tmp_path / "cat"))
    assert os.path.isdir(tmp_path / "cat/t/archive=A/year=2026")
    assert spark.read.parquet(str(tmp_path / "cat/t")).where("year = 2026").select("v").collect()[0].v == 2
