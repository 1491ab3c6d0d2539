"""Archives written as files and read back."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tracelake.session import stage, tune
from tracelake.sources import documents as dc
from tracelake.sources import trees
from tracelake.sources.bindings import Catalog

FILES = [
    ("A/data/2024/S-24-0001/session.yaml", "run_id: S-24-0001\ncreated: '2024'\nstatus: open\n"), ("A/data/2024/S-24-0001/a.csv", "12345"),
    ("A/data/2024/S-24-0001/a.csv.meta.json", '{"created": "2024", "sha256": "x"}'), ("A/data/2024/S-24-0001/.trash/b.csv.meta.json", '{"created": "2024"}'),
    ("A/data/2024/S-24-0001/.hidden", "h"), ("A/data/2024/S-24-0002/.keep", ""), ("A/data/2024/.seal.yaml", "digest: d\nsessions: 2\n"),
    ("A/data/2024/not a session/x.csv", "x"), ("A/data/misc/S-24-0009/x.csv", "x"), ("A b/data/2023/S-23-0001/session.yaml", "run_id: [broken"),
    ("A/assets/AF-24-0001/asset.json", '{"id": "AF-24-0001"}'), ("A/assets/AF-24-0001/fig.svg", "<svg/>"), ("A/assets/AF-24-0002/fig.svg", "<svg/>"),
    ("A/code/manifests/m1.json", '{"entry": "main.py", "files": {"main.py": "b1"}}'), ("A/code/blobs/b1/b1c2", "print()"), ("A/code/blobs/.tmp", "x"),
]


@pytest.fixture
def tree(spark, tmp_path):
    trees.write_documents(spark.createDataFrame(FILES, "path string, content string").repartition(3), str(tmp_path))
    return trees.read_tree(spark, str(tmp_path), content=True, shares=3)


def test_a_written_tree_is_read_back_whole(tree, tmp_path):
    got = {r.path.removeprefix(f"{tmp_path}/"): r.size for r in tree.where("name is not null").collect()}
    assert got == {p: len(c) for p, c in FILES if "/misc/" not in p}
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".")], "no journals are left"


def test_sessions_trash_seals_assets_and_code_are_found(tree):
    rows = sorted((r.archive, r.year, r.run_id, r.name, r.role, r.trashed) for r in trees.session_files(tree).collect())
    assert rows == [("A", 2024, "S-24-0001", "a.csv", "data", False), ("A", 2024, "S-24-0001", "a.csv.meta.json", "sidecar", False),
                    ("A", 2024, "S-24-0001", "b.csv.meta.json", "sidecar", True), ("A", 2024, "S-24-0001", "session.yaml", "session", False),
                    ("A b", 2023, "S-23-0001", "session.yaml", "session", False)]
    assert {r.run_id for r in trees.session_folders(tree).collect()} == {"S-24-0001", "S-24-0002", "S-23-0001"}
    good, bad = dc.parse_sidecars(trees.sidecar_documents(tree))
    assert {(r.filename, r.trashed) for r in good.collect()} == {("a.csv", False), ("b.csv", True)} and bad.count() == 0
    good, bad = dc.parse_sessions(trees.session_documents(tree))
    assert [r.record_id for r in good.collect()] == ["S-24-0001"] and [r.folder for r in bad.collect()] == ["S-23-0001"]
    assert [tuple(r) for r in dc.parse_seals(trees.seal_documents(tree)).select("archive", "year", "digest", "sessions").collect()] == [("A", 2024, "d", 2)]
    assert [r.folder for r in trees.asset_documents(tree).collect()] == ["AF-24-0001"]
    assert [tuple(r) for r in trees.blobs(tree).collect()] == [("A", "b1c2", 7)]
    assert [tuple(r) for r in dc.parse_manifests(trees.manifest_documents(tree).drop("archive")).collect()] == [("m1", "main.py", "main.py", "b1")]


def test_years_and_archives_are_left_out_before_they_are_listed(spark, tree, tmp_path):
    reader = trees.TreeReader({"path": str(tmp_path), "shares": "2"})
    every = reader.partitions()
    left = list(reader.pushFilters([trees.EqualTo(("year",), 2023), trees.EqualTo(("name",), "x")]))
    assert [f.attribute for f in left] == [("name",)]
    assert {(s.archive, s.year) for s in reader.partitions()} == {("A b", 2023)} and len(every) > 2
    assert {r.archive for r in tree.where("year = 2023").collect()} == {"A b"}
    assert {r.year for r in tree.where(F.col("year").isin(2024) & (F.col("archive") == "A")).collect()} == {2024}


def test_a_job_that_fails_takes_its_documents_back(spark, tmp_path):
    writer = trees.DocumentWriter({"path": str(tmp_path)})
    for n in (1, 2):
        (tmp_path / f"{n}.txt").write_text("x")
        (tmp_path / f".journal-{n}").write_text(f"{n}.txt")
    writer.abort([trees.Written(f"{tmp_path}/.journal-1", 1), None])
    assert sorted(os.listdir(tmp_path)) == [".journal-2", "2.txt"]
    writer.commit([trees.Written(f"{tmp_path}/.journal-2", 1)])
    assert os.listdir(tmp_path) == ["2.txt"]


def test_an_empty_root_has_no_rows(spark, tmp_path):
    assert trees.read_tree(spark, f"{tmp_path}/nowhere").count() == 0


def read_names(spark, path, **asked):
    return trees.read_tree(spark, str(path), shares=3, **asked)


def test_packs_list_as_the_files_they_hold(spark, tree, tmp_path, tmp_path_factory):
    packed = tmp_path_factory.mktemp("packed")
    trees.write_documents(spark.createDataFrame(FILES, "path string, content string").repartition(3), str(packed), packed=True)
    wanted = ("archive", "area", "year", "owner", "trashed", "name", "size", "content")
    for asked in ({}, {"content": True}, {"content": True, "area": "data", "suffix": ".meta.json"}, {"area": "assets"}):
        loose, got = ({tuple(r[c] for c in wanted) + (r.path.removeprefix(f"{root}/"),) for r in read_names(spark, root, **asked).collect()}
                      for root in (tmp_path, packed))
        assert loose == got and loose, asked
    rows = read_names(spark, packed).where("name is not null").collect()
    assert len(rows) == len({r.path for r in rows}) and all(r.mtime is not None for r in rows)
    assert sorted(tuple(r) for r in trees.session_folders(read_names(spark, packed)).select("archive", "run_id").collect()) == sorted(
        tuple(r) for r in trees.session_folders(tree).select("archive", "run_id").collect()), "a folder in several packs is one"


def test_a_tree_of_many_records_takes_few_files(spark, tmp_path):
    texts = spark.range(0, 20000, numPartitions=4).selectExpr(
        "concat('A/data/', 2020 + id % 3, '/S-24-', lpad(id % 500, 4, '0'), '/f-', id, '.csv.meta.json') as path", "concat('{\"created\": \"', id, '\"}') as content")
    trees.write_documents(texts, str(tmp_path), packed=True)
    files = [f"{at}/{n}" for at, _, names in os.walk(tmp_path) for n in names]
    assert len(files) == 12 and all("/.pack-" in f for f in files)
    good, bad = dc.parse_sidecars(trees.sidecar_documents(trees.read_tree(spark, str(tmp_path), content=True, shares=2)))
    assert bad.count() == 0 and good.selectExpr("count(*)", "sum(created)").first()[:] == (20000, sum(range(20000)))


def test_packs_are_closed_and_opened_again_within_their_limits(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    for name, most in (("GROUP_BYTES", 200), ("HELD_BYTES", 400), ("PACK_BYTES", 500), ("OPEN_PACKS", 2)):
        monkeypatch.setattr(trees, name, most)
    writer = trees.PackWriter({"path": str(tmp_path)})
    paths = [f"A/data/{2000 + i % 7}/S-24-0001/f{i}.csv" for i in range(300)] + [None, "A/notes.txt"]
    message = writer.write(iter([pa.RecordBatch.from_pydict({"path": paths[k:k + 50], "content": ["x" * 9] * len(paths[k:k + 50])},
                                                            pa.schema([("path", pa.string()), ("content", pa.string())])) for k in range(0, len(paths), 50)]))
    assert len(message.drafts) > 8 and trees.read_tree(spark, str(tmp_path)).where("name like 'f%'").count() == 0, "nothing shows before the commit"
    writer.commit([message, None])
    assert {r.path.removeprefix(f"{tmp_path}/") for r in trees.read_tree(spark, str(tmp_path)).where("name like 'f%'").collect()} == set(paths[:300])
    again = trees.PackWriter({"path": str(tmp_path)})
    again.abort([again.write(iter([pa.RecordBatch.from_pydict({"path": ["A/data/2000/S-24-0002/g.csv"], "content": [None]}, pa.schema([("path", pa.string()), ("content", pa.string())]))])), None])
    assert not [n for _, _, names in os.walk(tmp_path) for n in names if n.startswith(".draft-")]


def test_sidecars_meet_their_references_before_hashes_are_made(spark):
    """What is shuffled is what hashes are made from; the rows are those of a join with finished sidecars."""
    node = ["archive", "run_id", "filename"]
    named = spark.createDataFrame(
        [("A", "S-1", 1994, i, 1, 10 + i, 20 + i, 1 + i % 3, f"line-{i % 3}.csv", float(q), d, 0.01, f, "1994-01-02", p) for i, (q, d, f, p) in enumerate((
            (1, 0.1, "N", 1), (25, 0.02, "R", 2), (49, 0.1, "A", 1), (50, 0.1, "N", 3), (5, 0.0, "N", 1), (7, 0.1, "R", 1)))] + [
            (None, "S-2", 1995, 9, 1, 3, 4, 2, "line-2.csv", 3.0, 0.1, 0.01, None, "1995-01-02", 1)],
        "archive string, run_id string, year int, orderkey bigint, custkey bigint, partkey bigint, suppkey bigint, line int, requested string, "
        "quantity double, discount double, tax double, flag string, ship_day string, pos bigint")
    cat = Catalog(spark, "nowhere")
    cat._frames["named"] = named
    more = cat.sidecars.select(*node).limit(4).withColumn("refs", F.lit("x")).localCheckpoint()
    got, want = cat.sidecars_with(more), cat.sidecars.join(more, node, "left")
    columns = want.columns
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.collect())) and got.count() == 6
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan.split("Join")[0] and "sha2" not in plan.split("Join", 1)[1]


def test_what_a_job_shuffled_goes_when_it_ends(spark):
    tune(spark)
    blocks = lambda: {str(b) for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if str(b).startswith("shuffle_")}
    before = blocks()
    table = stage(spark.range(1000).repartition(3, "id"), "shuffled")
    until = time.time() + 20
    while blocks() - before and time.time() < until:
        time.sleep(0.2)
    assert not blocks() - before and table.count() == 1000
    # A plan whose shuffles are gone can still be run again.
    again = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, again.collect()))
