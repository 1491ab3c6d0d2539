"""Sweeps of listing generations, on one checkpoint, against the batch form."""

import pytest
from pyspark.sql import functions as F

from tracelake.operators.refresh import session_signatures
from tracelake.plans import streams
from tracelake.streaming import sweep

STATS = "archive string, year int, run_id string, name string, size bigint, mtime string"
FIRST = [("A", 2024, "S1", "session.yaml", 10, "t"), ("A", 2024, "S1", "a.meta.json", 5, "u"), ("A", 2024, "S2", "session.yaml", 7, "t"),
         ("A", 2023, "S0", "session.yaml", 1, "t"), ("B c/d", 2024, "S1", "session.yaml", 3, "t")]


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "listings").mkdir()
    stream = spark.readStream.schema(sweep.ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/listings")
    archives = spark.createDataFrame([("A",), ("B c/d",)], "archive string")

    class Place:
        index = f"{tmp_path}/index"

        def put(self, rows, generation, names=None):
            listed = archives if names is None else archives.where(F.col("archive").isin(*names))
            whole = sweep.stamped(spark.createDataFrame(rows, STATS), generation, listed)
            return whole.repartition(3)

        def list(self, *args):
            self.put(*args).write.mode("append").parquet(f"{tmp_path}/listings")

        def write(self, rows):
            rows.write.mode("append").parquet(f"{tmp_path}/listings")

        def sweep(self):
            sweep.sweep(stream, self.index, f"{tmp_path}/gathered", f"{tmp_path}/checkpoint")
            return {(r.archive, r.year, r.run_id): r.sig for r in sweep.read_index(spark, self.index).collect()}

        def batch(self, rows):
            got = session_signatures(spark.createDataFrame(rows, STATS)).collect()
            return {(r.archive, r.year, r.run_id): r.sig for r in got}

        def gathered(self):
            return spark.read.schema(sweep.ROW).parquet(f"{tmp_path}/gathered").count()

    return Place()


def test_sweeps_on_one_checkpoint_are_those_of_the_batch_form(place):
    edited = [(*r[:4], 99, r[5]) if r[3] == "a.meta.json" else r for r in FIRST]
    vanished = [r for r in edited if r[2] == "S1"]
    for generation, rows in enumerate((FIRST, edited, vanished, vanished[:1], FIRST), 1):
        place.list(rows, generation)
        assert place.sweep() == place.batch(rows)
        assert place.gathered() == 0, "listings that were taken are forgotten"
    assert place.sweep() == place.batch(FIRST), "nothing new, nothing changes"


def test_empty_archives_can_be_swept_again_and_again(place):
    for generation, rows in enumerate(([], [], FIRST, [], []), 1):
        place.list(rows, generation)
        assert place.sweep() == place.batch(rows)


def test_a_listing_waits_until_it_is_whole_and_an_older_one_is_passed_over(place):
    place.list(FIRST, 5)
    place.sweep()
    half = place.put(FIRST[:2], 7)
    place.write(half.where("rows is null"))
    assert place.sweep() == place.batch(FIRST)
    place.list(FIRST[:1], 6)
    assert place.sweep() == place.batch(FIRST[:1])
    place.write(half.where("rows is not null"))
    assert place.sweep() == place.batch(FIRST[:2])
    place.list(FIRST, 4)
    assert place.sweep() == place.batch(FIRST[:2])


def test_archives_are_swept_apart(place):
    place.list(FIRST, 1)
    place.sweep()
    place.list([r for r in FIRST[:1]], 2, ["A"])
    assert place.sweep() == place.batch([FIRST[0], FIRST[4]])
    place.list([], 9, ["B c/d"])
    assert place.sweep() == place.batch(FIRST[:1])


def test_a_listing_is_written_in_files_enough_for_all_cores_in_each_batch(spark, tmp_path):
    rows = spark.range(4000).select(F.lit(1).cast("bigint").alias("generation"), F.col("id").cast("string").alias("run_id"))
    streams.append_listing(rows, f"{tmp_path}/listings")
    back = spark.read.parquet(f"{tmp_path}/listings")
    files = back.select(F.col("_metadata.file_path").alias("f")).distinct().count()
    assert files // 2 >= spark.sparkContext.defaultParallelism
    assert back.select("run_id").distinct().count() == 4000


def test_folders_of_gathered_files_are_named_once_a_file(spark, place, tmp_path):
    place.put(FIRST, 1).write.partitionBy("archive").parquet(f"{tmp_path}/kept")
    rows = spark.read.schema(sweep.ROW).parquet(f"{tmp_path}/kept")
    found = sweep.folders_of(rows)
    assert found.count() == rows.select("archive").distinct().count()
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # The cutting of names lies above the aggregate that leaves one row for each file.
    cut = max(i for i, x in enumerate(lines) if "regexp_replace" in x)
    assert any("Aggregate" in x for x in lines[cut + 1:])
