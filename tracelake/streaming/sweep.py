"""The freshness sweep as a stream of listing generations.

Whoever lists an archive stamps the rows of one listing with a generation, a number that grows with every listing of the
archive, and closes it with a row that says how many there are. Rows may come in any batches and any order. A sweep
takes, for each archive, its newest generation that is whole; what came before is forgotten, what is not whole yet
waits. So a file that is gone is simply not in the newest listing, and an archive that has become empty still has a
closing row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.operators.refresh import apply_changes, diff, session_signatures, write_changed_years
from tracelake.session import stage

KEY = ["archive", "year", "run_id"]
#: A row of a listing, or with ``rows`` the one that closes it.
ROW = "generation bigint, archive string, year int, run_id string, name string, size bigint, mtime string, rows bigint"
INDEX = "run_id string, sig string, archive string, year int"
APPLIED = "archive string, generation bigint"


def stamped(listing: DataFrame, generation: int, archives: DataFrame) -> DataFrame:
    """A listing as rows of the stream; ``archives`` says which archives it lists, empty ones too."""
    rows = listing.select(F.lit(generation).cast("bigint").alias("generation"), "archive", F.col("year").cast("int").alias("year"),
                          "run_id", "name", F.col("size").cast("bigint").alias("size"), F.col("mtime").cast("string").alias("mtime"),
                          F.lit(None).cast("bigint").alias("rows"))
    counts = listing.groupBy("archive").agg(F.count(F.lit(1)).alias("_n"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    closing = archives.select("archive").distinct().join(counts, "archive", "left").select(
        F.lit(generation).cast("bigint").alias("generation"), "archive", none("int", "year"), none("string", "run_id"),
        none("string", "name"), none("bigint", "size"), none("string", "mtime"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("rows"))
    return rows.unionByName(closing)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The index (archive, year, run_id, sig); one without rows has its columns too."""
    return spark.read.schema(INDEX).parquet(index).select(*KEY, "sig")


def refresh(listing: DataFrame, index: str, archives: DataFrame | None = None) -> None:
    """Bring the index at ``index`` up to date with a whole listing of ``archives``, or of all there are.

    ``listing`` (archive, year, run_id, name, size, mtime) holds every session these archives have: their sessions that it
    lacks are forgotten, other archives stay as they are. Only partitions with a changed session are rewritten, so
    doing it again changes nothing.
    """
    spark = listing.sparkSession
    live = stage(session_signatures(listing).select("run_id", "sig", "archive", F.col("year").cast("int").alias("year")), "sweep-live")
    if not exists(spark, index):
        live.hint("rebalance", "archive", "year").write.partitionBy("archive", "year").parquet(index)
        return
    table = read_index(spark, index)
    swept = table if archives is None else table.join(archives.select("archive").distinct(), "archive", "left_semi")
    changes = stage(diff(swept, live, KEY).where("change <> 'unchanged'"), "sweep-changes")
    if changes.isEmpty():
        return
    years = changes.select("archive", "year").distinct()
    touched = table.join(years, ["archive", "year"], "left_semi")
    # Written aside first: the partitions read here are those about to be replaced.
    after = stage(apply_changes(touched, changes, live), "sweep-after")
    write_changed_years(after.select("run_id", "sig", "archive", F.col("year").cast("int")), changes, index)


def gather(stats: DataFrame, gathered: str, checkpoint: str) -> StreamingQuery:
    """Store a stream of listing rows, as far as there is data now, apart by archive and generation.

    A batch that is run again replaces what it wrote before. Where batches end means nothing: a session's files may
    come in several of them.
    """
    def keep(batch: DataFrame, number: int) -> None:
        (batch.withColumn("_archive", F.col("archive")).withColumn("_generation", F.col("generation"))
         .write.mode("overwrite").partitionBy("_archive", "_generation").parquet(f"{gathered}/batch={number}"))

    return (stats.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def whole(rows: DataFrame, applied: DataFrame) -> DataFrame:
    """(archive, generation): the newest whole listing of each archive, if it is newer than the one applied."""
    counts = rows.groupBy("archive", "generation").agg(
        F.count_if(F.col("rows").isNull()).alias("came"), F.max("rows").alias("told"))
    newest = counts.where("came = told").groupBy("archive").agg(F.max("generation").alias("generation"))
    last = applied.groupBy("archive").agg(F.max("generation").alias("_last"))
    return newest.join(last, "archive", "left").where("_last is null or generation > _last").select("archive", "generation")


def folders_of(rows: DataFrame) -> DataFrame:
    """One row for each folder of a batch, archive and generation, not for the rows in it; names are cut once a file."""
    # Counted and not only made distinct, which Spark would merge with the distinct below and cut the names of all rows.
    files = rows.groupBy("archive", "generation", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return files.select("archive", "generation", F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct()


def forget(rows: DataFrame, taken: DataFrame) -> None:
    """Remove the folders of listings that are as old as the ones taken."""
    old = folders_of(rows).join(taken.withColumnRenamed("generation", "_taken"), "archive").where("generation <= _taken")
    folders = old.select("folder").toLocalIterator()
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in folders:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row.folder))
        place.getFileSystem(conf).delete(place, True)


def sweep(stats: DataFrame, index: str, gathered: str, checkpoint: str) -> None:
    """One sweep: gather all rows that are there, then compare the newest whole listings with the index.

    Which listing was applied to an archive is written down after the index has been brought up to date; a sweep
    that was cut off in between does the same work again, which changes nothing.
    """
    gather(stats, gathered, checkpoint).awaitTermination()
    spark, log = stats.sparkSession, f"{gathered}-applied"
    if not exists(spark, gathered):
        return
    rows = spark.read.schema(ROW).parquet(gathered)
    applied = spark.read.schema(APPLIED).parquet(log) if exists(spark, log) else spark.createDataFrame([], APPLIED)
    taken = stage(whole(rows, applied), "sweep-taken")
    if taken.isEmpty():
        return
    listing = rows.where("rows is null").join(taken, ["archive", "generation"], "left_semi")
    refresh(listing, index, taken)
    taken.write.mode("append").parquet(log)
    forget(rows, taken)
