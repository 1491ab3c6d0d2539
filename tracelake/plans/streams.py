"""Streaming forms, run to the end of the data there is."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracelake.plans.registry import CHECKS, query
from tracelake.plans.store import INDEXED, LIVE, capped_of
from tracelake.session import stage, staging_root
from tracelake.streaming import snapshots, sweep


def _places(cat, label: str) -> tuple[str, str]:
    root = f"{staging_root(cat.spark)}/tracelake-{label}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


@query("n02_streaming_snapshots", None)
def streaming_snapshots(cat):
    """The event table as a stream, at most one snapshot per asset and period."""
    looks = (
        cat.spark.readStream.schema(cat.events.schema).option("pathGlobFilter", "events.parquet").parquet(cat.folder)
        .select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
        .join(capped_of(cat).select("custkey", "archive", "asset_id", "days"), F.col("user_id") == F.col("custkey"))
        .select(F.concat_ws("|", "archive", "asset_id").alias("asset_id"), "ts", "event_id", "days")
    )
    out, checkpoint = _places(cat, "stream")
    snapshots.start(looks, out, checkpoint).awaitTermination()
    got = cat.spark.read.schema("asset_id string, ts timestamp, event_id bigint").parquet(out)
    return got.select(F.split_part("asset_id", F.lit("|"), F.lit(1)).alias("archive"),
                      F.split_part("asset_id", F.lit("|"), F.lit(2)).alias("asset_id"), "event_id")


def files_of_listing(spark) -> int:
    """How many files a listing is written in; half of them make a batch, so that each keeps all cores busy."""
    return max(4, 2 * spark.sparkContext.defaultParallelism)


def append_listing(rows, listings: str) -> None:
    """Add a listing to the folder that is read as a stream, in files that come in several batches."""
    rows.repartition(files_of_listing(rows.sparkSession)).write.mode("append").parquet(listings)


CHECKS["n02_streaming_snapshots"] = CHECKS["n02_rate_limited_snapshots"]


@query("n01_streaming_sweep", f"""with {LIVE}, {INDEXED} select 1 as sweep, archive, year, run_id, sig from indexed
union all select 2, archive, year, run_id, sig from live where archive <> 'AFRICA' and year <> 1996
union all select 3, archive, year, run_id, sig from live""")
def streaming_sweep(cat):
    """Three sweeps on one checkpoint: the index as it was, a listing that lacks an archive and a year, and all of it again."""
    spark = cat.spark
    out, checkpoint = _places(cat, "sweep")
    listings, gathered = _places(cat, "listings")
    archives, seen = cat.archives.select("archive"), []
    for number, listing in enumerate((cat.indexed_stats, cat.live_stats.where("archive <> 'AFRICA' and year <> 1996"), cat.live_stats), 1):
        append_listing(sweep.stamped(listing, number, archives), listings)
        stream = spark.readStream.schema(sweep.ROW).option("maxFilesPerTrigger", files_of_listing(spark) // 2).parquet(listings)
        sweep.sweep(stream, out, gathered, checkpoint)
        seen.append(stage(sweep.read_index(spark, out), "swept").select(F.lit(number).alias("sweep"), *sweep.KEY, "sig"))
    return seen[0].unionByName(seen[1]).unionByName(seen[2])
