"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Runtime settings every plan here relies on. All can be set on a running
#: session, so they also apply to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even when a later aggregate would have liked to
    # reuse its partitioning: one more shuffle is cheaper than one hot task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Staged tables are compact: a task sorts many times the bytes it reads,
    # and spills if it reads much. Shuffles start fine and are coalesced less;
    # up to 200 partitions are written without a buffer that could spill.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # What a job shuffled goes when the job ends, not when the driver next
    # happens to collect garbage: plans here are many jobs on staged tables.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  driver_memory: str = "16g") -> SparkSession:
    """A session for tests and local benchmarks."""
    spark = (
        SparkSession.builder.master(master)
        .appName("tracelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a
    cluster session without it is refused, since a driver-local folder would
    be invisible to the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.TemporaryDirectory(prefix="tracelake-")
    return _local_folders[app].name


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage of iterative plans, survives the loss of executors,
    and gives the optimizer a measured size, so that later joins broadcast the
    table only when it is really small.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/tracelake-{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # The schema read back is the one written, so no inference job runs.
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As :func:`stage`, with the number of rows, counted while they are written."""
    seen = Observation()
    out = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return out, seen.get["rows"]
