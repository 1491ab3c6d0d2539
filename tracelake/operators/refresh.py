"""Signatures, catalog diffs, seals and the incremental sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.text import SIDECAR_SUFFIX
from tracelake.operators.items import SESSION
from tracelake.operators.skew import multiset_hash

SESSION_FILE = "session.yaml"


def _finish(count: Column, sums: list[Column]) -> Column:
    return F.sha2(F.concat_ws(":", count.cast("string"), *[s.cast("string") for s in sums]), 256)


def session_signatures(stats: DataFrame) -> DataFrame:
    """Fingerprint of each session's record and sidecars, without reading them (A10).

    ``stats``: archive, year, run_id, name, size, mtime. Only names, sizes and
    times count; data files and notes do not. The fingerprint does not depend on
    order, so it is summed on the map side whatever a session holds.
    """
    counted = stats.where((F.col("name") == SESSION_FILE) | F.col("name").endswith(SIDECAR_SUFFIX))
    line = F.concat_ws(":", F.col("name"), F.col("size").cast("string"), F.col("mtime"))
    a, b = multiset_hash(line)
    return (
        counted.groupBy("archive", "year", "run_id")
        .agg(F.count("*").alias("_n"), a.alias("_a"), b.alias("_b"))
        .select("archive", "year", "run_id", _finish(F.col("_n"), [F.col("_a"), F.col("_b")]).alias("sig"))
    )


def asset_signatures(assets: DataFrame) -> DataFrame:
    """Fingerprint of each asset record; the asset's own bytes do not count."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in
              ("name", "created", "scanned_at", "policy", "size", "sha256")]
    return assets.select("archive", "asset_id", F.sha2(F.concat_ws("|", *fields), 256).alias("sig"))


def year_digests(signatures: DataFrame) -> DataFrame:
    """Digest and number of sessions of each (archive, year)."""
    a, b = multiset_hash(F.concat_ws(":", "run_id", "sig"))
    return (
        signatures.groupBy("archive", "year")
        .agg(F.count("*").alias("sessions"), a.alias("_a"), b.alias("_b"))
        .select("archive", "year", "sessions", _finish(F.col("sessions"), [F.col("_a"), F.col("_b")]).alias("digest"))
    )


def diff(indexed: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """added / updated / removed / unchanged by signature.

    A live row without a signature counts as updated: nothing vouches for it.
    """
    old = indexed.select(*key, F.col("sig").alias("indexed_sig"), F.lit(True).alias("_old"))
    new = live.select(*key, F.col("sig").alias("live_sig"), F.lit(True).alias("_new"))
    blank = F.coalesce(F.col("live_sig"), F.lit("")) == ""
    return (
        old.join(new, key, "full_outer")
        .withColumn("change", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
                    .when(blank | ~F.col("indexed_sig").eqNullSafe(F.col("live_sig")), "updated")
                    .otherwise("unchanged"))
        .drop("_old", "_new")
    )


def vanished_years(indexed: DataFrame, live: DataFrame) -> DataFrame:
    """Indexed years that no longer exist."""
    return (indexed.groupBy("archive", "year").agg(F.count("*").alias("sessions"))
            .join(live.select("archive", "year"), ["archive", "year"], "left_anti"))


def trusted_years(seals: DataFrame, indexed_seals: DataFrame) -> DataFrame:
    """Years a sweep may skip: sealed, and indexed under exactly that seal."""
    return seals.select("archive", "year", "digest").join(
        indexed_seals.select("archive", "year", "digest"), ["archive", "year", "digest"], "left_semi"
    ).select("archive", "year")


def session_index_state(live: DataFrame, indexed: DataFrame, seals: DataFrame,
                        indexed_seals: DataFrame) -> DataFrame:
    """What the index believes about each live session."""
    known = indexed.select(*SESSION, F.col("sig").alias("indexed_sig"))
    sealed = seals.select("archive", "year", F.lit(True).alias("_sealed"))
    trusted = trusted_years(seals, indexed_seals).withColumn("_skip", F.lit(True))
    return (
        live.withColumnRenamed("sig", "live_sig").join(known, SESSION, "left")
        .join(sealed, ["archive", "year"], "left").join(trusted, ["archive", "year"], "left")
        .select("archive", "year", "run_id", F.col("indexed_sig").isNotNull().alias("indexed"),
                (F.col("indexed_sig") == F.col("live_sig")).alias("in_sync"),
                F.coalesce("_sealed", F.lit(False)).alias("sealed"),
                F.coalesce("_skip", F.lit(False)).alias("skipped_by_seal"))
    )


def seal_years(sessions: DataFrame, signatures: DataFrame, this_year: int, sealed_at: str,
               force: bool = False) -> DataFrame:
    """Seals for every year that may be sealed, and why others may not.

    ``sessions``: archive, year, run_id, status of every session folder; a null
    status is an unreadable record, which cannot be sealed either.
    """
    state = sessions.groupBy("archive", "year").agg(
        F.count_if(F.coalesce("status", F.lit("open")) == "open").alias("unfinished"))
    refused = F.when(F.lit(force), F.lit(None)).when(F.col("year") == this_year, "current year").when(
        F.col("unfinished") > 0, F.concat(F.col("unfinished").cast("string"), F.lit(" unfinished sessions")))
    return year_digests(signatures).join(state, ["archive", "year"], "left").select(
        "archive", "year", "digest", "sessions", F.lit(sealed_at).alias("sealed"), refused.alias("refused"))


def sweep(indexed: DataFrame, live: DataFrame, seals: DataFrame, indexed_seals: DataFrame) -> DataFrame:
    """Sessions a refresh has to read again or forget.

    Years under a trusted seal are left out before anything is compared, so
    with tables partitioned by archive and year they are not even scanned.
    """
    skip = trusted_years(seals, indexed_seals)
    key = ["archive", "year", "run_id"]
    changes = diff(indexed.join(skip, ["archive", "year"], "left_anti"),
                   live.join(skip, ["archive", "year"], "left_anti"), key)
    return changes.where(F.col("change") != "unchanged")


def apply_changes(table: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The catalog table after a sweep: changed rows replaced, vanished forgotten."""
    touched = changes.select(*SESSION)
    again = changes.where("change in ('added', 'updated')").select(*SESSION)
    kept = table.join(touched, SESSION, "left_anti")
    return kept.unionByName(fresh.join(again, SESSION, "left_semi").select(*kept.columns))


def write_changed_years(table: DataFrame, changes: DataFrame, path: str) -> None:
    """Rewrite only the (archive, year) partitions a sweep touched.

    Dynamic partition overwrite leaves every other partition alone; a partition
    left without rows is dropped. Output is rebalanced, so a large year is
    written by many tasks and small ones share a file each.
    """
    spark: SparkSession = table.sparkSession
    years = changes.select("archive", "year").distinct()
    kept = table.join(years, ["archive", "year"], "left_semi")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        (kept.hint("rebalance", "archive", "year")
         .write.mode("overwrite").partitionBy("archive", "year").parquet(path))
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    # At most one row per partition directory, whatever the table holds.
    emptied = years.join(table.select("archive", "year"), ["archive", "year"], "left_anti").collect()
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for row in emptied:
        below = [named(k, None if row[k] is None else str(row[k])) for k in ("archive", "year")]
        files.delete(hadoop.Path(root, "/".join(below)), True)
