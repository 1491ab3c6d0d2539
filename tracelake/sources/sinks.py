"""Writing catalogs, fragments and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.items import SESSION


def write_catalog(tables: dict[str, DataFrame], path: str) -> None:
    """All tables of a catalog, those with a year partitioned by archive and year.

    Output is rebalanced by partition: a large year is split over many tasks and
    files, small ones share theirs.
    """
    for name, table in tables.items():
        by = [c for c in ("archive", "year") if c in table.columns]
        writer = table.hint("rebalance", *by).write if by else table.write
        writer.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}") if by else writer.mode(
            "overwrite").parquet(f"{path}/{name}")


def fragment_tables(tables: dict[str, DataFrame], plan: DataFrame, want: DataFrame, manifests: DataFrame,
                    entries: DataFrame) -> dict[str, DataFrame]:
    """The rows of every table an export takes; ids stay as they are."""
    sessions, files = plan.select(*SESSION), want.where("size is not null").select(*SESSION, "name")
    by_file = files.withColumnRenamed("name", "filename")
    out = {}
    for name in ("sessions", "related_runs"):
        out[name] = tables[name].join(sessions, SESSION, "left_semi")
    out["files"] = tables["files"].join(files, [*SESSION, "name"], "left_semi")
    for name in ("sidecars", "edges"):
        out[name] = tables[name].join(by_file, [*SESSION, "filename"], "left_semi")
    out["manifest_files"] = tables["manifest_files"].join(manifests, "manifest", "left_semi")
    out["collection_entries"] = entries
    out["archives"] = tables["archives"].join(plan.select("archive"), "archive", "left_semi").withColumn(
        "kind", F.lit("fragment"))
    return out


def write_search(found: DataFrame, summary: DataFrame, path: str) -> None:
    """A search result as JSON lines, with its one-row-per-archive summary."""
    found.write.mode("overwrite").json(f"{path}/items")
    summary.write.mode("overwrite").json(f"{path}/summary")
