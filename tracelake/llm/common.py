"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet")


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """A file system for tasks and the path in it; Hadoop's names of object stores are translated."""
    scheme, sign, rest = path.partition("://")
    return pa.fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + sign + rest)


def utf8(name: str) -> Column:
    """A text column as its UTF-8 bytes, null as none."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary"))


def text_key(text: str | Column) -> Column:
    """With the document id, what tells rows apart: rows equal in both are the same document."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


#: Bytes of text that a task works on at a time; a longer text comes alone.
BATCH_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, *names: str, limit: int = 0) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with at most ``limit`` (``BATCH_BYTES``) bytes in the named columns, or one row."""
    held = np.zeros(batch.num_rows, np.int64)
    for n in names:
        held += pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(n))), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(held), 0
    while begin < batch.num_rows:
        upto = (ends[begin - 1] if begin else 0) + (limit or BATCH_BYTES)
        end = max(begin + 1, int(np.searchsorted(ends, upto, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, of which Python gets some ``BATCH_BYTES`` at a time instead of 10,000 rows: a batch is held by the JVM and by
    the Python worker, for every task that runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = 0) -> DataFrame:
    """Apply ``fn`` to all rows of ``df``, which has a column ``text``, a few at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", limit=limit):
                yield fn(part)
    return in_small_batches(df).mapInArrow(run, schema)


def values(batch: pa.RecordBatch, name: str) -> list[Any]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def same_key(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition in which null equals null."""
    cond = None
    for n in names:
        c = left[n].eqNullSafe(right[n])
        cond = c if cond is None else cond & c
    return cond
