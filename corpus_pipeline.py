"""The corpus pipeline: language, boilerplate lines, near duplicates, benchmark passages, packing.

Each stage takes the documents that the one before has kept; all but the last return the columns of documents. Rows that
equal in id and text are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, language, lines, near_dups, packing
from tracelake.llm.common import benchmark, documents, text_key
from tracelake.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def in_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    found = language.language_id(docs).where("kept").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    same = docs.doc_id.cast("long").eqNullSafe(found._d) & (text_key("text") == found._k)
    return docs.join(found, same, "left_semi").select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats.

    What looks like copies of one document counts as one document here: what only copies share is their content, which is
    left for the next stage to compare.
    """
    copies = near_dups.copy_labels(docs).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("copy").alias("_copy")).distinct()
    named = docs.join(copies, docs.doc_id.cast("long").eqNullSafe(copies._d) & (text_key("text") == copies._k)).drop("_d", "_k")
    done = lines.site_line_dedup(stage(named, "copies"), copy_col="_copy", may_empty=False)
    return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles similar to 0.8 or more."""
    found = near_dups.near_duplicates(docs, words=5, percent=80).where("first")
    kept = found.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    named = docs.withColumn("_key", text_key("text"))
    named = named.join(kept, named.doc_id.cast("long").eqNullSafe(kept._d) & (named._key == kept._k), "left_semi")
    return named.dropDuplicates(["doc_id", "_key"]).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words of a benchmark item."""
    found = decontaminate.hits(docs, benchmark(spark, sf_dir))
    return decontaminate.clean_documents(docs, found).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", in_language),
    ("line_dedup", without_boilerplate),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The language models and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
