"""Quality rules judged per document and per host.

Every document is measured by a few rules. Failures are summed by host, each host's failure rate is shrunk towards
the other hosts' rates with a beta prior fitted to them, and a host whose shrunk rate is too high condemns all of its
documents. A document is also dropped for failing a rule itself.

Null and empty texts have no words and fail the base rule; a null host is a host of its own; rows that repeat are
judged each. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import per_batch, utf8, values
from tracelake.session import stage

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
SCHEMA = "doc_id long, host string, " + ", ".join(f"{f} long" for f in FEATURES)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the document rules and of the host verdict."""

    min_words: int = 50
    max_repeat: float = 0.5       # share of words in repeated three-word windows
    max_symbols: float = 0.1      # symbols per word
    max_dup_lines: float = 0.3    # share of lines equal to an earlier one
    max_upper: float = 0.5        # share of capitals among A-Z and a-z
    max_host_rate: float = 0.5    # shrunk failure rate above which a host is condemned


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each document, its words inside three-word windows that it holds twice or more."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(words), np.int64)
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for w in chain.from_iterable(words)), np.int64, total)
    doc = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)[doc]
    starts = np.flatnonzero(np.arange(total) + 3 <= ends)
    covered = np.zeros(total, bool)
    if len(starts):
        # Number the pairs first, so that each key fits 64 bits whatever the batch holds.
        pair = np.unique(flat[starts] * len(ids) + flat[starts + 1], return_inverse=True)[1].astype(np.int64)
        triple = np.unique(pair * len(ids) + flat[starts + 2], return_inverse=True)[1].astype(np.int64)
        _, group, count = np.unique(triple * len(words) + doc[starts], return_inverse=True, return_counts=True)
        for at in (again := starts[count[group] > 1], again + 1, again + 2):
            covered[at] = True
    return np.bincount(doc[covered], minlength=len(words))


def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = values(batch, "text")
    words = [t.split() for t in texts]
    rows = []
    for t, w in zip(texts, words):
        joined = b"".join(w)
        lines = [x for x in t.split(b"\n") if x.strip()]
        upper = len(t) - len(t.translate(None, UPPER))
        rows.append((len(w), len(joined.decode()), len(t) - len(t.translate(None, SYMBOLS)),
                     len(lines) - len(set(lines)), 0, len(lines), upper, upper + len(t) - len(t.translate(None, LOWER))))
    columns = [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * len(FEATURES)
    columns[4] = repeated_words(words).astype(np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns)],
                                      names=["doc_id", "host", *FEATURES])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                         utf8(text_col).alias("text"))
    return per_batch(source, measure, SCHEMA)


def judged(feats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rules applied to each document by itself."""
    f = F.col
    return (feats
            .withColumn("base_failed", (f("n_words") < rules.min_words)
                        | (f("n_repeat_words") * 100 > f("n_words") * int(rules.max_repeat * 100)))
            .withColumn("symbols_failed", f("n_symbols") * 100 > f("n_words") * int(rules.max_symbols * 100))
            .withColumn("lines_failed", f("n_dup_lines") * 100 > f("n_lines") * int(rules.max_dup_lines * 100))
            .withColumn("shouting_failed", f("n_upper") * 100 > f("n_letters") * int(rules.max_upper * 100))
            .withColumn("failed", f("base_failed") | f("symbols_failed") | f("lines_failed") | f("shouting_failed")))


def beta_prior(n: int, mean: float, variance: float) -> tuple[float, float]:
    """Beta parameters with the given mean and variance of rates over ``n`` hosts.

    With fewer than two hosts, or without spread, the prior is one document's worth of the mean.
    """
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    strength = mean * (1 - mean) / variance - 1 if n > 1 and variance > 0 else 1.0
    strength = max(strength, 1.0)
    return mean * strength, (1 - mean) * strength


def host_verdicts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per host with its shrunk failure rate and verdict; ``docs`` come from :func:`judged`."""
    hosts = docs.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    # One row of sums over all hosts.
    n, mean, variance = hosts.agg(F.count(F.lit(1)), F.avg(rate), F.var_pop(rate)).first()
    a, b = beta_prior(n or 0, mean or 0.0, variance or 0.0)
    return (hosts.withColumn("host_rate", (F.col("host_failed") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b)))
            .withColumn("host_bad", F.col("host_rate") > rules.max_host_rate))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 rules: Rules = Rules()) -> DataFrame:
    """Measures, rule outcomes, host verdict and ``kept`` for every row of ``docs``."""
    # Measured once; the counts are narrow, so reading them twice is cheap.
    docs = judged(stage(features(docs, id_col, text_col, host_col), "quality"), rules)
    hosts = host_verdicts(docs, rules).select(F.col("host").alias("_h"), "host_docs", "host_rate", "host_bad")
    return (docs.join(hosts, docs.host.eqNullSafe(hosts._h)).drop("_h")
            .withColumn("kept", ~F.col("failed") & ~F.col("host_bad")))
