"""Language identification by Bayesian fusion of four kinds of evidence.

The text's likelihood under hashed byte-trigram models, the language that the document declares, and a prior of its
host, which is smoothed towards hosts of the same address suffix and those towards all documents. Priors and the
reliability of declarations are sums of text posteriors over all documents, gathered by grouping; a document's own
share is taken out of its host's sum.

Beside the languages there is a class of all other texts. It is as likely as a text whose trigrams are, for their number,
``FAR`` deviations less usual than those of labelled documents of the nearest language, and at least as likely as
trigrams at random. Where it is the likeliest class, the language is null. Languages declared by fewer than ``ENOUGH``
labelled documents have no model, and their texts are among the others.

A document is rejected when its text has no letter or no language reaches the wanted posterior, or when its language is
not among those wanted. Null and empty texts have no letter. A null declaration is no evidence; null hosts are one
host without suffix. Repeated rows are judged each. Without labelled rows, or in an empty table, nothing can be told
and every row is rejected with language null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import per_batch, text_key, utf8, values
from tracelake.session import stage

GRAMS = 1 << 16
TEMPER = 1 / 3            # a byte takes part in three trigrams
CHUNK = 1_000_000         # bytes scored at once
ENOUGH = 10               # labelled documents that a language needs to have a model
FAR = 4.0                 # deviations from its nearest language at which a text is as likely one of another
RARE = 0.01               # share of labelled documents that are less usual than that
OTHERS = 0.05             # prior share of texts in none of the languages
DECLARATIONS = 64         # smoothing of how often a language declares what
USUAL = 50                # trigrams of a labelled document that tells what is usual
PER_LANGUAGE = 400        # labelled documents of a language that the trigram model is fitted to
STRENGTH = 10.0           # documents' worth of the higher level's prior
SCORED = "doc_id long, text_key long, host string, declared string, n_letters long, likelihood array<double>, share array<double>"
FUSED = "doc_id long, text_key long, host string, declared string, text_lang string, language string, posterior double, kept boolean"


def grams(text: np.ndarray) -> np.ndarray:
    """Hashed trigrams of lower-cased bytes."""
    b = text.astype(np.uint32)
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    return ((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)


def trained(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the log-probability of each trigram in each of them, and what is usual in each: the median over labelled
    documents of the mean log-ratio to trigrams at random, its deviation (so that ``FAR`` of it leave out the share ``RARE`` of
    the documents, but not more than three quarters of the median), and the variance for a single trigram.

    Fitted to at most ``per_language`` labelled documents of each language that has ``ENOUGH``, those with the least hash of
    their id. What is usual is told by models of the half of them that a document is not in.
    """
    rows = labelled.where("lang is not null")
    languages = sorted(r.lang for r in rows.groupBy("lang").count().where(F.col("count") >= ENOUGH).collect())
    if not languages:
        return [], np.zeros((0, GRAMS)), np.zeros((3, 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text_key")
    known = rows.sparkSession.createDataFrame([(x,) for x in languages], "lang string")
    chosen = (rows.join(F.broadcast(known), "lang", "left_semi").select("lang", "doc_id", "text_key")
              .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language).drop("_r"))
    # Bounded by the number of languages times per_language ids.
    sample = rows.join(F.broadcast(chosen.distinct()), ["lang", "doc_id", "text_key"], "left_semi")
    sample = stage(sample.select("lang", F.pmod("text_key", F.lit(2)).cast("int").alias("half"), "text"), "labelled")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = {}
        for key, text in zip(zip(values(batch, "lang"), values(batch, "half")), values(batch, "text")):
            if len(text) > 2:
                n = np.bincount(grams(np.frombuffer(text, np.uint8)), minlength=GRAMS)
                total[key] = total.get(key, 0) + n
        keys = {k: np.flatnonzero(n) for k, n in total.items()}
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, g in keys.items() for _ in g], pa.string()),
             pa.array([k[1] for k, g in keys.items() for _ in g], pa.int32()),
             pa.array(np.concatenate([*keys.values(), np.zeros(0, np.int64)]), pa.int32()),
             pa.array(np.concatenate([*(total[k][g] for k, g in keys.items()), np.zeros(0, np.int64)]), pa.int64())],
            names=["lang", "half", "gram", "n"])

    seen = np.zeros((2, len(languages), GRAMS))
    place = {k: i for i, k in enumerate(languages)}
    # Bounded by the number of languages times GRAMS rows, twice.
    found = per_batch(sample, count, "lang string, half int, gram int, n long").groupBy("lang", "half", "gram").agg(
        F.sum("n").alias("n")).toArrow()
    lang = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    seen[found.column("half").to_numpy(), lang, found.column("gram").to_numpy()] = found.column("n").to_numpy()
    model = logs(seen.sum(axis=0))
    halves = logs(seen).astype(np.float32)

    def ratio(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(k, float(halves[1 - h, place[k]][grams(np.frombuffer(t, np.uint8))].mean()) + np.log(GRAMS))
               for k, h, t in zip(*(values(batch, c) for c in ("lang", "half", "text"))) if len(t) > USUAL + 1]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([r for _, r in out], pa.float64())],
                                          names=["lang", "ratio"])

    ratios: dict[str, list[float]] = {k: [] for k in languages}
    for r in per_batch(sample, ratio, "lang string, ratio double").collect():  # as many as documents are chosen, at most
        ratios[r.lang].append(r.ratio)
    share, x = np.exp(model), model + np.log(GRAMS)
    mean = (share * x).sum(axis=1)
    middle = np.array([np.median(ratios[k]) if ratios[k] else m for k, m in zip(languages, mean)])
    apart = [(m - max(np.quantile(ratios[k], RARE), m / 4)) / FAR if ratios[k] else 0.0 for k, m in zip(languages, middle)]
    return languages, model, np.array([middle, apart, (share * x * x).sum(axis=1) - mean ** 2])


def logs(seen: np.ndarray) -> np.ndarray:
    return np.log((seen + 0.5) / (seen + 0.5).sum(axis=-1, keepdims=True))


def other(likelihood: np.ndarray, n: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Tempered log-likelihood of texts of ``n`` trigrams as texts of none of the languages."""
    middle, apart, single = usual[:, likelihood.argmax(axis=1)]
    least = middle - FAR * np.sqrt(apart ** 2 + single / TEMPER / np.maximum(n, 1))
    return TEMPER * n * (np.maximum(least, 0.0) - np.log(GRAMS))


def scored(rows: DataFrame, model: np.ndarray, usual: np.ndarray) -> DataFrame:
    """Tempered log-likelihood of every whole text under each language and, last, as one of none of them."""
    table = model.astype(np.float32)
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = values(batch, "text")
        out = np.zeros((len(texts), len(table)))
        letters = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            # Two blanks end each text, so that no trigram spans two of them.
            flat = np.frombuffer(b"".join(t + b"\0\0" for t in texts[at:end]), np.uint8)
            starts = np.cumsum([0, *(len(t) + 2 for t in texts[at:end])])[:-1]
            ids = np.append(grams(flat), [0, 0])
            inside = np.ones(len(flat), np.float32)
            inside[np.append(starts[1:], len(flat)) - 1] = inside[np.append(starts[1:], len(flat)) - 2] = 0
            for i, row in enumerate(table):
                out[at:end, i] = np.add.reduceat(row[ids] * inside, starts, dtype=np.float64) * TEMPER
            letters[at:end] = np.add.reduceat(letter[flat].astype(np.int64), starts)
            at = end
        n = np.maximum(np.array([len(t) for t in texts], np.int64) - 2, 0)
        out = np.column_stack([out, other(out, n, usual)])
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                 for x in (out, softmax(out))]
        names = ["doc_id", "text_key", "host", "declared"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(letters), *lists],
                                          names=[*names, "n_letters", "likelihood", "share"])

    return per_batch(rows.select("doc_id", "text_key", "host", F.col("lang").alias("declared"), "text"), score, SCORED, limit=1 << 20)


def softmax(logs: np.ndarray) -> np.ndarray:
    powers = np.exp(logs - logs.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def suffix(host: Column) -> Column:
    """What follows the last dot of an address; nothing where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(host, r"\.([^.]+)$", 1)), F.lit(""))


def sums(n: int) -> list[Column]:
    return [F.array(*(F.sum(F.col("share")[i]) for i in range(n))).alias("sums"), F.count(F.lit(1)).cast("double").alias("docs")]


def smoothed(level: str, docs: str, above: str) -> Column:
    return F.zip_with(F.col(level), F.col(above), lambda s, p: (s + STRENGTH * p) / (F.col(docs) + STRENGTH))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as documents: declared markup language and host, with the markup taken out of the text."""
    return pages.select(
        F.col("page_id").alias("doc_id"),
        F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ").alias("text"),
        F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)), F.lit("")).alias("lang"),
        F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1)).alias("source"))


def language_id(docs: DataFrame, labelled: DataFrame | None = None, wanted: list[str] | None = None,
                least_posterior: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The fused language of every row of ``docs``; the text models are fitted to ``labelled``, or to ``docs``."""
    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"),
                         F.col(host_col).cast("string").alias("host"), F.col(declared_col).cast("string").alias("lang"),
                         utf8(text_col).alias("text"))

    languages, model, usual = trained(rows(docs if labelled is None else labelled))
    if not languages:
        return rows(docs).select("doc_id", "text_key", "host", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("text_lang"),
                                 F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"),
                                 F.lit(False).alias("kept"))
    n = len(languages)
    docs = (stage(scored(rows(docs), model, usual), "language")
            .withColumn("suffix", suffix(F.col("host"))))

    # Sums of text posteriors: over all documents (one row), suffixes, hosts and declarations.
    total = docs.agg(*sums(n)).first()
    everywhere = [(s + 1) / (total.docs + n) for s in total.sums] if total.docs else [1 / n] * n
    by_suffix = docs.groupBy("suffix").agg(*sums(n)).withColumn("above", F.array(*map(F.lit, everywhere))).select(
        "suffix", smoothed("sums", "docs", "above").alias("above"))
    by_host = docs.groupBy("host", "suffix").agg(*sums(n)).join(by_suffix, "suffix").select(
        F.col("host").alias("_h"), F.col("sums").alias("host_sums"), F.col("docs").alias("host_docs"), "above")
    # How often each language declares what: rows are documents of a language, found by text.
    weight = [total.sums[i] + DECLARATIONS for i in range(n)] if total.docs else [1.0] * n
    by_declared = docs.where("declared is not null").groupBy("declared").agg(*sums(n)).select(
        F.col("declared").alias("_d"),
        F.concat(F.zip_with("sums", F.array(*map(F.lit, weight)), lambda s, w: F.log((s + 1) / w)),
                 F.array(F.log(F.col("docs") / F.lit(max(total.docs, 1.0))))).alias("declares"))

    joined = (docs.join(by_host, docs.host.eqNullSafe(by_host._h))
              .join(by_declared, F.col("declared") == F.col("_d"), "left"))
    names = np.array([*languages, None], object)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue

            def matrix(c: str, batch=batch) -> np.ndarray:
                column = batch.column(batch.schema.get_field_index(c))
                return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

            share, likelihood = matrix("share"), matrix("likelihood")
            documents = np.array(values(batch, "host_docs"))[:, None]
            others = np.maximum(matrix("host_sums") - share[:, :n], 0.0)
            prior = (others + STRENGTH * matrix("above")) / (documents - 1 + STRENGTH)
            prior = np.column_stack([prior * (1 - OTHERS), np.full(len(prior), OTHERS)])
            fused = softmax(likelihood + np.log(prior) + matrix("declares"))
            best, posterior = names[fused.argmax(axis=1)], fused.max(axis=1)
            good = np.array([x is not None and (wanted is None or x in wanted) for x in best])
            good &= (np.array(values(batch, "n_letters")) > 0) & (posterior >= least_posterior)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(names[share.argmax(axis=1)], pa.string()), pa.array(best, pa.string()),
                 pa.array(posterior), pa.array(good)], names=[x.split()[0] for x in FUSED.split(", ")])

    return joined.select("doc_id", "text_key", "host", "declared", "n_letters", "likelihood", "share", "host_sums", "host_docs", "above",
                         F.coalesce("declares", F.array_repeat(F.lit(0.0), n + 1)).alias("declares")).mapInArrow(fuse, FUSED)
