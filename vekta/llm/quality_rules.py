"""Quality rules: base counts of each text, then a hashed n-gram
log-likelihood ratio between trusted documents and the raw corpus.

Features are byte 3-grams hashed into a fixed number of buckets. The raw
multinomial counts every document; the trusted one counts a bounded sample of
documents labelled good (``TRUSTED``). A text's score is the mean over its
n-grams of log p_trusted - log p_raw; it is kept when the base rules pass and the score
reaches a fixed threshold, so equal texts always get equal verdicts.

Defined results: a null or empty text has zero counts and fails the
base rules; repeated rows each get their own row; with no labels or an empty table all
ratios are 0, and only the base rules reject.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_ngrams, numbered, segment_sum, table, text_slices, utf8

NGRAM, BUCKETS = 3, 1 << 15
TRUSTED = 20_000      # most labelled documents that the trusted multinomial is fitted on
THRESHOLD = -0.5      # mean log-likelihood ratio of an n-gram, in nats
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_WORD_CHAR = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text: the words that lie in a 3-word window found twice or more in it."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    off = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    total = int(off[-1])
    if total < 3:
        return np.zeros(len(words), np.int64)
    code, known = numbered(chain.from_iterable(words))
    pair = pd.factorize(code[:-1] * len(known) + code[1:])[0]
    window = pd.factorize(pair[:-1] * len(known) + code[2:])[0]
    doc = np.repeat(np.arange(len(words)), n)
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    again = pd.Series(doc[inside] * (int(window.max()) + 1) + window[inside]).duplicated(keep=False).to_numpy()
    covered = np.zeros(total, bool)
    for k in range(3):
        covered[inside[again] + k] = True
    return segment_sum(covered, off)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    data, off = utf8(texts)
    raw = pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()
    words = [t.split() for t in raw]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in raw]
    return {
        "n_words": np.fromiter(map(len, words), np.int64, len(words)),
        "word_chars": segment_sum(_WORD_CHAR[data], off),
        "n_symbols": segment_sum(_SYMBOL[data], off),
        "n_dup_lines": np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, len(lines)),
        "n_repeat_words": repeated_words(words),
    }


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> np.ndarray:
    """At most ``limit`` ids labelled good, the smallest by hash."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rows = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    return np.sort(np.array([r["doc_id"] for r in rows], np.int64))


def fit_ratios(docs: DataFrame, trusted: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_trusted - log p_raw of each bucket. Every task adds up its own
    counts, so the shuffle has at most BUCKETS rows a task and the driver gets BUCKETS rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in text_slices(batches, "text"):
            row, bucket = byte_ngrams(*utf8(b.column("text")), NGRAM, BUCKETS)
            ids = pc.fill_null(b.column("id"), -1).to_numpy(zero_copy_only=False)
            known = np.isin(ids, trusted) & pc.is_valid(b.column("id")).to_numpy(zero_copy_only=False)
            raw += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[known[row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sums = (src.mapInArrow(count, "bucket long, raw long, good long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect())
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for s in sums:
        raw[s["bucket"]] += s["raw"]
        good[s["bucket"]] += s["good"]
    if good.sum() == BUCKETS:  # nothing is trusted: no ratio
        return np.zeros(BUCKETS, np.float64)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def verdicts(texts: pa.Array, ratios: np.ndarray, threshold: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(counts, base_failed, score, kept) of each text."""
    counts = base_counts(texts)
    row, bucket = byte_ngrams(*utf8(texts), NGRAM, BUCKETS)
    n = np.bincount(row, minlength=len(texts))
    mean = np.bincount(row, ratios[bucket], minlength=len(texts)) / np.maximum(n, 1)
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
    return counts, failed, mean, ~failed & (mean >= threshold)


def judge(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, base counts, base_failed, score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            counts, failed, mean, kept = verdicts(b.column("text"), shared.value, threshold)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(counts[c]) for c in COUNTS), pa.array(failed), pa.array(mean), pa.array(kept)],
                ["id", *COUNTS, "base_failed", "score", "kept"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(score, f"id {id_type}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean")
    return out.withColumnRenamed("id", "doc_id")


def keep_good(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text_col):
            yield b.filter(pa.array(verdicts(b.column(text_col), shared.value, threshold)[3]))

    return docs.mapInArrow(keep, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = fit_ratios(docs, trusted_ids(table(spark, sf_dir, "labels")))
    return judge(docs, ratios)
