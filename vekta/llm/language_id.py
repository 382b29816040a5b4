"""Language ID by nearest centroid: TF-IDF vectors of hashed byte 3-grams,
compared by cosine with several clustered centroids for each language.

The model is fitted on at most ``PER_LANGUAGE`` labelled documents of each language (the
smallest ids by hash). A document is rejected by its distances: when it is far from
every centroid, or when the second language's nearest centroid is about as near as the
best one's. What counts as far follows from the language's own sample, for texts with about
as many different n-grams (whole texts and windows of them), so a short text isn't held to the
similarity of a long one: less than ``NEAR_SHARE`` of the sample's median similarity, or less than
``LEAD_SHARE`` of its median lead over the second language; neither bar is above what
``KEPT_SHARE`` of the sample reaches.

Defined results: a null or empty text or one without a letter is ``und`` with score 0, and
rejected; a very long text is judged whole; repeated rows are predicted one by one; equal similarity goes to the
language first in order; with no labelled row, an empty table included, all is ``und`` and rejected;
other columns, whatever their names, pass through ``keep_identified`` and aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_ngrams, fresh, staged, table, text_slices, utf8

NGRAM, BUCKETS = 3, 4096
PER_LANGUAGE = 1000   # most documents a language that the model is fitted on
CENTROIDS = 4         # a language
SALTS = 64            # parts of a language that are ranked before the whole of it
NEAR_SHARE = 0.3      # of the median similarity of a language's own texts
LEAD_SHARE = 0.5      # of the median lead of a language's own texts
KEPT_SHARE = 0.995    # of a language's own texts stay on the right side of each bar
WINDOWS = (24, 96, 384)  # characters of the windows that stand for short texts
BANDS = BUCKETS.bit_length() + 1  # numbers of different n-grams, by bit length


@dataclass
class LanguageModel:
    idf: np.ndarray         # BUCKETS
    centroids: np.ndarray   # (centroids, BUCKETS), unit length, by language
    langs: list[str]        # in order
    starts: np.ndarray      # first centroid of each language
    near: np.ndarray        # (langs, BANDS): lowest similarity that isn't rejected
    lead: np.ndarray        # (langs, BANDS): lowest lead that isn't rejected

    def distances(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its similarity, its lead over the second as a share, band) of each text."""
        sim = np.maximum.reduceat(unit_vectors(counts, self.idf) @ self.centroids.T, self.starts, axis=1)
        best = np.argmax(sim, axis=1)
        row = np.arange(len(sim))
        top = np.clip(sim[row, best].astype(np.float64), 0, 1)
        sim[row, best] = 0
        lead = (top - sim.max(axis=1)) / np.maximum(top, 1e-12)
        return best, top, lead, np.frexp((counts > 0).sum(axis=1))[1]


_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 32


def term_counts(texts: pa.Array) -> np.ndarray:
    """(texts, BUCKETS) counts of 3-grams of the lower-case text between two
    spaces, with each run of ASCII characters other than letters as one space."""
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    padded = pc.binary_join_element_wise(space, pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), space, nothing)
    data, off = utf8(padded)
    data = _LETTER[data]
    stay = (data != 32) | np.concatenate([[True], data[:-1] != 32])
    stay[off[:-1]] = True
    off = np.concatenate([[0], np.cumsum(stay)])[off]
    row, bucket = byte_ngrams(data[stay], off, NGRAM, BUCKETS)
    return np.bincount(row.astype(np.int64) * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids; starts from the mean's nearest vector, then the farthest ones."""
    start = [int(np.argmax(v @ v.mean(axis=0)))]
    while len(start) < min(k, len(v)):
        start.append(int(np.argmin((v @ v[start].T).max(axis=1))))
    c = v[start]
    for _ in range(rounds):
        near = np.argmax(v @ c.T, axis=1)
        sums = np.stack([v[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def training_sample(docs: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of at most ``per_language`` documents of each language."""
    known = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    salted = Window.partitionBy("lang", "salt").orderBy(F.xxhash64("doc_id"), "doc_id")
    salt = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS))
    ids = (docs.where(allowed & F.col("lang").isNotNull()).select("doc_id", "lang", salt.alias("salt"))
           .withColumn("k", F.row_number().over(salted)).where(F.col("k") <= per_language)  # a common language isn't one task's
           .withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("doc_id").distinct())
    # at most per_language ids a language
    few = known.join(F.broadcast(ids), "doc_id", "left_semi")
    return few.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def fit_language_model(sample: DataFrame, centroids: int = CENTROIDS) -> LanguageModel:
    """The sample is bounded, and so is each language's group."""
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in text_slices(batches, "text"):
            df += (term_counts(b.column("text")) > 0).sum(axis=0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[n], df]))], ["bucket", "n"])

    sums = sample.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = {r["bucket"]: r["n"] for r in sums}
    n = df.get(-1, 0)
    idf = np.array([np.log((1 + n) / (1 + df.get(b, 0))) + 1 for b in range(BUCKETS)], np.float32)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        texts = pa.array(group["text"].sort_values(), pa.large_string())
        v = np.concatenate([unit_vectors(term_counts(texts.slice(s, 64)), idf) for s in range(0, len(texts), 64)])
        c = spherical_kmeans(v, centroids)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "k": range(len(c)), "centroid": [x.astype("float64") for x in c]})

    rows = sample.groupBy("lang").applyInPandas(cluster, "lang string, k int, centroid array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["k"]))
    stack = np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), BUCKETS)
    langs = sorted({r["lang"] for r in rows})
    starts = np.searchsorted(np.array([r["lang"] for r in rows], object), np.array(langs, object)) if langs else np.zeros(0, np.int64)
    none = np.zeros((len(langs), BANDS))
    return with_bars(LanguageModel(idf, stack, langs, starts, none, none), sample)


def with_bars(m: LanguageModel, sample: DataFrame) -> LanguageModel:
    """The model with its rejection bars, from the sample's whole texts and windows."""
    if not m.langs:
        return m
    shared = sample.sparkSession.sparkContext.broadcast(m)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            best, near, lead, band = shared.value.distances(term_counts(b.column("text")))
            own = b.column("lang").to_numpy(zero_copy_only=False) == np.array(shared.value.langs, object)[best]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(band, pa.int32()), pa.array(near), pa.array(lead)],
                                             ["lang", "band", "near", "lead"]).filter(pa.array(own))

    cuts = [F.substring("text", F.floor(F.length("text") / 3).cast("int") + 1, F.lit(w)) for w in WINDOWS]
    parts = sample.select("lang", F.explode(F.array("text", *cuts)).alias("text"))
    seen = parts.mapInArrow(measure, "lang string, band int, near double, lead double")
    low = 1 - KEPT_SHARE

    def bar(c: str, share: float) -> Column:
        return F.least(share * F.percentile(c, F.lit(0.5)), F.percentile(c, F.lit(low))).alias(c)

    bars = seen.groupBy("lang", "band").agg(bar("near", NEAR_SHARE), bar("lead", LEAD_SHARE)).collect()  # at most BANDS a language
    near, lead = np.zeros((len(m.langs), BANDS)), np.zeros((len(m.langs), BANDS))
    for i, lang in enumerate(m.langs):
        known = sorted((r["band"], r["near"], r["lead"]) for r in bars if r["lang"] == lang)
        if known:  # a band without a text takes the one below it
            at = np.clip(np.searchsorted([k[0] for k in known], np.arange(BANDS), side="right") - 1, 0, None)
            near[i], lead[i] = np.array([k[1] for k in known])[at], np.array([k[2] for k in known])[at]
    return replace(m, near=near, lead=lead)


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def predictions(m: LanguageModel, texts: pa.Array, letters: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(language, cosine, rejected) of each text."""
    n = len(texts)
    known = letters.to_numpy(zero_copy_only=False)
    lang, score, far = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
    for s in range(0, n if m.langs else 0, 256):
        at = slice(s, min(s + 256, n))
        best, score[at], lead, band = m.distances(term_counts(texts.slice(s, 256)))
        far[at] = (score[at] < m.near[best, band]) | (lead < m.lead[best, band])
        lang[at] = np.array(m.langs, object)[best]
    lang[~known], score[~known], far[~known] = "und", 0.0, True
    return pa.array(lang, pa.string()), pa.array(score), pa.array(far)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (cosine, 0 to 1), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed number of buckets, few centroids

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            lang, score, rejected = predictions(shared.value, b.column("text"), b.column("letters"))
            yield pa.RecordBatch.from_arrays([b.column("id"), lang, score, rejected], ["id", "lang_pred", "score", "rejected"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), has_letter(text_col).alias("letters"))
    id_type = src.schema["id"].dataType.simpleString()
    return (src.mapInArrow(predict, f"id {id_type}, lang_pred string, score double, rejected boolean")
            .withColumnRenamed("id", "doc_id"))


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language isn't rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = fresh("letters", docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text_col):
            rejected = predictions(shared.value, b.column(text_col), b.column(letters))[2]
            yield b.select([n for n in b.schema.names if n != letters]).filter(pc.invert(rejected))

    return docs.withColumn(letters, has_letter(text_col)).mapInArrow(keep, docs.schema)


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3


def learn(docs: DataFrame) -> LanguageModel:
    """The model of the documents whose crc32(doc_id) mod 3 is not 1."""
    return fit_language_model(staged(training_sample(docs, remainder() != 1), "language-sample"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
