"""Toxicity: a bidirectional gated recurrent network with attention pooling,
trained in numpy, scores all overlapping windows of a text.

A word's input is the sum of a hashed word vector and the mean of its hashed
character 3-gram vectors. A window is 32 words, one starts every 24; a text's score is the largest
probability over its windows. Labels belong to whole texts, so training goes
in rounds: each picks the window of a toxic text that scores highest so far,
and of other texts the highest one and another one.

The network is fitted in one task on at most ``PER_CLASS`` labelled texts of each class.

Defined results: a null or empty text has one window without words (the network's bias);
repeated rows are scored one by one; without labelled rows every score is 0.5 or near it; an empty
table gives an empty table; no part of a text is left out.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_ngrams, numbered, staged, table, text_slices

WORD_BUCKETS, CHAR_BUCKETS = 8192, 4096
DIM, HIDDEN, ATTENTION = 16, 8, 8
WINDOW, STRIDE = 32, 24
PER_CLASS = 1000      # most labelled texts of a class that the network is fitted on
ROUNDS, BATCH, RATE = 8, 128, 0.01
STEPS = 180           # least steps of a fit, for small samples
FORWARD = 4096        # windows of a forward pass

_words = re.compile(r"\w+").findall


@dataclass
class WordTable:
    """Distinct words: word bucket, and character buckets as (word, bucket) pairs."""
    bucket: np.ndarray
    char_word: np.ndarray
    char_bucket: np.ndarray
    char_share: np.ndarray


def word_table(words: list[str]) -> WordTable:
    raw = [w.encode() for w in words]
    bucket = np.fromiter((xxhash.xxh32_intdigest(w) % WORD_BUCKETS for w in raw), np.int64, len(raw))
    off = np.concatenate([[0], np.cumsum([len(w) + 2 for w in raw])])
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in raw), np.uint8)
    word, char = byte_ngrams(data, off, 3, CHAR_BUCKETS)
    n = np.bincount(word, minlength=len(raw))
    return WordTable(bucket, word, char, (1 / n[word]).astype(np.float32))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of every window; starts count through all words. A text without words has one empty window."""
    n = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = np.cumsum(counts) - counts
    return text, first[text] + k * STRIDE, np.minimum(WINDOW, counts[text] - k * STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 11):
        g = np.random.default_rng(seed)
        d, h, a = DIM, HIDDEN, ATTENTION
        shapes = {"word": (WORD_BUCKETS, d), "char": (CHAR_BUCKETS, d), "wf": (d, 3 * h), "wb": (d, 3 * h), "rf": (h, 3 * h),
                  "rb": (h, 3 * h), "bf": (3 * h,), "bb": (3 * h,), "att": (2 * h, a), "pick": (a,), "out": (2 * h,), "bias": (1,)}
        self.p = {k: (g.standard_normal(s) * (0.3 if k == "char" else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in shapes.items()}
        for k in ("word", "bf", "bb", "bias"):  # a word that training never saw adds nothing
            self.p[k][:] = 0

    def word_inputs(self, t: WordTable) -> np.ndarray:
        x = self.p["word"][t.bucket].copy()
        if len(t.char_word):
            start = np.flatnonzero(np.concatenate([[True], t.char_word[1:] != t.char_word[:-1]]))
            x[t.char_word[start]] += np.add.reduceat(self.p["char"][t.char_bucket] * t.char_share[:, None], start, axis=0)
        return x

    def run(self, gates: tuple[np.ndarray, np.ndarray], at: np.ndarray, mask: np.ndarray, trace: list | None = None) -> tuple:
        """Forward over windows: ``at`` (windows, WINDOW) numbers the rows of
        ``gates`` (input parts of both directions, by word), ``mask`` marks real words."""
        n, h = len(at), HIDDEN
        states = np.zeros((n, WINDOW, 2 * h), np.float32)
        for side, r in ((0, self.p["rf"]), (1, self.p["rb"])):
            s = np.zeros((n, h), np.float32)
            for t in (range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1)):
                m = mask[:, t, None]
                if not m.any():
                    if trace is not None:
                        trace.append(None)
                    continue
                u, back = gates[side][at[:, t]], s @ r
                zr = sigmoid(u[:, :2 * h] + back[:, :2 * h])
                z, reset = zr[:, :h], zr[:, h:]
                new = np.tanh(u[:, 2 * h:] + reset * back[:, 2 * h:])
                nxt = s + m * ((1 - z) * (new - s))
                if trace is not None:
                    trace.append((s, z, reset, new, back[:, 2 * h:], m))
                s = nxt
                states[:, t, side * h:(side + 1) * h] = s * m
        hid = np.tanh(states @ self.p["att"])
        e = np.where(mask > 0, hid @ self.p["pick"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        w = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", w, states)
        return pooled @ self.p["out"] + self.p["bias"][0], states, hid, w, pooled

    def logits(self, table: WordTable, code: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logit of each window; ``code`` numbers each word of the texts in the table."""
        x = self.word_inputs(table)
        gates = (x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"])
        if not len(code):
            code, gates = np.zeros(1, np.int64), tuple(np.zeros((1, 3 * HIDDEN), np.float32) for _ in gates)
        out = np.empty(len(start), np.float32)
        for lo in range(0, len(start), FORWARD):
            at, mask = self.places(code, start[lo:lo + FORWARD], length[lo:lo + FORWARD])
            out[lo:lo + FORWARD] = self.run(gates, at, mask)[0]
        return out

    @staticmethod
    def places(code: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(WINDOW)
        mask = (k[None, :] < length[:, None]).astype(np.float32)
        return code[np.minimum(start[:, None] + k[None, :], len(code) - 1)], mask

    def gradient(self, table: WordTable, code: np.ndarray, start: np.ndarray, length: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss over the given windows, by hand, back through time."""
        p, h = self.p, HIDDEN
        at, mask = self.places(code, start, length)
        used, at = np.unique(at, return_inverse=True)
        at = at.reshape(mask.shape)
        renumber = np.full(len(table.bucket), -1)
        renumber[used] = np.arange(len(used))
        own = renumber[table.char_word] >= 0
        small = WordTable(table.bucket[used], renumber[table.char_word[own]], table.char_bucket[own], table.char_share[own])
        x = self.word_inputs(small)
        trace: list = []
        logit, states, hid, w, pooled = self.run((x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]), at, mask, trace)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_logit = ((sigmoid(logit) - label) / len(label)).astype(np.float32)
        g["out"], g["bias"][0] = pooled.T @ d_logit, d_logit.sum()
        d_pooled = d_logit[:, None] * p["out"]
        d_w = np.einsum("nh,nth->nt", d_pooled, states)
        d_e = w * (d_w - (w * d_w).sum(axis=1, keepdims=True))
        g["pick"] = np.einsum("nt,nta->a", d_e, hid)
        d_hid = d_e[:, :, None] * p["pick"] * (1 - hid * hid)
        g["att"] = np.einsum("nth,nta->ha", states, d_hid)
        d_states = (w[:, :, None] * d_pooled[:, None, :] + d_hid @ p["att"].T) * mask[:, :, None]
        d_x = np.zeros_like(x)
        for side, (r, wi, b) in enumerate((("rf", "wf", "bf"), ("rb", "wb", "bb"))):
            d_s = np.zeros((len(at), h), np.float32)
            d_gate = np.zeros((len(x), 3 * h), np.float32)
            order = range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1)
            for t, kept in reversed(list(zip(order, trace[side * WINDOW:(side + 1) * WINDOW]))):
                if kept is None:
                    continue
                s, z, reset, new, back_n, m = kept
                d_s = d_s + d_states[:, t, side * h:(side + 1) * h]
                d_step = d_s * m
                d_new = d_step * (1 - z) * (1 - new * new)
                d_z = d_step * (s - new) * z * (1 - z)
                d_reset = d_new * back_n * reset * (1 - reset)
                d_u = np.concatenate([d_z, d_reset, d_new], axis=1)
                d_back = np.concatenate([d_z, d_reset, d_new * reset], axis=1)
                g[r] += s.T @ d_back
                np.add.at(d_gate, at[:, t], d_u)
                d_s = d_s * (1 - m) + d_step * z + d_back @ p[r].T
            g[b] = d_gate.sum(axis=0)
            g[wi] = x.T @ d_gate
            d_x += d_gate @ p[wi].T
        np.add.at(g["word"], small.bucket, d_x)
        np.add.at(g["char"], small.char_bucket, d_x[small.char_word] * small.char_share[:, None])
        return g

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Network:
        net = cls()
        with np.load(io.BytesIO(raw)) as f:
            net.p = {k: f[k] for k in f.files}
        return net


def coded(texts: list[str]) -> tuple[WordTable, np.ndarray, np.ndarray]:
    """(table of distinct words, number of each word in place, words of each text)."""
    words = [_words(t.lower()) for t in texts]
    code, known = numbered(chain.from_iterable(words))
    return word_table(list(known)), code, np.fromiter(map(len, words), np.int64, len(words))


def train(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 5) -> Network:
    """Adam over picked windows, in at least so many rounds and steps."""
    net, g = Network(), np.random.default_rng(seed)
    if not len(texts):
        return net
    table, code, counts = coded(texts)
    text, start, length = windows(counts)
    m, v, step = ({k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0)
    first = np.searchsorted(text, np.arange(len(texts)))
    n = np.diff(np.append(first, len(text)))
    per_round = -(-(len(texts) + int((labels == 0).sum())) // BATCH)
    for r in range(max(rounds, -(-steps // per_round))):
        random = first + (g.random(len(texts)) * n).astype(np.int64)
        score = net.logits(table, code, start, length) if r > 1 else g.random(len(text)).astype(np.float32)
        order = np.lexsort((-score, text))
        top = order[first]
        picked = np.concatenate([top, random[labels == 0]])
        g.shuffle(picked)
        for lo in range(0, len(picked), BATCH):
            k = picked[lo:lo + BATCH]
            grad = net.gradient(table, code, start[k], length[k], labels[text[k]].astype(np.float32))
            step += 1
            for name, x in net.p.items():
                m[name] += 0.1 * (grad[name] - m[name])
                v[name] += 0.001 * (grad[name] ** 2 - v[name])
                x -= RATE * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = PER_CLASS) -> DataFrame:
    """(label, text) of at most ``per_class`` labelled texts of each class, the smallest ids by hash."""
    known = labels.where(allowed & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_class).select("doc_id", "label")
    return (docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label")  # at most 2 * per_class ids
            .agg(F.min("text").alias("text")).select("label", "text"))


def fit_network(sample: DataFrame) -> Network:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"label": pd.Series(dtype=int), "text": pd.Series(dtype=str)}), *batches]).fillna("").sort_values(["label", "text"])
        yield pd.DataFrame({"network": [train(rows["text"].tolist(), rows["label"].to_numpy(np.int64)).to_bytes()]})

    raw = sample.coalesce(1).mapInPandas(work, "network binary").first()
    return Network.from_bytes(raw["network"]) if raw else train([], np.zeros(0, np.int64))


def score_texts(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the largest probability over the text's windows."""
    shared = docs.sparkSession.sparkContext.broadcast(net.to_bytes())  # a fixed number of weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.from_bytes(shared.value)
        for b in text_slices(batches, "text"):
            words, code, counts = coded(pc.fill_null(b.column("text"), "").to_pylist())
            text, start, length = windows(counts)
            logit = own.logits(words, code, start, length)
            first = np.searchsorted(text, np.arange(b.num_rows))
            best = np.maximum.reduceat(logit, first).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sigmoid(best))], ["id", "score"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    net = fit_network(staged(training_sample(docs, labels, F.coalesce(remainder != 0, F.lit(False))), "toxic-sample"))
    return score_texts(docs, net).select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score",
                                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
