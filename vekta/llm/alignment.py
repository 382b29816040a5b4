"""Alignment of two tokenizers' tokens through token-byte incidence matrices.

Tokenizer A encodes a space and the text, B encodes the text (it adds the space itself), so both
tile the same bytes. A row product A·Bᵀ of the two token-byte matrices, kept as hand-built CSR,
gives every overlap of an A and a B token and the bytes they share. Where no overlap spans the border of two A tokens,
both end there: that cuts the tokens into groups. The product of the
token-group matrix of A with the group-token matrix of B gives all links, pairs of one group.

Neither tokenizer joins anything across a border from a non-blank to a space or line break. So the
matrices are built for distinct units between such borders, once for each unit a worker remembers,
and documents are sums over their units. In how many documents an id pair is linked is counted over the corpus in
Spark: tasks count distinct pairs of a document with bounded buffers, a shuffle on the pair adds up.
The pairs in most documents are broadcast, a bounded number; all others, which are in
few documents each, are joined by a shuffle. No pair is left out.

Defined results: a null or empty text, and one whose bytes one of the tokenizers changes, has no tokens: zeros
and an empty ``groups_sha256``; such a text adds nothing to the counts; strings of special tokens are plain text;
repeated rows are documents of their own; an empty table gives an empty table; texts are never cut off;
other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, text_slices
from .packing import ByteTokenizer
from .sentencepiece_codec import SPACE, PieceVocabulary

HEAD_PAIRS = 1_000_000    # most id pairs whose counts are broadcast (17 bytes each)
CACHED_UNITS = 400_000    # distinct units beyond which a worker forgets those seen once
BLOCK = 1 << 21           # products that a step of a row product expands
COUNTED_PAIRS = 1 << 21   # pairs that a task counts before it passes them on
SHIFT = 20                # a pair is one number: A's id above, B's id below
_UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+").findall
_SPACING = re.compile(f"[ \n{SPACE}]").search


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... (length[i] of them), for all i in turn."""
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    return np.repeat(start - (end - length), length) + np.arange(total)


class CSR:
    """A sparse matrix by rows: row i has columns[indptr[i]:indptr[i+1]] and their values."""

    def __init__(self, indptr: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.indptr, self.columns, self.values, self.width = indptr, columns, values, width

    @staticmethod
    def of_ones(row_length: np.ndarray, columns: np.ndarray, width: int) -> "CSR":
        return CSR(np.concatenate([[0], np.cumsum(row_length)]), columns, np.ones(len(columns), np.int64), width)

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def product_rows(self, other: "CSR", block: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Gustavson's product: row i is the sum of other's rows at i's columns, weighted. Yields
        (row, column, value) of blocks of whole rows, sorted, each expanding about ``block`` products."""
        width = np.diff(other.indptr)[self.columns]                 # products of each entry
        done = np.concatenate([[0], np.cumsum(width)])[self.indptr]  # products before each row
        first, rows = 0, len(self.indptr) - 1
        while first < rows:
            last = max(first + 1, int(np.searchsorted(done, done[first] + (block or BLOCK), "right")) - 1)
            at = slice(self.indptr[first], self.indptr[last])
            pick = ranges(other.indptr[self.columns[at]], width[at])
            row = np.repeat(np.repeat(np.arange(first, last), np.diff(self.indptr[first:last + 1])), width[at])
            key = row * other.width + other.columns[pick]
            value = np.repeat(self.values[at], width[at]) * other.values[pick]
            if len(key) and (np.diff(key) < 0).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            key, value = key[start], np.add.reduceat(value, start) if len(start) else value
            yield key // other.width, key % other.width, value
            first = last

    def times(self, other: "CSR") -> "CSR":
        parts = list(self.product_rows(other))
        row, column, value = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        rows = len(self.indptr) - 1
        return CSR(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), column, value, other.width)


class Aligned:
    """Tokens, overlaps and groups of a list of strings. Strings that a tokenizer changes are ``bad`` and have no tokens."""

    def __init__(self, pair: "TokenizerPair", strings: list[str]):
        self.a, self.n_a = pair.encode_a(strings)
        self.b, self.n_b = pair.encode_b(strings)
        self._leave_out_bad(pair, strings)
        n = len(strings)
        len_a, len_b = pair.len_a[self.a], pair.len_b[self.b]
        size = int(len_a.sum())
        matrix_a = CSR.of_ones(len_a, np.arange(size), size)
        b_of_byte = CSR.of_ones(np.ones(size, np.int64), np.repeat(np.arange(len(self.b)), len_b), max(1, len(self.b)))
        self.overlap = matrix_a.times(b_of_byte)
        # an A token starts a group where it shares no B token with the one before it
        o = self.overlap
        first, last = o.columns[o.indptr[:-1]], o.columns[o.indptr[1:] - 1]
        starts = np.concatenate([[True], first[1:] != last[:-1]]) if len(first) else np.zeros(0, bool)
        self.group_a = np.cumsum(starts) - 1
        self.group_b = np.zeros(len(self.b), np.int64)
        self.group_b[o.columns] = self.group_a[o.row_numbers()]
        self.string_a = np.repeat(np.arange(n), self.n_a)
        self.groups = int(starts.sum())
        self.in_group_a = np.bincount(self.group_a, minlength=self.groups)
        self.in_group_b = np.bincount(self.group_b, minlength=self.groups)
        self.string_of_group = self.string_a[starts]
        self.n_groups = np.bincount(self.string_of_group, minlength=n)
        self.n_links = np.bincount(self.string_of_group, self.in_group_a * self.in_group_b, minlength=n).astype(np.int64)

    def _leave_out_bad(self, pair: "TokenizerPair", strings: list[str]) -> None:
        raw = [s.encode() for s in strings]
        text = np.frombuffer(b"".join(raw), np.uint8)
        got = (pair.bytes_a(self.a), pair.bytes_b(self.b))
        self.bad = np.zeros(len(strings), bool)
        if all(len(g) == len(text) and (g == text).all() for g in got):
            return
        for g, ids, n, length in zip(got, (self.a, self.b), (self.n_a, self.n_b), (pair.len_a, pair.len_b)):
            cut = np.concatenate([[0], np.cumsum(length[ids])])[np.concatenate([[0], np.cumsum(n)])].tolist()
            data = g.tobytes()
            self.bad |= np.array([data[s:e] != r for s, e, r in zip(cut[:-1], cut[1:], raw)], bool)
        self.a, self.b = self.a[np.repeat(~self.bad, self.n_a)], self.b[np.repeat(~self.bad, self.n_b)]
        self.n_a, self.n_b = np.where(self.bad, 0, self.n_a), np.where(self.bad, 0, self.n_b)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) of all pairs of a group, in blocks."""
        of_a = CSR.of_ones(np.ones(len(self.a), np.int64), self.group_a, max(1, self.groups))
        of_group = CSR.of_ones(self.in_group_b, np.arange(len(self.b)), max(1, len(self.b)))
        return of_a.product_rows(of_group)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, id pair, links) of each string's distinct pairs, in order."""
        string, pair, n = (np.zeros(0, np.int64) for _ in range(3))
        for row, column, value in self.links():
            s = np.concatenate([string, self.string_a[row]])
            p = np.concatenate([pair, (self.a[row] << SHIFT) | self.b[column]])
            v = np.concatenate([n, value])
            order = np.lexsort((p, s))
            s, p, v = s[order], p[order], v[order]
            start = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] != p[:-1])]))
            string, pair, n = s[start], p[start], np.add.reduceat(v, start)
        return string, pair, n

    def spelled(self, pair: "TokenizerPair") -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of each string in ASCII, flat, and its length; every group ends with ``;``."""
        both = np.concatenate([self.a, self.b])
        order = np.argsort(np.concatenate([2 * self.group_a, 2 * self.group_b + 1]), kind="stable")
        side = np.concatenate([2 * self.group_a, 2 * self.group_b + 1])[order]
        width = pair.digits_len[both[order]]
        text = pair.digits[ranges(pair.digits_off[both[order]], width)]
        last = np.concatenate([side[1:] != side[:-1], np.ones(min(1, len(side)), bool)])
        mark = np.where(last, np.where(side % 2 == 0, ord("|"), ord(";")), ord(","))
        text[np.cumsum(width) - 1] = mark
        size = np.bincount(self.string_of_group[side // 2], width, minlength=len(self.n_a))
        return text, size.astype(np.int64)


class TokenizerPair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.byte = ByteTokenizer(path_a)
        self.byte.cut, self.byte.added = None, {}    # strings of special tokens are plain text
        self.piece = PieceVocabulary(path_b)
        ranks = self.byte.bpe._mergeable_ranks
        text: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            text[i] = t
        self.len_a = np.array([len(t) for t in text], np.int64)
        self.off_a, self.text_a = np.cumsum(self.len_a) - self.len_a, np.frombuffer(b"".join(text), np.uint8)
        self.len_b = np.diff(self.piece.text_off).astype(np.int64)
        # decimal ids, each with a place for the mark that follows it
        spelled = [f"{i} ".encode() for i in range(max(len(self.len_a), len(self.len_b)))]
        self.digits_len = np.array([len(x) for x in spelled], np.int64)
        self.digits_off, self.digits = np.cumsum(self.digits_len) - self.digits_len, np.frombuffer(b"".join(spelled), np.uint8)
        if max(len(self.len_a), len(self.len_b)) >> SHIFT:
            raise ValueError(f"vocabularies beyond {1 << SHIFT} ids need a larger SHIFT")

    def bytes_a(self, ids: np.ndarray) -> np.ndarray:
        return self.text_a[ranges(self.off_a[ids], self.len_a[ids])]

    def bytes_b(self, ids: np.ndarray) -> np.ndarray:
        return self.piece.text[ranges(self.piece.text_off[ids], self.len_b[ids])]

    def units(self, text: str) -> list[str]:
        """The space and the text, cut where a space or line break follows a non-blank."""
        s = " " + text
        return _UNIT(s) if self.piece.cut_spaces and self.piece.cut_lines else [s]

    def encode_a(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of each string. Strings from one border to the next are encoded in one call, and cut by bytes."""
        open_end = [not s[:1] in (" ", "\n") or s[-1].isspace() for s in strings]
        joined = self.byte.bpe.encode_ordinary("".join([s for s, o in zip(strings, open_end) if not o]))
        ids = np.array(joined, np.int64)
        ends = np.cumsum([0 if o else len(s.encode()) for s, o in zip(strings, open_end)], dtype=np.int64)
        n = np.diff(np.searchsorted(np.cumsum(self.len_a[ids]), ends, "right"), prepend=0)
        if any(open_end):
            alone = {k: self.byte.bpe.encode_ordinary(s) for k, (s, o) in enumerate(zip(strings, open_end)) if o}
            at = np.cumsum(n) - n
            n[list(alone)] = [len(x) for x in alone.values()]
            ids = np.insert(ids, np.repeat(at[list(alone)], n[list(alone)]), np.fromiter(chain.from_iterable(alone.values()), np.int64))
        return ids, n

    def encode_b(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [s[:1] == " " and not _SPACING(s, 1) for s in strings]
        parts = [[SPACE + s[1:]] if p else self._piece_words(s) for s, p in zip(strings, plain)]
        ids, n = self.piece.encode_words(list(chain.from_iterable(parts)))
        string = np.repeat(np.arange(len(strings)), np.fromiter(map(len, parts), np.int64, len(parts)))
        return ids.astype(np.int64), np.bincount(string, n, minlength=len(strings)).astype(np.int64)

    def _piece_words(self, s: str) -> list[str]:
        s = s.replace(SPACE, " ")
        if not self.piece.cut_spaces:
            return [s.replace(" ", SPACE)]
        s = re.sub(" +", lambda m: " " + SPACE * len(m[0]), s)
        return [x for x in (s.replace("\n", " \n ") if self.piece.cut_lines else s).split(" ") if x]


class Numbers(dict):
    """Numbers what is looked up by first sight."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class UnitCache:
    """Alignments of distinct units, numbered by first sight. With ``head`` (sorted pairs, their counts, best) each unit
    also has its spelled groups and the sums of its counts, and keeps only the pairs that ``head`` lacks."""

    def __init__(self, pair: TokenizerPair, head: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.pair, self.head = pair, head
        self.known = Numbers()
        self.seen = np.zeros(0, np.int64)
        self.text, self.text_off = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        # bad, A tokens, B tokens, groups, links, best links, sum of counts
        self.stats = np.zeros((0, 7), np.int64)
        self.keys, self.mult, self.off = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keep the half seen most often, of units seen more than once."""
        keep = np.argsort(-self.seen, kind="stable")[:CACHED_UNITS // 2]
        keep = np.sort(keep[self.seen[keep] > 1])
        names = list(self.known)
        self.known = Numbers((names[k], i) for i, k in enumerate(keep.tolist()))
        self.seen = np.ones(len(keep), np.int64)
        self.stats = self.stats[keep]
        for off, flat in [("off", ("keys", "mult"))] + [("text_off", ("text",))] * (self.head is not None):
            o = getattr(self, off)
            width = np.diff(o)[keep]
            at = ranges(o[keep], width)
            for name in flat:
                setattr(self, name, getattr(self, name)[at])
            setattr(self, off, np.concatenate([[0], np.cumsum(width)]))

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, unit) of all units in order, and for each text whether it has tokens."""
        if len(self.known) > CACHED_UNITS:
            self.forget()
        parts = [self.pair.units(t) if t else [] for t in texts]
        before = len(self.known)
        unit = np.array(list(map(self.known.__getitem__, chain.from_iterable(parts))), np.int64)
        if len(self.known) > before:
            self._add(list(self.known)[before:])
        self.seen = np.concatenate([self.seen, np.zeros(len(self.known) - before, np.int64)]) + np.bincount(unit, minlength=len(self.known))
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        bad = np.bincount(doc, self.stats[unit, 0], minlength=len(texts)) > 0
        has = ~bad & (np.bincount(doc, minlength=len(texts)) > 0)
        keep = has[doc]
        return doc[keep], unit[keep], has

    def _add(self, units: list[str]) -> None:
        x = Aligned(self.pair, units)
        string, key, n = x.pairs()
        best = total = np.zeros(len(units), np.int64)
        if self.head is not None:
            keys, docs, is_best = self.head
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            found = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            s, m, at = string[found], n[found], at[found]
            best, total = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
            np.add.at(total, s, m * docs[at])
            np.add.at(best, s, m * is_best[at])
            string, key, n = string[~found], key[~found], n[~found]   # left to the join
            text, size = x.spelled(self.pair)
            self.text, self.text_off = np.concatenate([self.text, text]), np.concatenate([self.text_off, self.text_off[-1] + np.cumsum(size)])
        self.stats = np.concatenate([self.stats, np.stack([x.bad, x.n_a, x.n_b, x.n_groups, x.n_links, best, total], 1)])
        self.keys, self.mult = np.concatenate([self.keys, key]), np.concatenate([self.mult, n])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(np.bincount(string, minlength=len(units)))])

    def pairs_of(self, doc: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links) of the units' pairs, unmerged."""
        width = np.diff(self.off)[unit]
        at = ranges(self.off[unit], width)
        return np.repeat(doc, width), self.keys[at], self.mult[at]


@lru_cache(maxsize=2)
def tokenizer_pair(path_a: str, path_b: str) -> TokenizerPair:
    return TokenizerPair(path_a, path_b)


_SLOT: dict = {}


def worker_cache(run: str, pair: TokenizerPair, head: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> UnitCache:
    """The cache of this worker process for ``run``; tasks of one run share it, another run's is dropped."""
    if run not in _SLOT:
        _SLOT.clear()
        _SLOT[run] = UnitCache(pair, head)
    return _SLOT[run]


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment itself: doc_id, a and b (token ids), overlaps (token numbers and bytes that they share) and groups
    (numbers of their first tokens and their byte offset in space and text)."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(path_a, path_b)
        for b in text_slices(batches, "text"):
            rows = []
            for t in b.column("text").to_pylist():
                x = Aligned(pair, [" " + t] if t else [])
                first_a = np.cumsum(x.in_group_a) - x.in_group_a
                first_b = np.cumsum(x.in_group_b) - x.in_group_b
                byte = np.cumsum(pair.len_a[x.a]) - pair.len_a[x.a]
                rows.append((x.a.tolist(), x.b.tolist(),
                             [dict(a=i, b=j, bytes=n) for i, j, n in zip(x.overlap.row_numbers().tolist(), x.overlap.columns.tolist(), x.overlap.values.tolist())],
                             [dict(a=i, b=j, at=k) for i, j, k in zip(first_a.tolist(), first_b.tolist(), byte[first_a].tolist())]))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.list_(pa.int32())),
                pa.array(cols[2], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())]))),
                pa.array(cols[3], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("at", pa.int32())])))],
                ["id", "a", "b", "overlaps", "groups"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(align, f"id {src.schema['id'].dataType.simpleString()}, a array<int>, b array<int>, "
                                "overlaps array<struct<a: int, b: int, bytes: int>>, groups array<struct<a: int, b: int, at: int>>")
    return out.withColumnRenamed("id", "doc_id")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """(pair, docs, best): in how many documents A's and B's id are linked, and whether no pair of the A id is in more."""
    run = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(run, tokenizer_pair(path_a, path_b))
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(pair: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(pair), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(pair[s:s + (1 << 17)]), pa.array(n[s:s + (1 << 17)])], ["pair", "docs"])

        for b in text_slices(batches, "text"):
            doc, unit, _ = cache.look_up(b.column("text").to_pylist())
            own = np.unique((doc << 32) | unit)
            doc, key, _ = cache.pairs_of(own >> 32, own & ((1 << 32) - 1))
            own = np.unique((key << 22) | doc)                 # a slice has fewer than 2^22 rows
            new, count_ = np.unique(own >> 22, return_counts=True)
            pair, inverse = np.unique(np.concatenate([pair, new]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n, count_])).astype(np.int64)
            if len(pair) > COUNTED_PAIRS:
                yield from out(pair, n)
                pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from out(pair, n)

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "pair long, docs long")
    counted = counted.groupBy("pair").agg(F.sum("docs").alias("docs"))
    of_a = Window.partitionBy(F.shiftright("pair", SHIFT))     # at most B's vocabulary of rows
    return counted.withColumn("best", F.col("docs") == F.max("docs").over(of_a))


def _head_level(counts: DataFrame, limit: int) -> int:
    """The least power of two such that at most ``limit`` pairs are in as many documents."""
    sizes = counts.groupBy(F.floor(F.log2("docs")).alias("p")).count().collect()
    level, held = 62, 0
    for r in sorted(sizes, key=lambda r: -r["p"]):
        held += r["count"]
        if held > limit:
            break
        level = r["p"]
    return 1 << level


def alignment_report(docs: DataFrame, path_a: str, path_b: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """The contract's row of each document."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    counts = staged(pair_counts(docs, path_a, path_b), "pair-counts")
    least = _head_level(counts, head_pairs)
    top = counts.where(F.col("docs") >= least).orderBy("pair").toArrow()
    head = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "docs", "best")))
    rest = counts.where(F.col("docs") < least)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    run = uuid.uuid4().hex

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(run, tokenizer_pair(path_a, path_b), head.value)
        for b in text_slices(batches, "text"):
            doc, unit, has = cache.look_up(b.column("text").to_pylist())
            sums = [np.bincount(doc, cache.stats[unit, k], minlength=b.num_rows).astype(np.int64) for k in range(1, 7)]
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1)).tolist()
            width = np.diff(cache.text_off)[unit]
            text = cache.text[ranges(cache.text_off[unit], width)].tobytes()
            at = np.concatenate([[0], np.cumsum(width)])[cut].tolist()
            sha = [hashlib.sha256(text[s:e - 1]).hexdigest() if ok else "" for s, e, ok in zip(at[:-1], at[1:], has.tolist())]
            row, key, n = cache.pairs_of(doc, unit)
            order = np.lexsort((key, row))
            row, key, n = row[order], key[order], n[order]
            start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else np.zeros(0, np.int64)
            row, key, n = row[start], key[start], np.add.reduceat(n, start) if len(start) else n
            off = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("uid"), b.column("doc_id"), *map(pa.array, sums), pa.array(sha),
                 pa.ListArray.from_arrays(off, pa.array(key)), pa.ListArray.from_arrays(off, pa.array(n))],
                ["uid", "doc_id", *names, "groups_sha256", "pairs", "times"])

    schema = ("uid long, doc_id long, " + ", ".join(f"{c} long" for c in names) +
              ", groups_sha256 string, pairs array<long>, times array<long>")
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = staged(src.mapInArrow(report, schema), "aligned")
    final = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    open_ = out.where(F.size("pairs") > 0).select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    more = (open_.select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).join(rest, "pair").groupBy("uid")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("docs")).alias("c")))
    out = (out.drop("pairs", "times").join(more, "uid", "left")
           .withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0)))
           .withColumn("count_sum", F.col("count_sum") + F.coalesce("c", F.lit(0))))
    return out.select(*final)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return alignment_report(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
