"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents longer than a sequence are cut into full pieces, the first piece being
the shorter one. Partitions best-fit their own items (largest first) and close
the nearly full bins. Underfull bins go on as items of the next round,
over fewer partitions, until one partition is left or a round merges next to
nothing; then all bins are closed. The rows of every round are written to the
shared folder, so each round reads from tables only.

Defined results: a null or empty text is one piece with only the end id; repeated rows
are packed one by one (rows are told apart by their own number, not by id); an
empty table gives an empty table; no document is dropped or shortened.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, text_slices

CAPACITY = 1024
END_ID = 2
NEARLY_FULL = 8          # most free places of a bin that is closed before the last round
FIRST_ITEMS = 10_000     # items of a task in the first round
FAN_IN = 8               # tasks whose underfull bins meet in one task of the next round
ITEMS_A_TASK = 200_000   # most items of any task
CACHED_TOKENS = 150_000  # distinct pre-tokens whose ids a worker remembers
LEAST_GAIN = 0.01        # a round that merges less than this share of its items is the last


class ByteTokenizer:
    """The ids that the ``tokenizers`` library gives for a byte-level BPE file,
    through tiktoken's merge loop over distinct pre-tokens."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the byte alphabet: printable bytes stand for themselves, the others follow from 256
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        added = spec.get("added_tokens", ())
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings are not known here")
        # the library takes added tokens out of a text first, the longest of those that start at one place
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        # the same pattern for re, right for texts in which \w and \s have no character outside \p{L}, \d, _ and \s
        self.split_plain = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.not_plain = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ]").search
        self.known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.ids, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _pieces(self, text: str) -> list[str]:
        """Added tokens and the pre-tokens between them (which hold no added token)."""
        if self.cut is None or not self.cut.search(text):
            return self.split(text) if self.not_plain(text) else self.split_plain(text)
        return [x for part in self.cut.split(text) for x in ([part] if part in self.added else self.split(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and their number for each text."""
        if len(self.known) > CACHED_TOKENS:
            self._clear()
        parts = [self._pieces(t) for t in texts]
        known, before = self.known, len(self.known)
        code = np.array([known.setdefault(x, len(known)) for x in chain.from_iterable(parts)], np.int64)
        if len(known) > before:
            new = [[self.added[x]] if x in self.added else self.bpe.encode_ordinary(x) for x in list(known)[before:]]
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(new), np.int32)])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum([len(x) for x in new])])
        width = np.diff(self.off)[code]
        end = np.cumsum(width)
        total = int(end[-1]) if len(end) else 0
        ids = self.ids[np.repeat(self.off[code] - (end - width), width) + np.arange(total)] if total else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        return ids, np.bincount(doc, width, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                    keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: uid, doc_id, piece, start, length, ids_crc32 (and ids). Written to
    the shared folder, which fixes the numbers."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in text_slices(batches, "text"):
            ids, n = t.encode(pc.fill_null(b.column("text"), "").to_pylist())
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            at = 0
            for k, count in enumerate(n.tolist()):
                own = np.append(ids[at:at + count], end_id).astype("<u4")
                at += count
                cuts = list(range(len(own) % capacity, len(own) + 1, capacity))
                cuts = cuts if cuts[0] == 0 else [0, *cuts]
                for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                    row.append(k), piece.append(p), start.append(s), length.append(e - s)
                    crc.append(zlib.crc32(own[s:e].tobytes()))
                    if keep_ids:
                        kept.append(own[s:e].astype(np.int32))
            columns = [b.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32()))), names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"doc_id {src.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    pieces = src.mapInArrow(cut, schema + ", ids array<int>" * keep_ids)
    return staged(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def best_fit(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: bin and offset of each item, and the free places of
    each bin. Open bins are stacked by free places; the fullest that still
    fits is the lowest set bit of a mask."""
    bins, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    free: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k in np.argsort(-size, kind="stable").tolist():
        s = int(size[k])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[k], offset[k] = b, capacity - room
        free[b] = room = room - s
        if room:
            stacks[room].append(b)
            mask |= 1 << room
    return bins, offset, free


def pack_round(items: DataFrame, capacity: int, last: bool) -> DataFrame:
    """(item, size) -> (item, bin, at, bin_size, closed); a bin goes by its first item's number."""
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # ITEMS_A_TASK rows of two numbers at most
        if not sum(b.num_rows for b in parts):
            return
        rows = pa.Table.from_batches(parts)
        item, size = rows["item"].to_numpy(), rows["size"].to_numpy()
        bins, at, free = best_fit(size, capacity)
        name = np.zeros(len(free), np.int64)
        name[bins[at == 0]] = item[at == 0]
        room = np.array(free)[bins]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(name[bins]), pa.array(at), pa.array(capacity - room),
                                          pa.array((room <= NEARLY_FULL) | last)], ["item", "bin", "at", "bin_size", "closed"])

    return items.mapInArrow(fit, "item long, bin long, at long, bin_size long, closed boolean")


def assign_bins(pieces: DataFrame, capacity: int = CAPACITY, items_a_task: int = ITEMS_A_TASK) -> DataFrame:
    """(uid, sequence_id, offset) of all pieces (uid, length)."""
    whole = pieces.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.where(F.col("length") < capacity).select(F.col("uid").alias("item"), F.col("length").alias("size"))
    n = items.count()
    done, placed = [whole], None
    parts = max(1, -(-n // FIRST_ITEMS))
    while n:
        last = parts == 1
        fitted = staged(pack_round(items.repartition(parts), capacity, last), "packed-round")
        if placed is None:
            placed = fitted.select(F.col("item").alias("uid"), "bin", "at", "closed")
        else:
            placed = staged(placed.select("uid", F.col("bin").alias("item"), F.col("at").alias("own"))
                            .join(fitted, "item").select("uid", "bin", (F.col("own") + F.col("at")).alias("at"), "closed"), "packed-pieces")
        open_bins = fitted.where(~F.col("closed") & (F.col("at") == 0))
        left, all_bins = fitted.where(F.col("at") == 0).agg(F.sum((~F.col("closed")).cast("long")), F.count("*")).first()
        stuck = not last and parts <= -(-n // items_a_task) and n - all_bins < LEAST_GAIN * n
        final = last or stuck
        closed = placed if final else placed.where("closed")
        done.append(closed.select("uid", F.col("bin").alias("sequence_id"), F.col("at").alias("offset")))
        if final:
            break
        placed, items, n = placed.where("NOT closed"), open_bins.select(F.col("bin").alias("item"), F.col("bin_size").alias("size")), left
        parts = max(1, -(-n // items_a_task), parts // FAN_IN)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    pieces = tokenize_pieces(docs, path, capacity, keep_ids=keep_ids)
    return pieces.join(assign_bins(pieces.select("uid", "length"), capacity), "uid").drop("uid")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
