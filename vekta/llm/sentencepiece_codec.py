"""SentencePiece BPE encoding and decoding with numpy.

Encoding works on the distinct words of a slice of texts. All their symbols lie in
flat arrays; each round finds every word's smallest pair rank (a segmented
minimum), merges all its leftmost non-overlapping pairs of that rank at once, and
compacts the arrays, until no word has a pair left. Where merging at once
could differ from merging one by one (a new pair ranks no later than the one just merged),
and for very long words, a heap merges the word in order instead.

Words are cut before a run of spaces and around line breaks when the vocabulary
has no piece across such a place. Characters outside the vocabulary become byte pieces.
The model is one whose normaliser changes nothing but spaces (``▁``).

Defined results: null counts as the empty text (only the end id; decodes to ''); repeated
rows are encoded one by one; an empty table gives an empty table; texts are never cut off.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table, text_slices

SPACE = "▁"
LONG_WORD = 256   # symbols; longer words are merged by a heap
_FIND = np.uint64(0x9E3779B97F4A7C15)


class PieceVocabulary:
    """Pieces, byte pieces and the pairs that merge, of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        piece = {sp.id_to_piece(i): i for i in plain}
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # characters that only occur inside longer pieces get numbers above the vocabulary
        inner = sorted({c for p in piece for c in p} - set(piece))
        number = piece | {c: n + k for k, c in enumerate(inner)}
        self.known = n
        # a character outside every piece is numbered by its code point, above all pieces
        self.base = n + len(inner)
        self.char = np.arange(0x110000, dtype=np.int64) + self.base
        for s, i in number.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        keys, ranks, merged = [], [], []
        for p, i in piece.items():
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    keys.append(number[p[:k]] * self.base + number[p[k:]])
                    ranks.append(order[sp.get_score(i)])
                    merged.append(i)
        self.no_rank = len(scores)
        self._hash(np.array(keys, np.uint64), np.array(ranks, np.int32), np.array(merged, np.int64))
        across = [p for p in piece if SPACE in p.lstrip(SPACE)]
        self.cut_spaces = not across
        self.cut_lines = not any("\n" in p and len(p) > 1 for p in piece)
        text = [b""] * n
        for p, i in piece.items():
            text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id):
            text[i] = bytes([b])
        self.text_off = np.concatenate([[0], np.cumsum([len(x) for x in text])])
        self.text = np.frombuffer(b"".join(text), np.uint8)

    def _hash(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """Open addressing: each round places the keys whose slot is still free."""
        self.bits = max(4, int(len(keys) * 6).bit_length())
        size = 1 << self.bits
        self.slot_key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.slot_rank = np.full(size, self.no_rank, np.int32)
        self.slot_piece = np.zeros(size, np.int64)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            free = self.slot_key[slot[left]] == np.iinfo(np.uint64).max
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.slot_key[slot[put]], self.slot_rank[slot[put]], self.slot_piece[slot[put]] = keys[put], ranks[put], merged[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) % size
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FIND) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, slot) of each pair; rank ``no_rank`` where none merges."""
        key = left.astype(np.uint64) * np.uint64(self.base) + right.astype(np.uint64)
        outside = (left >= self.base) | (right >= self.base)
        slot = self._slot(key)
        hit = self.slot_key[slot] == key
        open_ = np.flatnonzero(~hit & (self.slot_rank[slot] != self.no_rank))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % len(self.slot_key)
            hit[open_] = self.slot_key[slot[open_]] == key[open_]
            open_ = open_[~hit[open_] & (self.slot_rank[slot[open_]] != self.no_rank)]
        return np.where(hit & ~outside, self.slot_rank[slot], self.no_rank), slot

    def in_order(self, symbols: np.ndarray) -> np.ndarray:
        """Merge one word pair by pair: best rank first, leftmost among equals."""
        sym = symbols.tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(lefts: list[int]) -> None:
            lefts = [i for i in lefts if i >= 0 and after[i] < len(sym)]
            if lefts:
                a, b = np.array([sym[i] for i in lefts]), np.array([sym[after[i]] for i in lefts])
                rank, slot = self.pairs(a, b)
                for i, r, s, x, y in zip(lefts, rank.tolist(), slot.tolist(), a.tolist(), b.tolist()):
                    if r < self.no_rank:
                        heapq.heappush(heap, (r, i, s, x, y))

        offer(list(range(len(sym))))
        while heap:
            _, i, slot, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = int(self.slot_piece[slot]), -1, after[j]
            if after[i] < len(sym):
                before[after[i]] = i
            offer([before[i], i])
        return np.array([s for s in sym if s >= 0], np.int64)

    def merge(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words at once: flat symbols and word lengths, in and out."""
        start = np.cumsum(length) - length
        word = np.repeat(np.arange(len(length)), length)
        by_heap = [np.flatnonzero(length > LONG_WORD)]
        live_words = np.ones(len(length), bool)
        live_words[by_heap[0]] = False
        live = live_words[word]
        s, w = sym[live], word[live]
        done_s, done_w = [], []
        while len(s):
            rank = np.full(len(s), self.no_rank, np.int32)
            slot = np.zeros(len(s), np.int64)
            same = np.flatnonzero(w[:-1] == w[1:])
            rank[same], slot[same] = self.pairs(s[same], s[same + 1])
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(s)))
            active = np.repeat(low < self.no_rank, size)
            if not active.all():
                done_s.append(s[~active]), done_w.append(w[~active])
                low, size = low[low < self.no_rank], size[low < self.no_rank]
                s, w, rank, slot = s[active], w[active], rank[active], slot[active]
                if not len(s):
                    break
            goal = np.repeat(low, size)
            hit = rank == goal
            # leftmost of overlapping places: every other one of a run of neighbours
            at = np.flatnonzero(hit)
            run = np.concatenate([[True], (np.diff(at) > 1) | (w[at[1:]] != w[at[:-1]])])
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            s_new = s.copy()
            s_new[at] = self.slot_piece[slot[at]]
            # words with several merges: is any pair that they bring about as early as this one?
            many = np.bincount(w[at], minlength=1)[w[at]] > 1
            odd = at[many]
            if len(odd):
                nxt = odd[(odd + 2 < len(s)) & (w[np.minimum(odd + 2, len(s) - 1)] == w[odd])]
                early = [nxt[self.pairs(s_new[nxt], other[nxt + 2])[0] <= goal[nxt]] for other in (s, s_new)]
                prev = odd[(odd > 0) & (w[odd - 1] == w[odd])]
                early.append(prev[self.pairs(s[prev - 1], s_new[prev])[0] <= goal[prev]])
                again = np.unique(w[np.concatenate(early)])
            else:
                again = odd
            stay = np.ones(len(s), bool)
            stay[at + 1] = False
            if len(again):
                by_heap.append(again)
                stay &= ~np.isin(w, again)
            s, w = s_new[stay], w[stay]
        for k in np.concatenate(by_heap):
            out = self.in_order(sym[start[k]:start[k] + length[k]])
            done_s.append(out), done_w.append(np.full(len(out), k))
        if not done_s:
            return sym, length
        s, w = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(w, kind="stable")
        return s[order], np.bincount(w, minlength=len(length))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, flat, and their number."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        sym, n = self.merge(self.char[code], length)
        strange = sym >= self.known
        if not strange.any():
            return sym, n
        word = np.repeat(np.arange(len(words)), n)
        number = {int(i): chr(c) for c, i in ((c, self.char[c]) for c in np.unique(code)) if i >= self.known}
        spelled = {i: self.byte_id[list(c.encode())] for i, c in number.items()}
        width = np.ones(len(sym), np.int64)
        width[strange] = [len(spelled[i]) for i in sym[strange].tolist()]
        out = np.repeat(sym, width)
        out[np.repeat(strange, width)] = np.concatenate([spelled[i] for i in sym[strange].tolist()])
        return out, np.bincount(np.repeat(word, width), minlength=len(words))

    def words(self, text: str) -> list[str]:
        s = " " + text.replace(SPACE, " ")
        if not self.cut_spaces:
            return [s.replace(" ", SPACE)] if text else []
        if not text:
            return []
        s = re.sub(" +", lambda m: " " + SPACE * len(m[0]), s) if "  " in s else s.replace(" ", " " + SPACE)
        if self.cut_lines and "\n" in s:
            s = s.replace("\n", " \n ")
        return [x for x in s.split(" ") if x]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and their number for each text (no end id)."""
        parts = [self.words(t) for t in texts]
        n_words = np.fromiter(map(len, parts), np.int64, len(parts))
        code, distinct = numbered(chain.from_iterable(parts))
        ids, n = self.encode_words(list(distinct))
        off = np.cumsum(n) - n
        width = n[code]
        end = np.cumsum(width)
        total = int(end[-1]) if len(end) else 0
        out = ids[np.repeat(off[code] - (end - width), width) + np.arange(total)] if total else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), n_words)
        return out, np.bincount(doc, width, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: pieces joined, ``▁`` as a space, the first added space left out."""
        width = np.diff(self.text_off)[ids]
        end = np.cumsum(width)
        total = int(end[-1]) if len(end) else 0
        data = self.text[np.repeat(self.text_off[ids] - (end - width), width) + np.arange(total)].tobytes() if total else b""
        cut = np.concatenate([[0], np.cumsum(counts)])
        at = np.concatenate([[0], end])[cut]
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            piece = data[a:b]
            piece = piece[1:] if piece[:1] == b" " else piece
            out.append(piece.decode("utf-8", "replace").encode())
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) with the end id last."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in text_slices(batches, "text"):
            ids, n = v.encode(pc.fill_null(b.column("text"), "").to_pylist())
            off = np.concatenate([[0], np.cumsum(n + 1)])
            with_end = np.full(int(off[-1]), v.eos, np.int32)
            last = np.zeros(len(with_end), bool)
            last[off[1:] - 1] = True
            with_end[~last] = ids
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(with_end))], ["id", "ids"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(encode, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", "doc_id")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to ''."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            n = pc.fill_null(pc.list_value_length(b.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.list_flatten(b.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.decode() for x in v.decode(ids, n)], pa.string())], ["id", "text"])

    src = encoded.select(F.col("doc_id").alias("id"), "ids")
    return src.mapInArrow(decode, f"id {src.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", "doc_id")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        number = [str(i) for i in range(v.known)]
        for b in text_slices(batches, "text"):
            ids, n = v.encode(pc.fill_null(b.column("text"), "").to_pylist())
            cut = np.concatenate([[0], np.cumsum(n)]).tolist()
            spelled = [number[i] for i in ids.tolist()]
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array(n + 1),
                pa.array([sha(" ".join([*spelled[s:e], number[v.eos]]).encode()) for s, e in zip(cut[:-1], cut[1:])]),
                pa.array([sha(x) for x in v.decode(ids, n)])], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(digest, f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", "doc_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
