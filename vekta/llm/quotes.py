"""Quotation linking: conversations in reply order, without quotes.

A line that starts with ``>`` marks is quoted, as deep as it has marks. Neighbouring
lines of one level form a block, whose passages are its sentences (so a block that was
wrapped anew still matches). Passages are normalised (lower case, single spaces) and hashed. The
originals of a passage are all messages of the same conversation that have it in their own words, as a sentence or a line.
A passage without such an original is looked for again, whole and line by line: as a line, or as a run of
RUN words and more inside a message (a quote may start or stop inside a sentence). For that, the messages of its conversation
are hashed over windows of the lengths that are asked for there.

A message replies to the earlier message that holds most of its outermost known passages; if two hold as many, to
the one that said more of them first, then to the later one. Its thread is found by doubling the reply
links, so a chain of n replies takes log n rounds. ``position`` numbers the messages of a conversation by thread, depth and turn, so that
each stands behind the one that it replies to.

Messages of a conversation that hold the same quoted passages get the same votes from any
reply, so only the first of them is a candidate. A reply that quotes a single known passage goes to
its first speaker without a join of the candidates.

Defined results: a null text gives null own text and no quotes; a null
conversation links nothing; a null turn comes before all others and replies to nothing; repeated rows are separate messages; ``text`` has no quotes at all,
``text_unlinked`` still has the quoted blocks of which no passage is known, marks and all; a message that quotes nothing known has
no reply_to, depth 0 and is its own thread; texts are read whole, whatever their length; an empty table gives an empty table; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, text_slices
from .merkle import placed

RUN = 3   # words of the shortest quote that is found inside a line

_mark = re.compile(r"^((?:[ \t]*>)+)[ \t]?(.*)$", re.S)
_intro = re.compile(r"^\s*(?:on\b.*|\S.{0,80})\bwrote:\s*$", re.I)
_sentence = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode()) - (1 << 63)


def _spoken(text: str) -> list[list[str]]:
    """The words of each sentence."""
    return [w for w in (s.lower().split() for s in _sentence.split(text)) if w]


def _lines(text: str) -> list[list[str]]:
    return [w for w in (x.lower().split() for x in text.split("\n")) if w]


def passages(text: str) -> list[int]:
    """Hashes of the normalised sentences and lines of a message's own words."""
    return list(dict.fromkeys([_hash(w) for w in _spoken(text)] + ([_hash(w) for w in _lines(text)] if "\n" in text else [])))


def windows(text: str, lengths: list[int]) -> list[int]:
    """Hashes of all runs of so many words."""
    words = text.lower().split()
    spaced = _sentence.sub(" ", text).lower().split()     # ideographic sentences stand apart, as in a quote
    return list({_hash(w[i:i + n]) for w in ([words] if words == spaced else [words, spaced]) for n in lengths for i in range(len(w) - n + 1)})


def parse(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """(own text, quoted blocks as (level, first line, text)) of one message."""
    if ">" not in text:
        return text, []
    own: list[str] = []
    blocks: list[tuple[int, int, str]] = []
    block: list[str] = []
    level = start = 0
    for number, line in enumerate([*text.split("\n"), None]):
        m = _mark.match(line) if line is not None else None
        deep = m[1].count(">") if m else 0
        if deep != level:
            if level:
                blocks.append((level, start, "\n".join(block)))
                block.clear()
            elif own and _intro.match(own[-1]):  # the line that announces the quote
                own.pop()
            level, start = deep, number
        if deep:
            block.append(m[2])
        elif line is not None:
            own.append(line)
    return ("\n".join(own).strip("\n") if blocks else text), blocks


def without(text: str, linked: list[int]) -> str:
    """``text`` without the blocks of these numbers, and without the lines that announce them."""
    blocks = parse(text)[1]
    gone = {blocks[k][1] + i for k in linked for i in range(blocks[k][2].count("\n") + 1)}
    lines = text.split("\n")
    quoted = {blocks[k][1] + i for k in range(len(blocks)) for i in range(blocks[k][2].count("\n") + 1)}
    for k in linked:
        before = blocks[k][1] - 1
        if before >= 0 and before not in quoted and _intro.match(lines[before]):
            gone.add(before)
    return "\n".join(x for i, x in enumerate(lines) if i not in gone).strip("\n") if linked else text


def parsed(messages: DataFrame, text_col: str) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with the hashes of their own words and their quoted passages, numbered and written."""
    line = pa.struct([("h", pa.int64()), ("n", pa.int32())])
    kind = pa.list_(pa.struct([("block", pa.int32()), ("level", pa.int32()), ("h", pa.int64()), ("n", pa.int32()), ("lines", pa.list_(line))]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            texts = b.column("text").to_pylist()
            rows = [parse(t) if t is not None else (None, []) for t in texts]
            quotes = []
            for _, blocks in rows:
                quotes.append([{"block": k, "level": level, "h": _hash(s.lower().split()), "n": len(s.split()),
                                "lines": [{"h": _hash(w), "n": len(w)} for w in _lines(s)] if "\n" in s else []}
                               for k, (level, _, block) in enumerate(blocks) for s in _sentence.split(block) if s.strip()])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array([r[0] for r in rows], pa.string()),
                 pa.array([passages(r[0]) if r[0] else [] for r in rows], pa.list_(pa.int64())), pa.array(quotes, kind)],
                ["conv_id", "turn", "role", "text", "words", "own", "quotes"])

    src = messages.select("conv_id", "turn", "role", F.col(text_col).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields)
    rows = src.mapInArrow(work, f"{kinds}, words string, own array<long>, quotes array<struct<block: int, level: int, h: long, n: int, "
                                "lines: array<struct<h: long, n: int>>>>")
    return staged(rows.withColumn("uid", F.monotonically_increasing_id()), "messages")


def _windows_asked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(uid, conv_id, turn, h): runs of words of the lengths that ``asked`` (conv_id, n) has for a conversation."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "words"):
            found = [windows(t or "", n) for t, n in zip(b.column("words").to_pylist(), b.column("lengths").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("uid", "conv_id", "turn")), pa.array(found, pa.list_(pa.int64()))],
                                             ["uid", "conv_id", "turn", "hs"])

    lengths = asked.groupBy("conv_id").agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    src = rows.select("uid", "conv_id", "turn", "words").join(lengths, "conv_id").select("uid", "conv_id", "turn", "words", "lengths")
    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in ("uid", "conv_id", "turn"))
    return src.mapInArrow(work, f"{kinds}, hs array<long>").select("uid", "conv_id", "turn", F.explode("hs").alias("h"))


def _linked(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """``quoted`` (uid, conv_id, turn, unit, block, level, h) with its first speaker (o_turn, o_uid), where that is an earlier message."""
    first = (said.join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
             .groupBy("conv_id", "h").agg(F.min(F.struct("turn", "uid")).alias("o")).select("conv_id", "h", F.col("o.turn").alias("o_turn"), F.col("o.uid").alias("o_uid")))
    return quoted.join(first, ["conv_id", "h"]).where("o_turn < turn").select("uid", "conv_id", "turn", "unit", "block", "level", "h", "o_turn", "o_uid")


def link_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text (own words), n_quotes, n_linked, reply_to (turn), thread (turn), depth,
    position (in its conversation, from 0), text_unlinked (the text without its linked blocks only)."""
    rows = parsed(messages, text_col)
    unit = rows.select("uid", "conv_id", "turn", F.posexplode("quotes").alias("unit", "q")).select("uid", "conv_id", "turn", "unit", "q.*")
    own = rows.select("uid", "conv_id", "turn", F.explode("own").alias("h"))
    whole = staged(_linked(unit.select("uid", "conv_id", "turn", "unit", "block", "level", "h"), own), "quote-links")
    # passages without an original: whole as a run of words, and line by line as a line or a run
    lost = staged(unit.join(whole.select("uid", "unit"), ["uid", "unit"], "left_anti")
                  .withColumn("part", F.explode(F.concat(F.array(F.struct("h", "n")), "lines"))).where("conv_id IS NOT NULL")
                  .select("uid", "conv_id", "turn", "unit", "block", "level", F.col("part.h").alias("h"), F.col("part.n").alias("n")), "quote-lost")
    wanted = lost.select("conv_id", "h").distinct()
    runs = _windows_asked(rows, lost.where(F.col("n") >= RUN).select("conv_id", "n")).join(wanted, ["conv_id", "h"], "left_semi")
    also = staged(own.join(wanted, ["conv_id", "h"], "left_semi").select("uid", "conv_id", "turn", "h")
                  .unionByName(runs.select("uid", "conv_id", "turn", "h")).distinct(), "quote-runs")
    links = staged(whole.unionByName(_linked(lost, also)), "quote-links")
    said = own.unionByName(also).distinct()
    # a message's outermost quotes are of its smallest level
    level = links.groupBy("uid").agg(F.min("level").alias("level"), F.count_distinct("unit").alias("n_linked"), F.collect_set("block").alias("gone"))
    votes = staged(links.join(level.select("uid", "level"), ["uid", "level"])
                   .groupBy("uid", "conv_id", "turn", "h", "o_uid", "o_turn").count(), "quote-votes")
    kinds = votes.groupBy("uid").agg(F.count("*").alias("kinds"))
    several = votes.join(kinds.where("kinds > 1").select("uid"), "uid", "left_semi")
    # messages with the same quoted passages are one candidate, the first of them
    holds = said.join(several.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
    sets = holds.groupBy("conv_id", "turn", "uid").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    able = (sets.groupBy("conv_id", "hs").agg(F.min(F.struct("turn", "uid")).alias("c"))
            .select("conv_id", F.explode("hs").alias("h"), F.col("c.turn").alias("c_turn"), F.col("c.uid").alias("c_uid")))
    held = (several.join(able, ["conv_id", "h"]).where("c_turn < turn").groupBy("uid", "c_uid", "c_turn")
            .agg(F.sum("count").alias("n"), F.sum(F.when(F.col("o_uid") == F.col("c_uid"), F.col("count")).otherwise(0)).alias("n_first")))
    most = held.groupBy("uid").agg(F.max(F.struct("n", "n_first", "c_turn", "c_uid")).alias("v")).select("uid", F.col("v.c_uid").alias("up"), F.col("v.c_turn").alias("reply_to"))
    single = votes.join(kinds.where("kinds = 1").select("uid"), "uid", "left_semi").select("uid", F.col("o_uid").alias("up"), F.col("o_turn").alias("reply_to"))
    parent = staged(single.unionByName(most).join(level.select("uid", "n_linked", "gone"), "uid").select("uid", "n_linked", "gone", "up", "reply_to"), "replies")
    chain = parent.select("uid", F.col("up").alias("root"), F.col("reply_to").alias("thread"), F.lit(1).alias("depth"))
    while True:
        above = chain.select(F.col("uid").alias("root"), F.col("root").alias("r2"), F.col("thread").alias("t2"), F.col("depth").alias("d2"))
        both = staged(chain.join(above, "root", "left"), "threads")
        done = both.where("r2 IS NOT NULL").isEmpty()
        chain = both.select("uid", F.coalesce("r2", "root").alias("root"), F.coalesce("t2", "thread").alias("thread"),
                            (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"))
        if done:
            break
    linked = (rows.join(parent.select("uid", "n_linked", "gone", "reply_to"), "uid", "left").join(chain.select("uid", "thread", "depth"), "uid", "left")
              .select("uid", "conv_id", "turn", "role", F.col("words").alias("text"), F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
                      "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
                      F.col("text").alias("text_unlinked"), "gone"))
    linked = staged(linked, "quote-linked")
    order = placed(linked.select(F.col("conv_id").alias("grp"), F.struct("thread", "depth", "turn").alias("key"),
                                 F.lit("").alias("hash"), F.col("uid").alias("carried")), "quote-order")
    order = order.select(F.col("carried").alias("uid"), F.col("pos").alias("position"))
    return _own_words(linked.join(order, "uid"))


def _own_words(linked: DataFrame) -> DataFrame:
    """Texts without their linked blocks; the blocks' numbers go."""
    names = [c for c in linked.columns if c not in ("uid", "gone")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text_unlinked"):
            text = [without(t, k) if k else t for t, k in zip(b.column("text_unlinked").to_pylist(), b.column("gone").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text_unlinked" else b.column(c) for c in names], names)

    return linked.mapInArrow(work, ", ".join(f"{c} {linked.schema[c].dataType.simpleString()}" for c in names))


def op3_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))
