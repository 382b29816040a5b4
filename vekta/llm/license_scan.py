"""License scan: fixed phrases, and an exact set-similarity join of text blocks
with license templates.

A block is a window of 64 consecutive words, one every 32 words, so a notice of up to 33
words lies whole in some block however it is wrapped. Templates of more words get windows
of twice, four times, ... that length and stride (``widening``). A block matches a
template when it holds at least 0.8 of the template's distinct words. The join is
exact: words are ordered by their document frequency over the whole corpus
(rarest first), a template's prefix is its first n - c + 1 words (c: words needed), and a
pair that shares a prefix word must pass the length filter and the positional filter
before its overlap is counted. Words outside all templates cannot add to
an overlap, so only template words are counted, sorted and shuffled.

Bags of words cannot tell notices apart that differ in one word (nc or sa, 2 or 3,
Lesser or not), so a match of a template in ``CONFIRM`` counts only where its block
names that license and version, whatever other templates are given. The DuckDB SQL has the same rule without look-around: names that do not
count are masked first.

DataFrame functions only. Defined results: a null or empty text has no words, no
labels and score 0; repeated rows each keep their own row; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK, STRIDE, CONTAINMENT = 64, 32, 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

# Base phrases of the query's contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of common licenses.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}


def _named(name: str, version: int, other: str = "") -> str:
    """Pattern of a license's name with the version, over words with single spaces: the
    one right before the name, or the first number after it (at most 16 words on, behind
    others joined by and/or), which must be called a version if another one stands before the name."""
    word = rf"(?!v?[0-9]{{1,2}} {other})\S+ "
    listed = r"(?:v?[0-9]{1,2} (?:[0-9] )?(?:or|and) (?:the )?(?:versions? )?)*"
    return (rf" (?<![0-9] of the )(?<![0-9] of the gnu ){name} (?:{word}){{0,16}}?{listed}v?{version} "
            rf"| {name} (?:{word}){{0,16}}?(?:versions? |v){version} | v?{version} (?:0 )?(?:of |the |gnu |cc )*{name} ")


# What a block must say besides the words of a template, and a template word that such a block has.
CONFIRM = {
    "apache-2.0": ("apache", _named("apache", 2)),
    "cc-by-nc-4.0": ("nc", _named("by nc(?! sa | nd )", 4, "|by |sa |nd ")),
    "cc-by-sa-4.0": ("sa", _named("by sa", 4, "|by |nc |nd ")),
    "gpl-3.0": ("general", _named("(?<!lesser )(?<!library )(?<!affero )general public license", 3)),
    "mit": ("person", "^(?!.* person or organization )"),  # the Boost license has MIT's words
    "mpl-2.0": ("mozilla", _named("mozilla public license", 2)),
}


# The same in SQL: (what masks names that do not count, and by what), the name, the version, and words that may not lie between them.
NAMES_SQL = {
    "apache-2.0": (None, "apache", 2, ""),
    "cc-by-nc-4.0": ((" by nc (sa|nd) ", " X X X "), "by nc", 4, "by|sa|nd"),
    "cc-by-sa-4.0": (None, "by sa", 4, "by|nc|nd"),
    "gpl-3.0": ((" (lesser|library|affero) general public license ", " \\1 general public M "), "general public license", 3, ""),
    "mpl-2.0": (None, "mozilla public license", 2, ""),
}


def _confirmed_sql(template: str, said: str) -> str:
    """SQL condition on the text of a block, spelled like ``said``, for a match of ``template``. Texts are in lower case, so
    the capitals stand for nothing else: X bars the way from name to version, N is the name, M takes no part."""
    if template == "mit":
        return f"NOT contains({said}, ' person or organization ')"
    mask, name, version, barred = NAMES_SQL[template]

    def replaced(text: str, what: str, by: str) -> str:
        return f"regexp_replace({text}, '{what}', '{by}', 'g')"

    if mask:
        said = replaced(said, *mask)
    last = "X X" if barred else f"{name.rpartition(' ')[0]} M".strip()
    fresh = replaced(said, f"([0-9]) of the (gnu )?{name} ", f"\\1 of the \\2{last} ")
    before = f"regexp_matches({said}, ' v?{version} (?:0 )?(?:of |the |gnu |cc )*{name} ')"
    if barred:
        said, fresh = (replaced(t, f" {name} ", " N ") for t in (said, fresh))
        for _ in range(2):                                  # neighbours share a space
            said, fresh = (replaced(t, f" ({barred}) ", " X ") for t in (said, fresh))
        name = "N"
    word = "(?:[^ v0-9XN][^ ]*|v|v[^0-9 ][^ ]*|v?[0-9]{1,2}[^0-9 ][^ ]*|v?[0-9]{3}[^ ]*) "    # any but a number of one or two digits
    listed = "(?:v?[0-9]{1,2} (?:[0-9] )?(?:or|and) (?:the )?(?:versions? )?)*"
    return (f"(regexp_matches({fresh}, ' {name} (?:{word}){{0,16}}?{listed}v?{version} ')"
            f" OR regexp_matches({said}, ' {name} (?:{word}){{0,16}}?(?:versions? |v){version} ') OR {before})")


def spaced_words(text: Column) -> Column:
    """Each word with a space before and one after it, joined ('' without words):
    phrases found in it are whole words, and neighbours never share a space."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    body = F.trim(F.regexp_replace(lower, SEPARATORS, "  "))
    return F.when(body == "", "").otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def _words_in(spaced: Column) -> Column:
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def base_columns(docs: DataFrame, spaced: str, phrases: dict[str, str]) -> DataFrame:
    """n_words, n_base, first_word, last_word and the phrase labels of each text."""
    s = F.col(spaced)
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        needle = " " + phrase.replace(" ", "  ") + " "
        there = s.contains(needle)
        places = (F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))) / len(needle)
        counts.append(F.when(there, places.cast("long")).otherwise(F.lit(0)))
        firsts.append(F.when(there, _words_in(F.substring_index(s, needle, 1))))
        lasts.append(F.when(there, F.col("n_words") - _words_in(F.substring_index(s, needle, -1)) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    return docs.withColumn("n_words", _words_in(s)).withColumns({
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": F.least(*firsts), "last_word": F.greatest(*lasts),
        "base_list": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    })


def template_words(text: str) -> list[str]:
    """The words of a template, cut like those of the texts."""
    return [w for w in re.split(SEPARATORS, text.translate(LOWER)) if w]


def widening(n_words: int) -> int:
    """The least power of two so that a run of ``n_words`` words lies whole in some
    block of BLOCK times it, one every STRIDE times it, wherever the run starts."""
    wide = 1
    while (BLOCK - STRIDE) * wide + 1 < n_words:
        wide *= 2
    return wide


def _block(by_rank: Column, words: Column, anchors: Column) -> Column:
    """The template words of a block, and all its words where a match may have to be confirmed."""
    block = F.array_intersect(by_rank, words)
    spoken = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.struct(block.alias("block"), F.when(F.arrays_overlap(words, anchors), spoken).otherwise("").alias("said"))


def block_matches(docs: DataFrame, keys: list[str], spaced: str, templates: dict[str, str],
                  containment: float = CONTAINMENT, confirm: dict[str, tuple[str, str]] = CONFIRM) -> DataFrame:
    """(keys..., template, containment): every template that a block of the
    row holds and confirms, with the largest containment over the row's blocks.
    ``confirm`` has the rules by template name; a template without one needs none."""
    spark = docs.sparkSession
    split = {name: template_words(text) for name, text in templates.items()}
    sets = {name: sorted(set(words)) for name, words in split.items() if words}
    if not sets:
        return docs.select(*keys, F.lit("").alias("template"), F.lit(0.0).alias("containment")).limit(0)
    vocabulary = F.array(*[F.lit(w) for w in sorted(set().union(*sets.values()))])
    words = docs.select(*keys, F.split(F.trim(spaced), "  ").alias("words"))
    # one row for each template word, however large the corpus
    seen = dict(words.select(F.explode(F.array_intersect("words", vocabulary)).alias("w")).groupBy("w").count().collect())
    order = sorted(set().union(*sets.values()), key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    need = {name: max(1, -(-round(containment * 1000) * len(s) // 1000)) for name, s in sets.items()}
    by_rank = F.array(*[F.lit(w) for w in order])
    anchors = F.array(*[F.lit(w) for w in sorted({a for a, _ in confirm.values()})]).cast("array<string>")

    def matches(names: list[str], wide: int) -> DataFrame:
        """Matches of the templates that go into windows of ``wide`` blocks."""
        block, stride = BLOCK * wide, STRIDE * wide
        prefixes = [(w, name, i, len(sets[name]), need[name], sorted(sets[name], key=rank.get), confirm.get(name, (None, None))[1])
                    for name in names for i, w in enumerate(sorted(sets[name], key=rank.get)[:len(sets[name]) - need[name] + 1])]
        prefix_table = spark.createDataFrame(prefixes, "w string, template string, i int, n int, need int, tokens array<string>, confirm string")
        prefix_words = F.array(*[F.lit(w) for w in sorted({p[0] for p in prefixes})])
        near = words.where(F.arrays_overlap("words", prefix_words))
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("words") - block) / stride).cast("int")))
        # array_intersect keeps the order of its first argument: words by global frequency
        blocks = (near.select(*keys, F.explode(F.transform(starts, lambda k: _block(
            by_rank, F.slice(F.col("words"), k * stride + 1, block), anchors))).alias("b"))
            .select(*keys, "b.block", "b.said").where(F.size("block") >= min(need[name] for name in names)))
        probes = blocks.select(*keys, "block", "said", F.posexplode(F.array_intersect("block", prefix_words)).alias("k", "w"))
        return (probes.join(F.broadcast(prefix_table), "w")
                .where(F.size("block") >= F.col("need"))
                .withColumn("j", F.array_position("block", F.col("w")).cast("int") - 1)
                .where(1 + F.least(F.col("n") - F.col("i") - 1, F.size("block") - F.col("j") - 1) + F.least("i", "j") >= F.col("need"))
                .withColumn("shared", F.size(F.array_intersect("block", "tokens")))
                .where(F.col("shared") >= F.col("need"))
                .where(F.col("confirm").isNull() | F.rlike("said", F.col("confirm"))))

    widths = {name: widening(len(split[name])) for name in sets}
    pairs = None
    for wide in sorted(set(widths.values())):
        found = matches([name for name in sets if widths[name] == wide], wide)
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.groupBy(*keys, "template").agg(F.max(F.col("shared") / F.col("n")).alias("containment"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per input row: id, counts and places of the phrases, base and
    all labels, and the best containment (1 where a phrase stands)."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"),
                      spaced_words(F.col(text_col)).alias("spaced"))
    base = base_columns(src, "spaced", phrases).drop("spaced")
    keys = ["doc_id", "text_key"]
    found = (block_matches(src, keys, "spaced", templates).groupBy(*keys)
             .agg(F.collect_set("template").alias("found"), F.max("containment").alias("best"))
             .select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "found", "best"))
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    no_label = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", F.coalesce("found", no_label))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"))


def license_sql(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL that compares every block with every template."""
    def quoted(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    places = " UNION ALL ".join(
        f"SELECT doc, i - 1 AS place, '{label}' AS label FROM words, unnest(range(1, len(w) + 1)) AS u(i) WHERE "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in phrases.items())
    split = {name: template_words(text) for name, text in templates.items()}
    kinds = ", ".join(f"('{name}', {quoted(sorted(set(words)))}, {widening(len(words))})" for name, words in split.items() if words)
    wides = ", ".join(f"({w})" for w in sorted({widening(len(words)) for words in split.values() if words}))
    confirmed = " ".join(f"WHEN name = '{name}' THEN {_confirmed_sql(name, 'said')}" for name in split if name in CONFIRM)
    confirmed = f"CASE {confirmed} ELSE true END" if confirmed else "true"
    return f"""
WITH words AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS ({places}),
base AS (SELECT doc, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc),
blocks AS (SELECT doc, wide, list_slice(w, {STRIDE} * wide * k + 1, {STRIDE} * wide * k + {BLOCK} * wide) AS b FROM words, (VALUES {wides}) AS v(wide),
    unnest(range(0, 1 + greatest(0, ceil((len(w) - {BLOCK} * wide) / ({STRIDE}.0 * wide))::INT))) AS u(k)),
held AS (SELECT doc, name, ' ' || array_to_string(b, ' ') || ' ' AS said, len(list_intersect(tokens, b)) / len(tokens) AS held
    FROM blocks JOIN (VALUES {kinds}) AS t(name, tokens, size) ON wide = size WHERE len(list_intersect(tokens, b)) / len(tokens) >= {CONTAINMENT}),
found AS (SELECT doc, name, max(held) AS held FROM held WHERE {confirmed} GROUP BY doc, name),
best AS (SELECT doc, max(held) AS held, list(name) AS names FROM found GROUP BY doc)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(names, [])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(held, 0.0) END::DOUBLE AS score
FROM words LEFT JOIN base USING (doc) LEFT JOIN best USING (doc)"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
