"""Fixtures for the corpus operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    g = random.Random(seed)
    syllables = "the an er in on re st nd ti es or ing ly ha ble ou sh th".split()
    return " ".join("".join(g.choice(syllables) for _ in range(g.randint(1, 4))) for _ in range(words))


def documents(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def edge_rows():
    """Nulls, empty and blank texts, repeated rows, a very long text, odd characters."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "null id text here"), (5, prose(1, 30_000)),
            (6, "x" * 50_000), (7, "\x00 nul \x1c sep ½ ² 日本 𝔘 \U0001f600"), (8, "!!! ### ... 123"), (9, prose(2, 200)), (9, prose(2, 200))]
