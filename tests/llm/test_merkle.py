"""Merkle manifest against a plain recursive build."""

import hashlib
import random
import zlib

import pytest

from helpers import DOCS, edge_rows, prose
from vekta.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(hashes):
    """(end of the tree, sibling lists of every leaf)."""
    paths, place, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, p in enumerate(place):
            run = level[p // 16 * 16:p // 16 * 16 + 16]
            paths[i].append((run[:p % 16], run[p % 16 + 1:]))
        place = [p // 16 for p in place]
        level = [h(*level[i:i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        g = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (g, *climb([leaf(r) for r in g]))
    root, tops = climb([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(trees[s][0], trees[s][2]):
            path, start = path + top, leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                start = leaf(r[:4] + ("".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]),))
            for left, right in path:
                start = h(*left, start, *right)
            out.append((r[0], leaf(r), trees[s][1], root, h(*[x for left, right in path for x in left + right]), start, start == root))
    return sorted(out, key=str)


def run(spark, rows, extra=None):
    docs = spark.createDataFrame([(i, t, g, s, n) for i, s, g, n, t in rows], DOCS)
    if extra:
        docs = docs.selectExpr("*", *extra)
    m = merkle.manifest(docs)
    sib = merkle.F.array_join(merkle.F.transform("proof", lambda s: merkle.F.concat(s["left"], s["right"])), "")
    got = m.select("doc_id", "leaf", "subroot", "root", merkle.digest(sib).alias("p"), "folded_root", "verified").collect()
    return sorted(map(tuple, got), key=str)


def test_hot_source_and_deep_trees(spark):
    g = random.Random(1)
    rows = [(i, "hot", "en", i, f"Text {i}") for i in g.sample(range(10_000), 700)]
    rows += [(10_000 + i, f"s{i}", "de", None, prose(i, 3).title()) for i in range(40)]   # 41 sources: three levels above, lone leaves
    rows += [(20_000 + i, "é", None, 0, "É") for i in range(17)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("sources", [["one"], [None, "", "a", "ä", "Z", "\U0001f600", "￿"]])
def test_edges(spark, sources):
    rows = [(i, sources[k % len(sources)], None if k % 3 else "en", k % 4 or None, t) for k, (i, t) in enumerate(edge_rows())]
    assert run(spark, rows, ["1 AS tree", "2 AS hash", "3 AS POS", "4 AS path"]) == brute(rows)


def test_one_row_and_empty(spark):
    assert run(spark, [(5, None, None, None, None)]) == brute([(5, None, None, None, None)])
    assert run(spark, []) == []


def test_tampering_is_found_where_letters_change(spark):
    rows = [(i, "s", "en", 1, "UPPER" if i % 2 else "lower") for i in range(60)]
    got = run(spark, rows)
    bad = {r[0] for r in got if not r[6]}
    assert bad == {i for i in range(60) if i % 2 and zlib.crc32(str(i).encode()) % 5 == 0} and bad


def test_joined_rounds_equal_broadcast_rounds(spark, monkeypatch):
    rows = [(i, f"s{i % 3}", "en", 1, str(i)) for i in range(900)]
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 0)
    assert run(spark, rows) == brute(rows)
