"""Tokenizer alignment against the two libraries and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from helpers import documents, edge_rows, prose
from vekta.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(i):
        s = b.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if b.is_byte(i) else s.replace("▁", " ").encode()

    return a, lambda i: bytes(byte[c] for c in a.id_to_token(i)), b, piece


def brute_groups(text, libraries):
    a, text_a, b, text_b = libraries
    if not text:
        return []
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    if b"".join(map(text_a, ia)) != raw or b"".join(map(text_b, ib)) != raw:
        return []
    ends_a, ends_b = np.cumsum([len(text_a(i)) for i in ia]).tolist(), np.cumsum([len(text_b(i)) for i in ib]).tolist()
    out, x, y = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        m, n = ends_a.index(e, x) + 1, ends_b.index(e, y) + 1
        out.append((ia[x:m], ib[y:n]))
        x, y = m, n
    return out


def brute(rows, libraries):
    groups = [brute_groups(t, libraries) for _, t in rows]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in groups]
    count = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for (i, _), g, c in zip(rows, groups, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def report(spark, rows, **how):
    docs = documents(spark, rows).selectExpr("*", "1 AS uid", "2 AS pair", "3 AS PAIRS", "4 AS docs")
    return sorted(map(tuple, alignment.alignment_report(docs, A, B, **how).collect()), key=str)


def odd_rows():
    g = random.Random(5)
    rows = edge_rows() + [(20, "a ▁b"), (21, "<|endoftext|> x</s><s>"), (22, "a  b   c \n\n d\t\te \t f\n  g "), (23, "  lead"), (24, "trail \n"),
                          (25, "it's we'll I'M"), (26, "中文。日本語のテキスト、한국어"), (27, "é ﬁ Å ​ x y　z\x85w"), (28, "\n"), (29, " ")]
    alphabet = " \n\t\r\x1c 'ab1.,é中▂\U0001f600"
    rows += [(100 + k, "".join(g.choice(alphabet) for _ in range(g.randint(1, 60)))) for k in range(300)]
    return rows + [(500 + k, prose(k % 7, 40)) for k in range(30)]


def test_report_equals_brute_force(spark, libraries):
    rows = [(i, t if i != 5 else t[:20_000]) for i, t in odd_rows()]
    assert report(spark, rows) == brute(rows, libraries)


def test_pairs_beyond_the_broadcast_are_joined(spark, libraries, monkeypatch):
    rows = [(i, t) for i, t in odd_rows() if i is None or i >= 9]
    want = brute(rows, libraries)
    assert report(spark, rows, head_pairs=20) == want
    assert report(spark, rows, head_pairs=0) == want


def test_forgetting_units_changes_nothing(monkeypatch):
    pair = alignment.tokenizer_pair(A, B)
    texts = [prose(k % 9, 30) for k in range(60)]
    nothing = (np.zeros(0, np.int64),) * 3
    whole = alignment.UnitCache(pair, nothing)
    doc, unit, _ = whole.look_up(texts)
    monkeypatch.setattr(alignment, "CACHED_UNITS", 40)
    small = alignment.UnitCache(pair, nothing)
    for k, t in enumerate(texts):
        _, u, _ = small.look_up([t])
        want = whole.stats[unit[doc == k]]
        assert (small.stats[u] == want).all()
        assert [x.tolist() for x in small.pairs_of(u * 0, u)] == [x.tolist() for x in whole.pairs_of(u * 0, unit[doc == k])]
    assert len(small.known) < len(whole.known)


def test_small_blocks(libraries, monkeypatch):
    pair = alignment.tokenizer_pair(A, B)
    texts = [" " + t for _, t in odd_rows() if t and len(t) < 1000]
    whole = alignment.Aligned(pair, texts)
    want = whole.pairs()
    monkeypatch.setattr(alignment, "BLOCK", 3)
    again = alignment.Aligned(pair, texts)
    assert all((x == y).all() for x, y in zip(want, again.pairs()))
    assert all((x == y).all() for x, y in zip(whole.spelled(pair), again.spelled(pair)))


def test_overlaps_are_shared_bytes(spark, libraries):
    a, text_a, b, text_b = libraries
    rows = [(1, "hello wörld, 日本 xyzzy"), (2, None), (3, ""), (4, "a▁")]
    got = {r["doc_id"]: r for r in alignment.align_documents(documents(spark, rows), A, B).collect()}
    r = got[1]
    span = lambda ids, text: [(sum(len(text(i)) for i in ids[:k]), sum(len(text(i)) for i in ids[:k + 1])) for k in range(len(ids))]
    sa, sb = span(r["a"], text_a), span(r["b"], text_b)
    want = [(i, j, min(x[1], y[1]) - max(x[0], y[0])) for i, x in enumerate(sa) for j, y in enumerate(sb) if min(x[1], y[1]) > max(x[0], y[0])]
    assert [tuple(o) for o in r["overlaps"]] == want
    assert [g["a"] for g in r["groups"]][0] == 0 and len(r["groups"]) == len(brute_groups(rows[0][1], libraries))
    assert all(got[i]["a"] == [] and got[i]["groups"] == [] for i in (2, 3, 4))


def test_empty_table(spark):
    assert report(spark, []) == []
