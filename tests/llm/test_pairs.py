"""N-gram join, one-bit search and quotation links against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import documents, edge_rows, prose
from vekta.llm import ann_codes, ngram_join, quotes


def shingles(text):
    w = [x.decode() for x in (text or "").lower().encode().split()]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    links = [0] * len(rows)
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= threshold * len(a | b):
            links[i] += 1
            links[j] += 1
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    smallest = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted(((rows[i][0], smallest[group[i]] if links[i] else rows[i][0], links[i]) for i in range(len(rows))), key=str)


def near_copy_rows():
    g = random.Random(3)
    rows, n = [], 100
    for k in range(12):
        words = prose(100 + k, 120).split()
        for _ in range(g.randint(1, 6)):
            copy = list(words)
            for _ in range(g.randint(0, 4)):
                copy[g.randrange(len(copy))] = prose(g.randrange(10**6), 1)
            rows.append((n, " ".join(copy)))
            n += 1
    shared = prose(77, 40)  # a passage that many unlike texts hold
    return rows + [(n + k, prose(500 + k, 90) + " " + shared) for k in range(30)]


@pytest.fixture(scope="module")
def joined(spark):
    rows = near_copy_rows() + edge_rows()
    docs = documents(spark, rows).withColumns({"class_id": F.lit("mine"), "t_id": F.lit(1), "rid": F.col("doc_id"), "text_key": F.lit(2)})
    return rows, docs, ngram_join.near_duplicates(docs)


def test_join_equals_brute_force(joined):
    rows, _, found = joined
    got = [(r.doc_id, r.class_id, r.n_links) for r in found.collect()]
    assert sorted(got, key=str) == brute_links(rows)


def test_one_of_each_group_stays_with_all_columns(joined):
    rows, docs, found = joined
    left = ngram_join.one_of_each(docs, found)
    assert left.columns == docs.columns
    want = sorted({(c if n else i, c) for i, c, n in brute_links(rows)}, key=str)
    assert sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == sorted(i for i, _ in want if i is not None)
    assert left.where("doc_id IS NULL").count() == 1


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    base = prose(9, 150).split()
    rows = []
    for k in range(25):
        w = list(base)
        w[(k * 5) % 150] = f"w{k}"
        rows.append((k, " ".join(w)))
    got = [(r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_links(rows)


def test_join_of_empty_table(spark):
    empty = documents(spark, [])
    found = ngram_join.near_duplicates(empty)
    assert found.count() == 0 and ngram_join.one_of_each(empty, found).count() == 0


def test_runs_follow_the_target_recall():
    assert ngram_join.runs_needed(0.8, 0.9) < ngram_join.runs_needed(0.8, 0.9999)
    g = np.random.default_rng(0)
    runs, met, n = ngram_join.runs_needed(0.8, 0.9), 0, 400
    for _ in range(n):  # a pair whose signatures agree in 0.8 of the coordinates
        sig = g.integers(0, 1 << 32, (1, ngram_join.COORDINATES)).astype(np.uint32).repeat(2, axis=0)
        sig[1, g.choice(ngram_join.COORDINATES, ngram_join.COORDINATES // 5, replace=False)] = 1
        for r in range(runs):
            paths = [g.integers(0, 1 << 63, 1).astype(np.uint64)] * 2
            live = [[int(paths[0][0])], [int(paths[0][0])]]
            for _ in range(ngram_join.DEPTH):
                live = [ngram_join.split_paths(np.array(p, np.uint64), sig[[k] * len(p)], 0.8)[1].tolist() if p else [] for k, p in enumerate(live)]
            if set(live[0]) & set(live[1]):
                met += 1
                break
    assert met / n > 0.85


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def search(df):
    dim = ann_codes.usual_length(df, "embedding")
    index = ann_codes.build_index(df, dim)
    return ann_codes.nearest(index, index.where(F.col("vec_id") % 50 == 0), dim)


def test_one_bit_search_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    v, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found: dict = {}
    for r in search(df).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        cos = unit @ unit[i]
        cos[i] = -9
        best = set(ids[np.argsort(-cos)[:5]].tolist())
        got = sorted(found[ids[i]])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert all(abs(cos[ids == g[1]][0] - g[2]) < 1e-12 for g in got)
        hits, total = hits + len(best & {g[1] for g in got}), total + 5
    assert hits / total >= 0.98


def test_one_bit_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0], 1), (50, [0.0, 2.0, 0.0], 1), (1, [2.0, 0.0, 0.0], 1), (2, [3.0, 0.0, 0.0], 1), (3, [1.0, 1.0, 0.0], 1),
            (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [nan, 1.0, 0.0], 1), (7, [inf, 1.0, 0.0], 1), (8, [None, 1.0, 0.0], 1), (9, [1.0], 1),
            (None, [1.0, 0.0, 0.0], 1), (100, None, 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in search(vectors(spark, rows)).collect())
    # copies tie: smaller ids first; four candidates in all, fewer than five
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 50), (50, 1, 3), (50, 2, 0), (50, 3, 1), (50, 4, 2)]
    assert search(vectors(spark, [])).count() == 0
    assert search(vectors(spark, [(0, None, 1)])).count() == 0


def test_search_in_chunks_equals_one_chunk(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    one = sorted(map(tuple, search(df).collect()))
    monkeypatch.setattr(ann_codes, "CHUNK_BYTES", 64 * 8 * 3)
    assert sorted(map(tuple, search(df).collect())) == one


def test_one_bit_search_extremes_repeats_and_other_columns(spark):
    rows = [(50, [1e200, 1e200], 1), (1, [1e200, 0.0], 1), (2, [0.0, 1e-300], 1), (100, [1e-200, 0.0], 1), (3, [5e-324, 0.0], 1),
            (50, [1.0, 1.0], 1), (1, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int").withColumn("f", F.lit("clash")).withColumn("vec", F.lit(1))
    got = {q: [(r.vec_id, round(r.score, 6)) for r in sorted(found, key=lambda r: r["rank"])]
           for q, found in itertools.groupby(sorted(search(df).collect(), key=lambda r: r.query_id), lambda r: r.query_id)}
    assert got[100] == [(1, 1.0), (1, 1.0), (3, 1.0), (50, 0.707107), (50, 0.707107)]
    assert sorted(got[50]) == [(1, 0.707107), (1, 0.707107), (2, 0.707107), (3, 0.707107), (100, 0.707107)]  # equal but for rounding


@pytest.mark.parametrize("dim", [1, 3, 64, 100, 130])
def test_table_estimates_equal_the_dense_product(dim):
    g = np.random.default_rng(dim)
    q, v = (ann_codes.units(g.standard_normal((n, dim))) for n in (5, 40))
    f = np.abs(v).sum(axis=1) / np.sqrt(dim)
    plain = (np.where(v > 0, 1.0, -1.0) / (f[:, None] * np.sqrt(dim))) @ q.T
    got = ann_codes.upper_bounds(ann_codes.byte_tables(q), np.packbits(v > 0, axis=1), f, dim, 0.0)
    assert np.abs(got - plain - 1e-5).max() < 1e-5


MESSAGES = "conv_id long, turn long, role string, text string"


def test_quotes_are_linked_and_taken_out(spark):
    rows = [
        (1, 0, "user", "Hello there. How are you today?"),
        (1, 1, "assistant", "> Hello there.\n> How are\n> you   TODAY?\nFine, thanks."),
        (1, 2, "user", "On Monday X wrote:\n> > Hello there.\n> Fine, thanks.\nGood."),
        (1, 3, "user", "> Nobody said this.\nReally?"),
        (2, 0, "user", "Fine, thanks."),
        (2, 1, "user", "> Hello there.\nOther conversation."),
        (3, 0, "user", None), (3, 1, "user", ""), (None, 2, "user", "> Hello there."),
        (4, 0, "user", "Yes."), (4, 1, "user", "Yes."), (4, 2, "user", "Yes."), (4, 2, "user", "> Yes.\nNo."), (4, 3, "user", "> No.\nWhy?"),
    ]
    got = {(r.conv_id, r.turn, r.text): (r.n_quotes, r.n_linked, r.reply_to, r.thread, r.depth)
           for r in quotes.link_quotes(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert len(got) == len(rows)
    assert got[(1, 1, "Fine, thanks.")] == (2, 2, 0, 0, 1)
    assert got[(1, 2, "Good.")] == (2, 2, 1, 0, 2)
    assert got[(1, 3, "Really?")] == (1, 0, None, 3, 0)
    assert got[(2, 1, "Other conversation.")] == (1, 0, None, 1, 0)
    assert got[(3, 0, None)] == (0, 0, None, 0, 0)
    assert got[(None, 2, "")] == (1, 0, None, 2, 0)
    assert got[(4, 2, "No.")] == (1, 1, 0, 0, 1)
    assert got[(4, 3, "Why?")] == (1, 1, 2, 0, 2)


def test_a_reply_goes_to_the_message_that_holds_most_of_its_quote(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "user", "A. B."), (1, 3, "user", "> A.\n> B.\nThree."),
            (2, 0, "user", "A."), (2, 1, "user", "B."), (2, 2, "user", "> A.\n> B.\nTie."), (2, 3, "user", "A. B."),
            (3, 0, "user", "Thanks."), (3, 1, "user", "Thanks. One."), (3, 2, "user", "Thanks. Two."), (3, 3, "user", "Thanks. Two."),
            (3, 4, "user", "> Thanks.\n> Two.\nFour."), (3, 5, "user", "> Thanks.\nFive.")]
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_to) for r in quotes.link_quotes(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got[(1, 3)] == (2, 2) and got[(2, 2)] == (2, 1) and got[(3, 4)] == (2, 2) and got[(3, 5)] == (1, 0)


def test_long_chain_of_replies(spark):
    rows = [(1, 0, "user", "Say 0.")] + [(1, k, "user", f"> Say {k - 1}.\nSay {k}.") for k in range(1, 40)]
    got = sorted((r.turn, r.reply_to, r.thread, r.depth) for r in quotes.link_quotes(spark.createDataFrame(rows, MESSAGES)).collect())
    assert got[1:] == [(k, k - 1, 0, k) for k in range(1, 40)]
    assert quotes.link_quotes(spark.createDataFrame([], MESSAGES)).count() == 0


def test_parts_of_messages_are_linked(spark):
    long = "The first half of this sentence is followed by a second half that goes on, and on."
    rows = [(1, 0, "user", "alpha\nbeta\ngamma"), (1, 1, "user", "> beta\nWhat is it?"),
            (2, 0, "user", long), (2, 1, "user", "> followed by a second half\n> that goes\nHow far?"), (2, 2, "user", "> HOW far?\n>> the first half of this\nFar."),
            (3, 0, "user", "第一句。第二句。第三句！"), (3, 1, "user", "> 第二句。\n好。"), (3, 2, "user", "> 好\n?"),
            (4, 0, "user", "one two three\nfour five\nsix"), (4, 1, "user", "> one two three\n> six\nBoth."), (4, 2, "user", "> four\nNo line, too short."),
            (5, 0, "user", "a"), (5, 1, "user", "> not said\n> at all\nWhy?\n> a\nYes")]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, MESSAGES).selectExpr("*", "1 AS uid", "2 AS H", "3 AS words", "4 AS own")).collect()}
    reply = {k: (r.n_linked, r.reply_to) for k, r in got.items()}
    assert reply[(1, 1)] == (1, 0) and reply[(2, 1)] == (1, 0) and reply[(2, 2)] == (2, 1)
    assert reply[(3, 1)] == (1, 0) and reply[(3, 2)] == (0, None)
    assert reply[(4, 1)] == (1, 0) and reply[(4, 2)] == (0, None)
    assert (got[(5, 1)].text, got[(5, 1)].text_unlinked, got[(5, 1)].n_linked) == ("Why?\nYes", "> not said\n> at all\nWhy?\nYes", 1)


def threads(seed, conversations=25):
    """Messages that quote parts of earlier ones, with the reply that each quote was taken from."""
    g = random.Random(seed)
    rows, truth = [], {}
    for c in range(conversations):
        said, depth, thread = [], [], []
        for turn in range(g.randint(2, 12)):
            own = [prose(seed * 10_000 + c * 100 + turn * 5 + k, g.randint(4, 14)) + "." for k in range(g.randint(1, 4))]
            if turn and g.random() < 0.8:
                up = g.randrange(turn)
                kind = g.choice(["sentence", "half", "wrapped", "all"])
                pick = g.choice(said[up])
                words = pick.split()
                quote = {"sentence": [pick.upper()], "half": [" ".join(words[1:])] if len(words) > 4 else [pick], "wrapped": [" ".join(words[:2]), " ".join(words[2:])],
                         "all": said[up]}[kind]
                text = "\n".join([f"> {q}" for q in quote] + own)
                truth[(c, turn)] = (up, thread[up], depth[up] + 1)
            else:
                up, text = None, "\n".join(own)
                truth[(c, turn)] = (None, turn, 0)
            said.append(own)
            depth.append(truth[(c, turn)][2])
            thread.append(truth[(c, turn)][1])
            rows.append((c, turn, "user", text))
    return rows, truth


def test_generated_threads_are_found_again(spark):
    rows, truth = threads(1)
    g = random.Random(2)
    g.shuffle(rows)
    got = quotes.link_quotes(spark.createDataFrame(rows, MESSAGES)).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth) for r in got} == truth
    place = {(r.conv_id, r.turn): r.position for r in got}
    for c in {r.conv_id for r in got}:
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: (r.thread, r.depth, r.turn))
        assert [place[(c, r.turn)] for r in own] == list(range(len(own)))
        assert all(r.reply_to is None or place[(c, r.reply_to)] < r.position for r in own)


def test_null_turns_and_long_messages(spark):
    rows = [(1, None, "user", "Said without a turn."), (1, 0, "user", "> Said without a turn.\nA."), (1, None, "user", "> A.\nB."),
            (2, 0, "user", prose(1, 30_000)), (2, 1, "user", "> " + " ".join(prose(1, 30_000).split()[20_000:20_050]) + "\nYes.")]
    got = {(r.conv_id, r.turn, r.text): (r.n_linked, r.reply_to) for r in quotes.link_quotes(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got[(1, 0, "A.")] == (0, None) and got[(1, None, "B.")] == (0, None) and got[(2, 1, "Yes.")] == (1, 0)
