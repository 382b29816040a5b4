import random

from vekta.operators import recall


def _nb(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, rank long")


def _truth(spark, rows):
    return spark.createDataFrame(rows, "id long, indices array<bigint>")


def py_recall(found, truth, n_queries, k, best=False):
    hits = 0
    for q, ids in found.items():
        ids = [i for r, i in sorted(ids) if r <= k]
        t = set((truth.get(q) or [])[:k])
        h = len(t & set(ids))
        if best:
            h = max(h, len(t & {i - 1 for i in ids}))
        hits += h
    return hits / n_queries / k


def test_missing_truth_and_denominator(spark):
    nb = _nb(spark, [(1, 10, 1), (1, 11, 2), (2, 20, 1)])
    tr = _truth(spark, [(1, [11, 99])])          # query 2 has no truth, query 3 found nothing
    r = recall.recall_at_k(nb, tr, n_queries=3, k=2).first()
    assert r["hits"] == 1 and r["missing_truth"] == 1 and r["queries"] == 3
    assert r["recall"] == 1 / 3 / 2


def test_offset_best_rule(spark):
    nb = _nb(spark, [(1, 5, 1), (1, 6, 2), (2, 7, 1), (2, 9, 2)])
    tr = _truth(spark, [(1, [4, 5]), (2, [7, 8])])
    plain = recall.recall_at_k(nb, tr, 2, 2).first()["hits"]
    best = recall.recall_at_k(nb, tr, 2, 2, id_offset="best").first()["hits"]
    shifted = recall.recall_at_k(nb, tr, 2, 2, id_offset=-1).first()["hits"]
    assert (plain, shifted, best) == (2, 3, 3)  # q1: 1 vs 2 -> 2 ; q2: 1 vs 1 -> 1


def test_random_against_python(spark):
    rnd = random.Random(3)
    found, truth, rows, trows = {}, {}, [], []
    for q in range(30):
        ids = rnd.sample(range(40), rnd.randint(0, 12))
        found[q] = [(r + 1, i) for r, i in enumerate(ids)]
        rows += [(q, i, r) for r, i in found[q]]
        if rnd.random() < 0.9:
            truth[q] = rnd.sample(range(40), 12)
            trows.append((q, truth[q]))
    found = {q: v for q, v in found.items() if v}
    ks = [1, 3, 5, 10]
    for best in (False, True):
        got = {r["k"]: r["recall"] for r in recall.recall_curve(
            _nb(spark, rows), _truth(spark, trows), 30, ks, id_offset="best" if best else 0).collect()}
        for k in ks:
            assert abs(got[k] - py_recall(found, truth, 30, k, best)) < 1e-12
