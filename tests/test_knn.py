import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vekta.operators import knn as K
from vekta.operators import kernel
from vekta.sources import fixtures as fx


def brute(q, b, qids, bids, k):
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    bn = b / np.linalg.norm(b, axis=1, keepdims=True)
    d = 1.0 - qn @ bn.T
    out = {}
    for i, qi in enumerate(qids):
        order = np.lexsort((bids, d[i]))[:k]
        out[int(qi)] = [(int(bids[j]), float(d[i, j])) for j in order]
    return out


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    return out


def random_df(spark, n, dim, seed, start=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(start + i, m[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<float>"), m.astype(np.float64)


@pytest.mark.parametrize("k", [1, 7, 25])
def test_knn_join_matches_numpy(spark, k):
    b, bm = random_df(spark, 300, 16, 1)
    q, qm = random_df(spark, 40, 16, 2, start=1000)
    got = as_dict(K.knn_join(q, b, k))
    exp = brute(qm, bm, np.arange(1000, 1040), np.arange(300), k)
    assert got.keys() == exp.keys()
    for qi in exp:
        assert [i for i, _ in got[qi]] == [i for i, _ in exp[qi]]
        assert np.allclose([d for _, d in got[qi]], [d for _, d in exp[qi]], atol=1e-9)


def test_grid_path_equals_broadcast_path(spark):
    b, _ = random_df(spark, 200, 8, 3)
    q, _ = random_df(spark, 30, 8, 4, start=500)
    bc = as_dict(K.knn_join(q, b, 5))
    spark.conf.set("vekta.broadcast.maxBytes", "512")
    spark.conf.set("vekta.block.maxBytes", "2048")
    try:
        plan = K.exact_candidates(K._prep(q, "id", "v", "query_id"), K._prep(b, "id", "v"), 5, 8)
        assert "FlatMapCoGroupsInArrow" in plan._jdf.queryExecution().executedPlan().toString()
        grid = as_dict(K.knn_join(q, b, 5))
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
        spark.conf.unset("vekta.block.maxBytes")
    assert grid == bc


def test_grid_deals_one_group_to_a_task_and_copies_in_many(spark):
    b = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 11), float(i)]) for i in range(400)], "id long, v array<double>").coalesce(1)
    q = K._prep(b, "id", "v", "query_id")
    spark.conf.set("vekta.broadcast.maxBytes", "512")
    spark.conf.set("vekta.block.maxBytes", "4096")
    try:
        from vekta.plans import sizing
        qb, bb = sizing.grid_shape(spark, 400, 400, 4, 3)
        found = K.exact_candidates(q, b, 3, 4)
        group = F.struct(F.pmod(F.xxhash64("query_id"), F.lit(qb)), F.pmod(F.xxhash64("id"), F.lit(bb)))
        tasks = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct(group).alias("groups")).collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
        spark.conf.unset("vekta.block.maxBytes")
    assert qb * bb > 20 and len(tasks) == qb * bb and {r["groups"] for r in tasks} == {1}
    assert plan.count("RoundRobinPartitioning") == 2       # the scan has one task; neither side is copied there


def test_ties_broken_by_id_and_duplicates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(10)] + [(10, [0.0, 1.0])]
    b = spark.createDataFrame(rows, "id long, v array<float>")
    q = spark.createDataFrame([(99, [1.0, 0.0])], "id long, v array<float>")
    got = K.knn_join(q, b, 4).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3]
    assert [r["rank"] for r in got] == [1, 2, 3, 4]


def test_edge_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0, 5.0]), (4, [0.5, 0.5])]
    b = spark.createDataFrame(rows, "id long, v array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.1]), (8, None), (9, [0.0, 0.0])], "id long, v array<float>")
    got = K.knn_join(q, b, 10).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    # NULL / wrong-length vectors are not candidates; the zero vector ranks last as NaN
    assert [r["id"] for r in by[7]] == [0, 4, 1]
    assert np.isnan(by[7][-1]["distance"])
    assert 8 not in by                      # NULL query: no rows
    assert [r["id"] for r in by[9]] == [0, 1, 4]  # zero query: all NaN, id order
    assert K.knn_join(q, b, 0).count() == 0


def test_k_larger_than_base_and_empty_base(spark):
    b = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, v array<float>")
    q = spark.createDataFrame([(5, [1.0, 1.0])], "id long, v array<float>")
    assert K.knn_join(q, b, 10).count() == 2
    empty = spark.createDataFrame([], "id long, v array<float>")
    assert K.knn_join(q, empty, 3).count() == 0


def test_single_query_unknown_id_gives_no_rows(spark, sf):
    b = fx.base_vectors(spark, sf)
    assert K.knn(b, b.where(F.col("id") == -5), 5).count() == 0
    one = K.knn(b, b.where(F.col("id") == 3), 5).collect()
    assert len(one) == 5 and one[0]["v"] is not None


def test_plan_has_window_group_limit_and_no_cartesian(spark, sf):
    b = fx.base_vectors(spark, sf)
    plan = K.knn_join(b, b, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2          # partial before and final after the exchange
    assert "MapInArrow" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_positions_are_dense(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "x").repartition(5)
    pos = K.with_positions(df, "x").orderBy("x").collect()
    assert [r["pos"] for r in pos] == list(range(len(pos)))


def test_topk_merge_tie_resolution():
    t = kernel.TopK(1, 2)
    t.merge(slice(None), np.array([[0.5, 0.5, 0.5]]), np.array([9, 3, 5]))
    assert t.ids[0].tolist() == [3, 5]
    t.merge(slice(None), np.array([[0.5]]), np.array([1]))
    assert t.ids[0].tolist() == [1, 3]


def test_tree_merge_equals_flat(spark, monkeypatch):
    b, _ = random_df(spark, 400, 8, 11)
    q, _ = random_df(spark, 20, 8, 12, start=900)
    flat = as_dict(K.knn_join(q, b.repartition(40), 6))
    monkeypatch.setattr(K, "TREE_MERGE_PARTITIONS", 4)
    tree = as_dict(K.knn_join(q, b.repartition(40), 6))
    assert tree == flat


def test_point_workload_draws_existing_ids(spark, sf):
    b = fx.base_vectors(spark, sf)
    w = K.point_workload(b, b, 3, t=50, seed=7)
    rows = w.collect()
    ids = {r["id"] for r in b.select("id").collect()}
    assert len({r["txn"] for r in rows}) == 50
    assert all(r["query_id"] in ids for r in rows)
    assert all(r["rank"] <= 3 for r in rows)
    again = sorted((r["txn"], r["query_id"]) for r in K.point_workload(b, b, 3, t=50, seed=7).collect())
    assert again == sorted((r["txn"], r["query_id"]) for r in rows)


def test_single_precision_kernel_is_close(spark):
    b, bm = random_df(spark, 300, 16, 21)
    q, qm = random_df(spark, 20, 16, 22, start=700)
    exp = brute(qm, bm, np.arange(700, 720), np.arange(300), 5)
    spark.conf.set("vekta.kernel.precision", "single")
    try:
        got = as_dict(K.knn_join(q, b, 5))
    finally:
        spark.conf.unset("vekta.kernel.precision")
    for qi in exp:
        assert np.allclose([d for _, d in got[qi]], [d for _, d in exp[qi]], atol=1e-5)


@pytest.mark.parametrize("dtype", [np.float64, np.float32])
def test_distances_do_not_depend_on_block_shapes(monkeypatch, dtype):
    g = np.random.default_rng(3)
    for dim in (1, 7, 64, 100):
        b, q = g.normal(size=(700, dim)).astype(dtype), g.normal(size=(40, dim)).astype(dtype)
        b[::50] = b[0]
        b[3], q[5] = 0, 0
        ids = g.permutation(700).astype(np.int64)
        want = None
        for cells, chunk in ((4_000_000, 700), (500, 1), (90, 33), (10_000, 400)):
            monkeypatch.setattr(kernel, "BLOCK_CELLS", cells)
            batches = [pa.RecordBatch.from_arrays([pa.array(ids[s:s + chunk]), pa.array(b[s:s + chunk].astype(np.float32).tolist(), pa.list_(pa.float32()))], ["id", "v"])
                       for s in range(0, 700, chunk)]
            qn, ok = kernel.normalise(q)
            got = next(kernel.exact_topk_partition(iter(batches), np.arange(40), qn, ok, 9, dim, "id", "v", dtype))
            rows = sorted(map(str, zip(*(c.to_pylist() for c in got.columns))))
            assert want is None or rows == want
            want = rows


@pytest.mark.parametrize("search", ["exact", "cells"])
def test_a_common_vector_does_not_make_a_pair_of_each_of_its_rows(search, monkeypatch):
    rng = np.random.default_rng(4)
    b, q = rng.normal(size=(3000, 8)), rng.normal(size=(900, 8))
    b[rng.random(len(b)) < 0.5] = b[0]
    q[rng.random(len(q)) < 0.5] = b[0]
    b[7] = 0.0
    bids, qids, cell = rng.permutation(len(b)), np.arange(len(q)), rng.integers(0, 3, len(b))
    as_list = pa.list_(pa.float64())
    base = pa.table({"id": pa.array(bids), "v": pa.array(b.tolist(), as_list), "cell": pa.array(cell, pa.int32())})
    query = pa.table({"query_id": pa.array(qids), "v": pa.array(q.tolist(), as_list), "cells": pa.array([[0, 2]] * len(q), pa.list_(pa.int32()))})
    pairs = []
    monkeypatch.setattr(kernel, "_pair_distances", lambda *a, f=kernel._pair_distances: pairs.append(len(a[2])) or f(*a))
    if search == "exact":
        met = b[:, 0] != 0
        got = kernel.block_pair_topk(query, base, 5, 8, "query_id", "v", "id", "v")
    else:
        met = (b[:, 0] != 0) & (cell != 1)
        got = kernel.cells_topk(query, base, 5, 8, ["query_id"])
    assert sum(pairs) < 100 * len(q)       # 450 queries x 1,000 rows or more before
    rows = {}
    for r in got.to_pylist():
        rows.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
    b[7] = 1.0
    bn, qn = b / np.linalg.norm(b, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    for i, found in rows.items():
        d = np.round(1.0 - bn[met] @ qn[i], 9)
        want = bids[met][np.lexsort((bids[met], d))[:5]].tolist()
        assert [r for _, r in sorted((round(d, 9), r) for d, r in found)] == want
    assert len(rows) == len(q)


def test_copies_are_left_out_only_after_k_of_the_same_vector_and_cell():
    v = np.array([[1.0, 2.0], [1.0, 2.0], [2.0, 1.0], [1.0, 2.0], [1.0, 2.0], [np.nan, 1.0], [0.0, 1.0], [-0.0, 1.0]], dtype=np.float32)
    ids = np.array([9, 3, 1, 3, 5, 0, 2, 2])
    assert kernel.without_copies(v, ids, 2).tolist() == [1, 2, 3, 5, 6, 7]
    assert kernel.without_copies(v, ids, 3).tolist() == [1, 2, 3, 4, 5, 6, 7]
    assert kernel.without_copies(v, ids, 2, np.array([0, 1, 0, 0, 0, 0, 0, 0])).tolist() == [1, 2, 3, 4, 5, 6, 7]
    assert kernel.without_copies(v, ids, 1, np.array([0, 1, 0, 0, 0, 0, 0, 0])).tolist() == [1, 2, 3, 5, 6, 7]
    assert kernel.without_copies(v[:0], ids[:0], 2).tolist() == []
