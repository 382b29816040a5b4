import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vekta.operators import ivf, knn, recall
from vekta.operators import kernel as K
from vekta.sources import fixtures as fx


def _ids(df):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())


def test_all_probes_equals_exact(spark, sf):
    b = fx.base_vectors(spark, sf, with_label=True)
    idx = ivf.ivf_from_labels(b, "label")
    exact = knn.knn_join(b, b, 5)
    full = ivf.ivf_search(idx, b, 5, probes=10)
    assert _ids(full) == _ids(exact)


def test_kmeans_full_probe_recall_is_one_and_monotone(spark, sf):
    b = fx.base_vectors(spark, sf)
    idx = ivf.ivf_build(b, lists=8, seed=7, max_iter=5)
    assert idx.cells.select("cell").distinct().count() <= 8
    truth = knn.build_truth(b, b, 10)
    n = b.count()
    rs = []
    for p in (1, 2, 4, 8):
        found = ivf.ivf_search(idx, b, 10, probes=p)
        rs.append(recall.recall_at_k(found, truth, n, 10).first()["recall"])
    assert rs == sorted(rs)
    assert abs(rs[-1] - 1.0) < 1e-12


def test_grid_path_matches_broadcast(spark, sf):
    b = fx.base_vectors(spark, sf, with_label=True)
    idx = ivf.ivf_from_labels(b, "label")
    want = _ids(ivf.ivf_search(idx, b, 5, probes=2))
    spark.conf.set("vekta.broadcast.maxBytes", str(64 * 8 * 50))
    spark.conf.set("vekta.block.maxBytes", str(64 * 8 * 10))
    try:
        cands = ivf.ivf_candidates(idx, knn._prep(b, "id", "v", "query_id"), 5, 2)
        assert "FlatMapCoGroupsInArrow" in cands._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
        spark.conf.unset("vekta.block.maxBytes")
    spark.conf.set("vekta.broadcast.maxBytes", str(64 * 8 * 50))
    spark.conf.set("vekta.block.maxBytes", str(64 * 8 * 10))
    try:
        got = _ids(ivf.ivf_search(idx, b, 5, probes=2))
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
        spark.conf.unset("vekta.block.maxBytes")
    assert got == want


def test_hot_cell_is_split(spark):
    # one cell holds most rows: the salted grid must still give exact results
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 4))
    rows = [(i, m[i].tolist(), 0 if i < 200 else 1 + i % 3) for i in range(300)]
    b = spark.createDataFrame(rows, "id long, v array<double>, label int")
    idx = ivf.ivf_from_labels(b, "label")
    want = _ids(ivf.ivf_search(idx, b, 3, probes=4))
    spark.conf.set("vekta.broadcast.maxBytes", "256")
    spark.conf.set("vekta.block.maxBytes", str(4 * 8 * 16))
    try:
        got = _ids(ivf.ivf_search(idx, b, 3, probes=4))
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
        spark.conf.unset("vekta.block.maxBytes")
    assert got == want == _ids(knn.knn_join(b, b, 3))


def test_cell_blocks_deal_one_group_to_a_task_and_copies_in_many(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), 0 if i % 3 == 0 else i % 20) for i in range(600)]
    b = spark.createDataFrame(rows, "id long, v array<double>, label int").coalesce(1)
    idx = ivf.ivf_from_labels(b, "label")
    q = knn._prep(b, "id", "v", "query_id")
    want = sorted(map(str, knn.rank_candidates(ivf.ivf_candidates(idx, q, 3, 2), 3).collect()))
    spark.conf.set("vekta.broadcast.maxBytes", str(4 * 8 * 30))
    spark.conf.set("vekta.block.maxBytes", "4096")
    try:
        from vekta.plans import sizing
        qb, parts = sizing.grid_shape(spark, 600, 600, 4, 3)
        found = ivf.ivf_candidates(idx, q, 3, 2)
        # a group is of one part and one query block; the salts of a hot part are groups of their own
        sides = F.struct(F.pmod(F.xxhash64("query_id"), F.lit(qb)), F.pmod(F.col("label"), F.lit(parts)))
        at = found.withColumn("task", F.spark_partition_id()).join(b.select("id", "label"), "id")
        tasks = at.groupBy("task").agg(F.count_distinct(sides).alias("groups")).collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, knn.rank_candidates(found, 3).collect()))
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
        spark.conf.unset("vekta.block.maxBytes")
    assert got == want
    assert qb > 1 and parts > 1 and len(tasks) >= qb * parts and {r["groups"] for r in tasks} == {1}
    assert plan.count("RoundRobinPartitioning") == 2       # the scan has one task; neither side is copied there


def test_probe_filter_pushed_to_scan(spark, sf, tmp_path):
    b = fx.base_vectors(spark, sf, with_label=True)
    idx = ivf.ivf_from_labels(b, "label")
    q = knn._prep(b.where(F.col("id") < 3), "id", "v", "query_id")
    plan = ivf.ivf_candidates(idx, q, 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(label" in plan or "label IN" in plan


def test_effort_counts(spark, sf):
    b = fx.base_vectors(spark, sf, with_label=True)
    idx = ivf.ivf_from_labels(b, "label")
    n = b.count()
    eff = ivf.search_effort(None, b, base=b).agg(F.min("examined"), F.max("examined")).first()
    assert eff[0] == eff[1] == n
    full = ivf.search_effort(idx, b, probes=10).agg(F.min("examined")).first()[0]
    assert full == n


def test_with_cells_is_a_map_and_matches_assign(spark, sf):
    b = fx.base_vectors(spark, sf, with_label=True)
    idx = ivf.ivf_from_labels(b, "label")
    wc = ivf.with_cells(b.select("id", "v"), idx.centroids, idx.dim)
    plan = wc._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan   # scan -> map, nothing else
    a = {r["id"]: r["cell"] for r in ivf.assign_cells(b, idx.centroids, idx.dim).collect()}
    assert {r["id"]: r["cell"] for r in wc.collect()} == a


def test_ingest_append_equals_fresh_assignment(spark, sf):
    from vekta.operators import ingest
    b = fx.base_vectors(spark, sf, with_label=True)
    plan = ingest.plan_ingest(b)
    seed = ingest.ingest_seed_labels(b, plan)
    full = ingest.ingest_append(seed, ingest.appended_rows(b, plan))
    fresh = ivf.assign_cells(b.where(F.col("id") >= plan.start), seed.centroids, seed.dim)
    got = {r["id"]: r["cell"] for r in full.cells.where(F.col("id") >= plan.start).collect()}
    assert got == {r["id"]: r["cell"] for r in fresh.collect()}
    wc = {r["window"]: r["rows"] for r in ingest.window_counts(ingest.appended_rows(b, plan), plan).collect()}
    assert sum(wc.values()) == b.count() - plan.start


def test_centroid_table_above_broadcast_limit(spark, sf):
    b = fx.base_vectors(spark, sf, with_label=True)
    idx = ivf.ivf_from_labels(b, "label")
    want_assign = {r["id"]: r["cell"] for r in ivf.assign_cells(b, idx.centroids, idx.dim).collect()}
    want_search = _ids(ivf.ivf_search(idx, b, 5, probes=2))
    spark.conf.set("vekta.broadcast.maxBytes", str(64 * 8 * 5))   # < 10 centroids
    try:
        got_assign = {r["id"]: r["cell"] for r in ivf.assign_cells(b, idx.centroids, idx.dim).collect()}
        got_cells = {r["id"]: r["cell"] for r in
                     ivf.with_cells(b.select("id", "v"), idx.centroids, idx.dim).collect()}
        got_search = _ids(ivf.ivf_search(idx, b, 5, probes=2))
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
    assert got_assign == want_assign == got_cells
    assert got_search == want_search


def test_sweep_fallback_equals_probe_pass(spark, sf):
    from vekta.operators import sweep
    b = fx.base_vectors(spark, sf).where("id < 200")
    grid = spark.createDataFrame([("ivf", 4, p, None, None, None, "x") for p in (1, 2, 4)], sweep.GRID_DDL)
    truth = knn.build_truth(b, b, 5)
    want = sorted((r["probes"], r["hits"]) for r in sweep.sweep_ivf(b, b, truth, grid, k=5).collect())
    spark.conf.set("vekta.broadcast.maxBytes", str(64 * 8 * 50))
    try:
        got = sorted((r["probes"], r["hits"]) for r in sweep.sweep_ivf(b, b, truth, grid, k=5).collect())
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
    assert got == want
    assert [h for _, h in want] == sorted(h for _, h in want)


def test_a_query_is_sent_once_to_a_part_not_once_to_a_cell(spark, sf):
    b = fx.base_vectors(spark, sf)
    idx = ivf.ivf_build(b, lists=20, seed=1)
    q = knn._prep(b, "id", "v", "query_id")
    some = ivf.asked_cells(idx, q, 15, 3)
    assert some.count() <= 3 * b.count() and some.select(F.sum(F.size("cells"))).first()[0] == 15 * b.count()
    every = ivf.asked_cells(idx, q, 20, 3)
    assert every.count() == 3 * b.count() and every.where("cells is not null").isEmpty()


def test_blocks_are_bounded_and_all_cores_have_some(spark):
    from vekta.plans import sizing
    for n, kept in ((100, 10), (20_000, 10), (700_000, 10), (700_000, 80), (50_000_000, 10)):
        qb, bb = sizing.grid_shape(spark, n, n, 64, kept)
        assert n / bb * 64 * 8 <= sizing.block_limit(spark) and n / qb * (64 * 8 + 16 * kept) <= sizing.block_limit(spark)
        assert qb * bb >= min(spark.sparkContext.defaultParallelism, n // 4096)


def test_zero_vectors_copies_and_repeated_ids_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(60 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(30)]
    rows += [(90 + i, [0.0] * 4) for i in range(5)] + [(95, None), (96, [1.0])]
    b = spark.createDataFrame(rows, "id long, v array<double>")
    idx = ivf.ivf_build(b, lists=6, seed=3)
    q = knn._prep(b, "id", "v", "query_id")
    assert b.count() == 97

    def got():
        return [sorted(map(str, knn.rank_candidates(ivf.ivf_candidates(idx, q, k, p), k).collect())) for k, p in ((4, 2), (94, 6), (4, 6))]
    want = got()
    spark.conf.set("vekta.broadcast.maxBytes", "512")
    spark.conf.set("vekta.block.maxBytes", "1024")
    try:
        assert got() == want
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
        spark.conf.unset("vekta.block.maxBytes")


def test_sweep_above_the_limit_searches_once_a_build(spark, sf, monkeypatch):
    from vekta.operators import sweep
    b = fx.base_vectors(spark, sf).where("id < 100")
    grid = spark.createDataFrame([("ivf", 4, p, None, None, None, "x") for p in (1, 2, 4)], sweep.GRID_DDL)
    calls = []
    monkeypatch.setattr(sweep, "block_candidates", lambda *a, f=sweep.block_candidates, **kw: calls.append(1) or f(*a, **kw))
    spark.conf.set("vekta.broadcast.maxBytes", str(64 * 8 * 20))
    try:
        sweep.sweep_ivf(b, b, knn.build_truth(b, b, 5), grid, k=5).collect()
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
    assert calls == [1]


@pytest.mark.parametrize("limit", [None, 256])
def test_a_sweep_sends_a_query_once_to_a_part_not_once_a_step(spark, sf, limit):
    b = fx.base_vectors(spark, sf).where("id < 200")
    idx = ivf.ivf_build(b, lists=20, seed=1)
    q = knn._prep(b, "id", "v", "query_id")
    if limit:
        spark.conf.set("vekta.broadcast.maxBytes", str(limit))
    try:
        asked = ivf.asked_cells(idx, q, 8, 3, [1, 2, 4, 8])
        assert asked.count() <= 3 * b.count()
        each = asked.select("query_id", F.explode(F.arrays_zip("cells", "levels")).alias("c")).groupBy("c.levels").count()
        assert {r["levels"]: r["count"] for r in each.collect()} == {1: 200, 2: 200, 4: 400, 8: 800}
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")


def test_steps_leave_out_what_lower_steps_beat():
    rng = np.random.default_rng(2)
    vectors, cell = rng.normal(size=(400, 4)), rng.integers(0, 12, 400)
    as_list = pa.list_(pa.float64())
    base = pa.table({"id": pa.array(np.arange(400)), "v": pa.array(vectors.tolist(), as_list), "cell": pa.array(cell, pa.int32())})
    asked, levels = [[0, 1, 2, 3, 4, 5], [6, 7, 8]], [[1, 2, 4, 4, 8, 8], [4, 1, 2]]
    query = pa.table({"query_id": pa.array([7, 9]), "v": pa.array(vectors[:2].tolist(), as_list),
                      "cells": pa.array(asked, pa.list_(pa.int32())), "levels": pa.array(levels, pa.list_(pa.int32()))})
    got = K.cells_topk(query, base, 3, 4, ["query_id"]).to_pylist()
    for i, qid in enumerate((7, 9)):
        for most in (1, 2, 4, 8):
            cells = [c for c, lv in zip(asked[i], levels[i]) if lv <= most]
            want = [r["id"] for r in sorted(K.cells_topk(query.slice(i, 1).drop_columns(["cells", "levels"]).append_column(
                "cells", pa.array([cells], pa.list_(pa.int32()))), base, 3, 4, ["query_id"]).to_pylist(), key=lambda r: (r["distance"], r["id"]))]
            mine = sorted((r for r in got if r["query_id"] == qid and r["level"] <= most), key=lambda r: (r["distance"], r["id"]))
            assert [r["id"] for r in mine[:3]] == want
    assert len(got) < 3 * 7
