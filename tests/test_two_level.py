"""Two levels of cells."""

import numpy as np
from pyspark.sql import functions as F

from vekta.operators import ingest, ivf, knn, recall, two_level
from vekta.session import scratch_path
from vekta.sources import catalog
from vekta.sources import fixtures as fx


def vectors(spark, n, dim, seed=1, hot=0.4):
    """A third and more of the rows around one point."""
    g = np.random.default_rng(seed)
    m = g.normal(size=(n, dim))
    m[: int(hot * n)] = m[0] + 0.05 * g.normal(size=(int(hot * n), dim))
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, v array<double>"), m


def test_every_row_is_in_the_nearest_list_of_its_coarse_cell(spark):
    b, m = vectors(spark, 3000, 8)
    idx = two_level.ivf_build_two_level(b, lists=300)
    assert 250 <= idx.lists <= 350 and idx.centroids.select("cell").distinct().count() == idx.lists
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    co, ce = (sorted(df.collect(), key=lambda r: r.cell) for df in (idx.coarse, idx.centroids))
    up = (unit(m) @ unit(np.array([r.v for r in co])).T).argmax(axis=1)
    fine, owner = unit(np.array([r.v for r in ce])), np.array([r.coarse for r in ce])
    cell = {r.id: r.cell for r in idx.cells.collect()}
    assert len(cell) == 3000
    score = unit(m) @ fine.T
    score[up[:, None] != owner[None, :]] = -9
    assert all(score[i, cell[i]] > score[i].max() - 1e-9 for i in range(3000))
    # the hot cell was fitted in several groups, and no list holds a third of the rows
    assert np.bincount(owner).max() <= idx.lists and max(np.bincount(list(cell.values()))) < 300


def test_lists_beyond_the_broadcast_limit(spark):
    """2,500 lists where the limit takes 100 vectors: the coarse cells fit, the centroids do not."""
    b, _ = vectors(spark, 10_000, 8, seed=2)
    q = b.where("id % 97 = 0")
    spark.conf.set("vekta.broadcast.maxBytes", str(8 * 8 * 105))
    spark.conf.set("vekta.block.maxBytes", str(8 * 8 * 1500))
    try:
        idx = two_level.ivf_build_two_level(b, lists=2500, rows_per_list=4)
        path = scratch_path(spark, "two-level-test")
        catalog.write_index(idx, path)
        idx = catalog.read_ivf_index(spark, path)
        assert idx.lists > 2000 and idx.cells.where("cell IS NULL").count() == 0
        found = ivf.ivf_search(idx, q, 5, probes=200)
        r = recall.recall_at_k(found, knn.build_truth(q, b, 5), q.count(), 5).first()["recall"]
        more = ingest.ingest_append(idx, spark.createDataFrame([(90_000, [1.0] * 8), (90_001, None)], "id long, v array<double>"))
        assert more.cells.where("id = 90000 AND cell IS NOT NULL").count() == 1 and more.cells.where("id = 90001 AND cell IS NULL").count() == 1
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
        spark.conf.unset("vekta.block.maxBytes")
    assert r > 0.8


def test_edges(spark):
    rows = [(i, [float(i % 4) + 1, 1.0]) for i in range(12)] + [(50, None), (51, [1.0]), (52, [0.0, 0.0])]
    b = spark.createDataFrame(rows, "id long, v array<double>")
    idx = two_level.ivf_build_two_level(b, lists=100, dim=2)
    assert idx.cells.count() == 15 and idx.cells.where("cell IS NULL").count() == 2
    got = ivf.ivf_search(idx, b.where("id < 12"), 3, probes=idx.lists)
    want = knn.knn_join(b.where("id < 12"), b, 3)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.distance, 12)) for r in df.collect())
    assert key(got) == key(want)
    assert idx.centroids.where(F.exists("v", lambda x: F.isnan(x))).count() == 0


def test_a_search_of_all_lists_ranks_no_cells(spark, sf, monkeypatch):
    b = fx.base_vectors(spark, sf)
    idx = two_level.ivf_build_two_level(b, lists=12)
    want = sorted(map(str, knn.knn_join(b, b, 5).collect()))
    monkeypatch.setattr(two_level, "probe_two_level", None)
    spark.conf.set("vekta.broadcast.maxBytes", str(64 * 8 * 30))
    try:
        assert sorted(map(str, ivf.ivf_search(idx, b, 5, probes=idx.lists).collect())) == want
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
