import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vekta.session import scratch_path
from vekta.sources import catalog, fixtures as fx, vectors as vs


def _write_lines(lines):
    d = tempfile.mkdtemp(prefix="vekta-csv-", dir="/tmp")
    p = os.path.join(d, "base.csv")
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    return p


def test_csv_round_trip_from_embeddings(spark, sf):
    e = fx.table(spark, sf, "embeddings").orderBy("vec_id").collect()
    lines = ['"{' + ",".join(repr(float(x)) for x in r["embedding"]) + '}"' for r in e]
    p = _write_lines(lines)
    got = vs.load_vectors(spark, p).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, len(e) + 1))
    for a, b in zip(got, e):
        assert np.allclose(a["v"], b["embedding"])


def test_truth_load_and_bad_tokens(spark):
    p = _write_lines(['"{3,1,2}"', '"{5,NULL,7}"', '"[9]"'])
    t = vs.load_truth(spark, p).orderBy("id").collect()
    assert [r["indices"] for r in t] == [[3, 1, 2], [5, None, 7], [9]]


def test_validate_modes(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    good, bad = vs.validate_vectors(df, 2)
    assert sorted(r["id"] for r in good.collect()) == [1, 4]
    assert {r["id"]: r["problem"] for r in bad.collect()} == {
        2: "null vector", 3: "wrong dimension", 5: "null element"}
    with pytest.raises(Exception):
        vs.validate_vectors(df, 2, mode="raise").collect()
    assert vs.validate_vectors(df.where("id = 1"), 2, mode="raise").count() == 1


def test_ensure_table_is_idempotent(spark):
    path = scratch_path(spark, "ensure")
    a = spark.createDataFrame([(1, [1.0])], "id long, v array<float>")
    b = spark.createDataFrame([(2, [2.0]), (3, [3.0])], "id long, v array<float>")
    assert vs.ensure_table(a, path).count() == 1
    assert vs.ensure_table(b, path).count() == 1   # has rows: not reloaded


def test_versioned_results_store(spark):
    from vekta.operators import results as R
    store = catalog.ResultsStore(scratch_path(spark, "results"))
    b1 = spark.createDataFrame([("recall", "ivf", '{"lists":2}', "d", 10, 5, 0.5)],
                               "metric_type string, extension string, index_params string, dataset string, n long, k long, metric_value double")
    store.upsert(b1)
    first = store.read(spark).collect()[0]
    b2 = b1.withColumn("metric_value", F.lit(0.9))
    b3 = b1.withColumn("k", F.lit(10).cast("long"))
    store.upsert(b2.unionByName(b3))
    rows = {r["k"]: r for r in store.read(spark).collect()}
    assert rows[5]["metric_value"] == 0.9 and rows[5]["id"] == first["id"]
    assert rows[5]["created_at"] == first["created_at"]
    assert rows[10]["id"] == first["id"] + 1
    assert len(catalog.versions(spark, store.path)) == 2
    assert catalog.prune_versions(spark, store.path, keep=1) == 1
    assert catalog.drop_table(spark, store.path)
    assert store.read(spark).count() == 0


def test_index_write_read_drop(spark, sf):
    from vekta.operators import ivf
    b = fx.base_vectors(spark, sf, with_label=True)
    idx = ivf.ivf_from_labels(b, "label", layout=True)
    path = scratch_path(spark, "index")
    catalog.write_index(idx, path)
    back = catalog.read_ivf_index(spark, path, idx.dim)
    assert back.cells.count() == b.count()
    assert back.centroids.count() == 10
    assert catalog.drop_index(spark, path) and not catalog.table_exists(spark, path)


def test_index_stats_and_disk_bytes(spark, sf):
    from vekta.operators import graph, ivf, metrics
    b = fx.base_vectors(spark, sf, with_label=True)
    idx = ivf.ivf_from_labels(b, "label", layout=True)
    path = scratch_path(spark, "stats")
    catalog.write_index(idx, path)
    cells = catalog.read_version(spark, path, "cells")
    s = metrics.index_stats(cells, idx.centroids).first()
    assert s["rows"] == b.count() and s["cells"] == 10 and s["payload_bytes"] == b.count() * (64 * 4 + 8)
    assert metrics.files_bytes(cells).first()["disk_bytes"] > 0
    g = graph.graph_build(b.where("id < 120"), m=4, ef_construction=8, max_iter=1)
    gs = metrics.index_stats(g.vectors, edges=g.edges.where("kind = 'out'")).first()
    assert gs["edges"] == 120 * 4
