"""Positional ids, probe ranks, id windows and safety rules on sizes where partitions matter."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vekta.operators import graph, ingest, ivf, kernel, knn, recall, results
from vekta.plans.sizing import vector_dim
from vekta.session import scratch_path
from vekta.sources import catalog, vectors

N, DIM = 300_000, 64


@pytest.fixture(scope="module")
def lines(spark):
    """N lines of DIM numbers over 7 files; the first number is the line's place."""
    path = scratch_path(spark, "lines")
    rest = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(DIM - 1)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(997)).cast("string")), ",")
    (spark.range(N).repartitionByRange(7, "id").sortWithinPartitions("id")
     .select(F.concat(F.lit("{"), F.col("id").cast("string"), F.lit(","), rest, F.lit("}"))).write.text(path))
    return path


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_every_line_keeps_its_place(spark, lines, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        v = vectors.load_vectors(spark, lines)
        wrong = v.where((F.col("id") != F.get("v", F.lit(0)).cast("long") + 1) | (F.size("v") != DIM)).count()
        assert (v.count(), v.select("id").distinct().count(), wrong) == (N, N, 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_results_table_keeps_every_key(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = spark.range(N).select(F.lit("m").alias("metric_type"), F.lit("e").alias("extension"), F.col("id").cast("string").alias("index_params"),
                                     F.lit("d").alias("dataset"), F.col("id").alias("n"), F.col("id").cast("double").alias("metric_value"),
                                     F.lit(0).cast("long").alias("k"), F.repeat(F.col("id").cast("string"), 100).alias("out"))
        t = results.results_table(rows)
        r = t.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        assert tuple(r) == (N, N, 1, N)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_positions_follow_the_order(spark):
    df = spark.range(100_000).select(F.xxhash64("id").alias("x"), F.repeat(F.lit("w"), 400).alias("wide"))
    got = knn.with_positions(df, "x").select("x", "pos").toPandas().sort_values("pos")
    assert got["pos"].tolist() == list(range(100_000)) and got["x"].is_monotonic_increasing


RANKS = """
import numpy as np, pyarrow as pa
from vekta.operators import kernel
g = np.random.default_rng(1)
c, q = g.standard_normal((1200, 16)), g.standard_normal((60, 16))
cn, ok = kernel.normalise(c)
b = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(list(q))], ["id", "v"])
t = pa.Table.from_batches(list(kernel.nearest_of_block(iter([b]), np.arange(1200), cn, ok, 40, 16, "id", "v", "cell", "rank", "d"))).to_pandas()
for i, rows in t.groupby("id"):
    d = 1 - cn @ (q[i] / np.linalg.norm(q[i]))
    assert rows["rank"].tolist() == list(range(1, 41))
    assert rows["cell"].tolist() == np.argsort(d, kind="stable")[:40].tolist(), i
"""


@pytest.mark.parametrize("features", ["", "AVX2 FMA3 AVX512F AVX512CD AVX512_SKX AVX512_CLX AVX512_CNL AVX512_ICL AVX512_SPR"])
def test_probe_ranks_are_in_order(features):
    env = os.environ | {"NPY_DISABLE_CPU_FEATURES": features, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    subprocess.run([sys.executable, "-W", "ignore", "-c", RANKS], check=True, env=env, timeout=120)


@pytest.mark.parametrize("first,step", [(0, 1), (1, 1), (3, 3), (1000, 7)])
def test_seed_and_windows_hold_every_row(spark, first, step):
    src = spark.range(1000).select((F.col("id") * step + first).alias("id"))
    plan = ingest.plan_ingest(src)
    seed, app = ingest.seed_rows(src, plan), ingest.appended_rows(src, plan)
    assert seed.count() + app.count() == 1000 and seed.unionByName(app.select("id")).distinct().count() == 1000
    capped = ingest.plan_ingest(src, max_n=400)
    assert ingest.seed_rows(src, capped).count() + ingest.appended_rows(src, capped).count() == 400


def test_dimension_is_what_most_rows_have(spark):
    rows = spark.createDataFrame([(0, [1.0])] + [(k, [1.0, 2.0, float(k)]) for k in range(1, 9)] + [(9, None)], "id long, v array<float>")
    assert vector_dim(rows, "v") == 3
    assert knn.knn_join(rows.where("id > 0"), rows, 2).count() == 16


def test_ivf_build_takes_unusable_vectors(spark):
    g = np.random.default_rng(2)
    rows = [(k, [float(x) for x in g.standard_normal(4)]) for k in range(60)] + [(60, [0.0] * 4), (61, None), (62, [1.0]), (63, [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    idx = ivf.ivf_build(df, lists=4, dim=4)
    assert idx.cells.count() == 64 and ivf.ivf_search(idx, df.where("id < 5"), 3, probes=4).count() == 15


def test_repeated_ids_are_assigned_once_each_beyond_the_broadcast_limit(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1])], "id long, v array<float>")
    cent = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cell int, v array<double>")
    spark.conf.set("vekta.broadcast.maxBytes", "16")
    try:
        got = sorted((r.id, r.v[0], r.cell) for r in ivf.with_cells(rows, cent, 2).collect())
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
    assert got == [(1, 0.0, 1), (1, 1.0, 0), (2, 1.0, 0)]


def test_a_group_that_finds_nothing_has_recall_zero(spark):
    found = spark.createDataFrame([("a", 1, 5, 1)], "g string, query_id long, id long, rank long")
    truth = spark.createDataFrame([(1, [5])], "id long, indices array<long>")
    groups = spark.createDataFrame([("a",), ("b",)], "g string")
    got = sorted((r.g, r.k, r.recall) for r in recall.recall_curve(found, truth, 1, [1, 2], by=["g"], groups=groups).collect())
    assert got == [("a", 1, 1.0), ("a", 2, 0.5), ("b", 1, 0.0), ("b", 2, 0.0)]


def test_last_write_needs_an_order(spark):
    cols = "metric_type string, extension string, index_params string, dataset string, n long, k long, metric_value double, seq int"
    rows = spark.createDataFrame([("m", "e", "p", "d", 1, 1, 9.0, 1), ("m", "e", "p", "d", 1, 1, 2.0, 2)], cols)
    assert results.dedupe_last(rows, "seq").first()["metric_value"] == 2.0
    with pytest.raises(Exception, match="a result key repeats"):
        results.dedupe_last(rows).collect()


def test_an_unreadable_table_is_not_overwritten(spark):
    path = scratch_path(spark, "broken")
    spark.range(1).selectExpr("'no parquet' AS t").write.text(path)
    with pytest.raises(Exception):
        vectors.ensure_table(spark.range(3), path)
    assert spark.read.text(path).count() == 1


def test_graph_append_and_read_back(spark, sf):
    base = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    old, new = base.where("id % 5 > 0"), base.where("id % 5 = 0")
    path = scratch_path(spark, "graph")
    catalog.write_index(graph.graph_build(old, m=8, ef_construction=32), path)
    idx = ingest.ingest_append(catalog.read_graph_index(spark, path), new)
    assert idx.vectors.count() == base.count() and (idx.m, idx.dim) == (8, 64)
    degree = idx.edges.groupBy("src").count().agg(F.max("count")).first()[0]
    assert degree <= 16 and idx.edges.where("src = dst").count() == 0
    found = graph.graph_search(idx, base, 10, ef=40)
    assert recall.recall_at_k(found, knn.build_truth(base, base, 10), base.count(), 10).first()["recall"] > 0.9
