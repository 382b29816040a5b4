"""Exact join with pruning: equal to the plain exact join, and cheaper where the data are clustered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vekta.operators import knn, pivots
from vekta.sources import fixtures as fx


def held(df):
    return sorted((r["query_id"], r["rank"], r["id"], str(r["distance"])) for r in df.collect())


def clustered(spark, n=1500, dim=8, centres=30, seed=1):
    g = np.random.default_rng(seed)
    c = g.normal(size=(centres, dim))
    m = c[g.integers(0, centres, n)] + 0.03 * g.normal(size=(n, dim))
    rows = [(i, [float(x) for x in m[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>")


@pytest.mark.parametrize("k", [1, 10])
def test_equal_to_the_exact_join_on_clustered_data(spark, k):
    b = clustered(spark)
    q = b.where("id % 7 = 0")
    idx = pivots.pivot_index(b)
    assert held(pivots.knn_join_pruned(q, idx, k)) == held(knn.knn_join(q, b, k))
    compared = pivots.pruned_effort(q, idx, k).agg(F.sum("examined")).first()[0]
    assert compared < 0.35 * q.count() * b.count()


def test_equal_on_the_given_vectors_and_on_the_grid_path(spark, sf):
    b = fx.base_vectors(spark, sf)
    q = b.where("id < 60")
    want = held(knn.knn_join(q, b, 10))
    assert held(pivots.knn_join_pruned(q, b, 10)) == want
    spark.conf.set("vekta.broadcast.maxBytes", str(64 * 8 * 30))
    spark.conf.set("vekta.block.maxBytes", str(64 * 8 * 50))
    try:
        assert held(pivots.knn_join_pruned(q, pivots.pivot_index(b, pivots=9), 10)) == want
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
        spark.conf.unset("vekta.block.maxBytes")


def test_edges(spark):
    rows = [(i, [float(i % 3) + 1, float(i % 5)]) for i in range(20)]                      # ties and copies
    rows += [(50, [0.0, 0.0]), (51, None), (52, [1.0]), (53, [None, 1.0]), (54, [-1.0, -2.0]), (5, [1.0, 1.0])]
    b = spark.createDataFrame(rows, "id long, v array<double>")
    valid = b.where("v is not null and size(v) = 2 and not exists(v, x -> x is null)")
    q = valid.where("id <> 5")
    for k in (1, 5, 21, 40):
        got, want = pivots.knn_join_pruned(q, pivots.pivot_index(b, pivots=4, dim=2), k), knn.knn_join(q, valid, k)
        assert held(got) == held(want)
    assert pivots.knn_join_pruned(q, pivots.pivot_index(b, dim=2), 0).count() == 0
    empty = pivots.pivot_index(b.where("id < 0"), dim=2)
    assert pivots.knn_join_pruned(q, empty, 3).count() == 0
