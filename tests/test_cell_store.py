"""The index store by bucket of cells: appends, merges, splits, pruning at run time; and the stream that feeds an index."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vekta.operators import ingest, ivf, knn, two_level
from vekta.session import scratch_path
from vekta.sources.cell_store import CellStore
from vekta.streaming import ingest as sing


def vectors(spark, n, dim=8, seed=1, start=0, hot=0.4):
    """Two fifths of the rows around one point."""
    g = np.random.default_rng(seed)
    m = g.normal(size=(n, dim))
    m[: int(hot * n)] = m[0] + 0.05 * g.normal(size=(int(hot * n), dim))
    return spark.createDataFrame([(start + i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, v array<double>")


def ranked(df):
    return sorted((r.query_id, r.rank, r.id, r.distance) for r in df.collect())


def files(store):
    path = store.path.removeprefix("file:")
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{path}/rows") for f in fs if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def seeded(spark):
    return vectors(spark, 600), ivf.ivf_build(vectors(spark, 600), lists=16, seed=3, layout=False)


def new_store(spark, idx, buckets=4):
    return CellStore.create(idx, scratch_path(spark, "store"), buckets)


def test_appends_read_back_as_one_index(spark, seeded):
    base, idx = seeded
    store, more = new_store(spark, idx), vectors(spark, 300, seed=2, start=1000)
    before = files(store)
    assert store.append(more) == 2
    assert before < files(store)                                    # nothing stored was rewritten
    all_rows = base.unionByName(more)
    got = ranked(ivf.ivf_search(store.index(), all_rows, 5, probes=16))
    assert got == ranked(knn.knn_join(all_rows, all_rows, 5))
    some = ranked(ivf.ivf_search(store.index(), all_rows, 5, probes=3))
    assert some == ranked(ivf.ivf_search(ingest.ingest_append(idx, more), all_rows, 5, probes=3))


def test_merge_rewrites_only_touched_buckets(spark, seeded):
    base, idx = seeded
    store = new_store(spark, idx, buckets=8)
    one = base.where("id = 17")
    cell = idx.cells.where("id = 17").first()["cell"]
    store.append(one.select((F.col("id") + 5000).alias("id"), "v"))
    before = {b: g for g, b in store.live() if g == 1}
    assert store.merge() == [cell % 8]
    after = {b: g for g, b in store.live()}
    assert {b: g for b, g in after.items() if b != cell % 8} == {b: g for b, g in before.items() if b != cell % 8}
    assert store.index().cells.count() == 601 and store.merge() == []
    assert store.vacuum() == 2 and store.index().cells.count() == 601    # the bucket's seed folder and its append


def test_known_ids_are_skipped(spark, seeded):
    base, idx = seeded
    store = new_store(spark, idx)
    again = base.where("id < 50").unionByName(vectors(spark, 10, seed=5, start=900)).unionByName(vectors(spark, 10, seed=6, start=900))
    store.append(again, skip_known=True)
    ids = [r.id for r in store.index().cells.select("id").collect()]
    assert len(ids) == 610 and len(set(ids)) == 610
    assert store.append(again, skip_known=True) is None


def test_half_written_append_is_not_read(spark, seeded):
    _, idx = seeded
    store = new_store(spark, idx)
    store._write(idx.cells.select("id", "v", "cell"), 4)            # rows written, version never published
    assert store.index().cells.count() == 600
    assert store.append(vectors(spark, 5, seed=9, start=2000)) == 3 and store.index().cells.count() == 605


@pytest.mark.parametrize("levels", [1, 2])
def test_split_leaves_no_large_cell_but_copies(spark, levels):
    base = vectors(spark, 800).unionByName(spark.range(5000, 5100).selectExpr("id", "transform(sequence(1, 8), x -> IF(x = 1, -9D, 0D)) AS v"))
    idx = (ivf.ivf_build(base, lists=6, seed=3, layout=False) if levels == 1 else two_level.ivf_build_two_level(base, lists=6))
    store = new_store(spark, idx)
    assert store.split(60) > 5
    got = store.index()
    sizes = {r["cell"]: r["count"] for r in got.cells.groupBy("cell").count().collect()}
    copies = {r.cell for r in got.cells.where("id >= 5000").select("cell").collect()}
    assert len(copies) == 1                                         # equal vectors can't be told apart
    assert all(n <= 60 for c, n in sizes.items() if c not in copies)
    assert sum(sizes.values()) == 900 and got.lists == got.centroids.select("cell").distinct().count()
    assert ranked(ivf.ivf_search(got, base.limit(100), 5, probes=got.lists)) == ranked(knn.knn_join(base.limit(100), base, 5))


@pytest.mark.parametrize("grid", [False, True])
def test_buckets_are_pruned_at_run_time(spark, seeded, grid):
    base, idx = seeded
    store = new_store(spark, idx, buckets=16)
    want = ranked(ivf.ivf_search(idx, base.where("id < 3"), 5, probes=2))
    if grid:
        spark.conf.set("vekta.broadcast.maxBytes", "64")
    try:
        found = ivf.ivf_search(store.index(), base.where("id < 3"), 5, probes=2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan and ("FlatMapCoGroupsInArrow" in plan) == grid
        assert ranked(found) == want
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")


def test_null_and_short_vectors_empty_and_wider_tables(spark, seeded):
    _, idx = seeded
    store = new_store(spark, idx)
    odd = spark.createDataFrame([(7000, None, 1, "x"), (7001, [1.0], 2, "y"), (7002, [1.0] * 8, 3, "z")],
                                "id long, v array<double>, bucket int, gen string")
    store.append(odd)
    cells = store.index().cells
    assert {r.id for r in cells.where("bucket = -1").collect()} == {7000, 7001}
    assert cells.where("id = 7002").first()["cell"] is not None
    assert store.append(odd.where("id < 0")) is None and cells.count() == 603


def test_stream_above_the_centroid_limit_equals_the_batch(spark, seeded):
    _, idx = seeded
    src, out, ck = (scratch_path(spark, n) for n in ("src", "out", "ck"))
    new = vectors(spark, 40, seed=11, start=3000)
    new.where("id < 3020").coalesce(1).write.parquet(f"{src}/a")
    # ids seen before, in the index and in an earlier batch, come again
    new.where("id >= 3010").unionByName(vectors(spark, 5)).coalesce(1).write.parquet(f"{src}/b")

    def run():
        s = (spark.readStream.schema(new.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src))
        sing.ingest_stream(idx, s, out, ck, distinct_ids=True).awaitTermination()
        return sorted((r.id, r.cell) for r in sing.read_ingested(spark, out).collect())

    want = sorted((r.id, r.cell) for r in ivf.with_cells(new, idx.centroids, idx.dim).collect())
    spark.conf.set("vekta.broadcast.maxBytes", "512")
    try:
        assert run() == want
        assert run() == want                                        # a restart adds nothing
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
