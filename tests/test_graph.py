import inspect
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vekta import workloads
from vekta.operators import graph, knn, recall, sweep
from vekta.session import checkpoint_dir
from vekta.sources import fixtures as fx


def test_graph_build_and_search(spark, sf):
    b = fx.base_vectors(spark, sf)
    n = b.count()
    g = graph.graph_build(b, m=6, ef_construction=16, max_iter=3)
    out = g.edges.where("kind = 'out'")
    deg = out.groupBy("src").count().agg(F.max("count"), F.min("count")).first()
    assert deg[0] <= 6
    assert g.edges.groupBy("src").count().agg(F.max("count")).first()[0] <= 12
    assert g.edges.where("src = dst").count() == 0
    assert g.edges.select("src", "dst").distinct().count() == g.edges.count()
    truth = knn.build_truth(b, b, 10)
    r10 = recall.recall_at_k(graph.graph_search(g, b, 10, ef=10), truth, n, 10).first()["recall"]
    r40 = recall.recall_at_k(graph.graph_search(g, b, 10, ef=40), truth, n, 10).first()["recall"]
    assert r40 >= r10 > 0.5
    res = graph.graph_search(g, b, 10, ef=10)
    assert res.groupBy("query_id").count().agg(F.max("count")).first()[0] == 10


def test_graph_search_wide_beam_is_exact_on_small_base(spark):
    rows = [(i, [float(i % 7), float(i % 5) + 1.0, float(i % 3)]) for i in range(40)]
    b = spark.createDataFrame(rows, "id long, v array<float>")
    g = graph.graph_build(b, m=5, ef_construction=10, max_iter=4)
    got = graph.graph_search(g, b, 3, ef=40, entry_points=40)
    want = knn.knn_join(b, b, 3)
    def key(df):
        return sorted((r["query_id"], r["rank"], round(r["distance"], 9)) for r in df.collect())
    assert key(got) == key(want)


def test_multi_ef_equals_single_searches(spark, sf):
    b = fx.base_vectors(spark, sf)
    g = graph.graph_build(b, m=6, ef_construction=16, max_iter=2)
    multi = graph.graph_search_multi(g, b, 5, [5, 20])
    for ef in (5, 20):
        one = sorted((r["query_id"], r["rank"], r["id"]) for r in graph.graph_search(g, b, 5, ef=ef).collect())
        got = sorted((r["query_id"], r["rank"], r["id"]) for r in multi.where(F.col("ef") == ef).collect())
        assert one == got


def test_sweep_graph_rows(spark, sf):
    from vekta.operators import sweep
    b = fx.base_vectors(spark, sf)
    grid = spark.createDataFrame([("graph", None, None, 4, 16, e, "x") for e in (10, 20)], sweep.GRID_DDL)
    truth = knn.build_truth(b, b, 5)
    res = sweep.sweep_graph(b, b, truth, grid, k=5, max_iter=2).collect()
    assert sorted(r["ef"] for r in res) == [10, 20]
    assert all(0 < r["recall"] <= 1 for r in res)


def test_search_with_query_set_above_broadcast_limit(spark, sf):
    b = fx.base_vectors(spark, sf)
    g = graph.graph_build(b, m=6, ef_construction=16, max_iter=2)
    q = b.where("id < 60")
    want = sorted((r["query_id"], r["rank"], r["id"]) for r in graph.graph_search(g, q, 5, ef=10).collect())
    spark.conf.set("vekta.broadcast.maxBytes", str(64 * 8 * 20))
    try:
        got = sorted((r["query_id"], r["rank"], r["id"]) for r in graph.graph_search(g, q, 5, ef=10).collect())
    finally:
        spark.conf.unset("vekta.broadcast.maxBytes")
    assert got == want


# m=8 and ef=20 bound the recall at the larger size
@pytest.mark.parametrize("scale,least", [("sf0.001", 0.96), ("sf0.1", 0.93)])
def test_registered_graph_search_keeps_its_recall_as_rows_grow(spark, sf, scale, least):
    path = os.path.join(os.path.dirname(sf), scale)
    b = fx.base_vectors(spark, path)
    found = workloads.QUERIES["graph_search"](spark, path)
    assert recall.recall_at_k(found, knn.build_truth(b, b, 10), b.count(), 10).first()["recall"] > least


def test_sweep_builds_until_few_edges_change():
    assert inspect.signature(sweep.sweep_graph).parameters["max_iter"].default is None


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_recall_with_more_links(spark, sf, scale):
    path = os.path.join(os.path.dirname(sf), scale)
    assert [r.reaches_95 for r in workloads.QUERIES["graph_search_recall"](spark, path).collect()] == [True]


def test_rounds_exchange_candidates_and_not_the_nodes(spark, sf):
    b = fx.base_vectors(spark, sf)
    g = graph.graph_build(b, m=4, ef_construction=8, max_iter=1)
    cands = spark.range(50).selectExpr("1 AS ef", "id % 7 AS query_id", "id")
    plan = graph.at_nodes(cands, g.nodes)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "Scan parquet" in x)
    assert "Bucketed: true" in lines[scan]
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < at:
            above.append(x)
            at = depth(x)
    assert any("ShuffledHashJoin" in x for x in above) and not any("Exchange" in x or "Sort" in x for x in above)


def test_occlusion_prunes_near_doubles(spark):
    """Candidates on one ray: the nearest is kept, the others are nearer to it than to the node; one to the other side is kept."""
    v = {0: [1.0, 0.0], 1: [1.0, 0.1], 2: [1.0, 0.11], 3: [1.0, 0.12], 4: [1.0, -0.3]}
    vectors = spark.createDataFrame(list(v.items()), "id long, v array<float>")
    cands = knn.knn_join(vectors.where("id = 0"), vectors, 5).where("id <> 0").selectExpr("query_id AS src", "id AS dst", "distance")
    two = sorted(r.dst for r in graph.diverse_links(cands, vectors, 2, 2).collect())
    assert two == [1, 4]
    assert sorted(r.dst for r in graph.diverse_links(cands, vectors, 2, 3).collect()) == [1, 2, 4]


def test_local_join_equals_brute_force_in_neighbourhoods(spark):
    import numpy as np
    g = np.random.default_rng(5)
    n, dim = 60, 6
    m = g.normal(size=(n, dim))
    vectors = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(n)], "id long, v array<double>")
    # node 0 is a hub: every node points at it
    pairs = {(i, 0) for i in range(1, n)} | {(i, int(j)) for i in range(n) for j in g.choice(n, 3, replace=False) if i != j}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, j, float(1 - unit[i] @ unit[j]), True) for i, j in sorted(pairs)]
    edges = graph._keep_best(spark.createDataFrame(rows, "src long, dst long, distance double, fresh boolean"), 8)
    got = {(r.src, r.dst): r.distance for r in graph.local_join(edges, vectors, dim, 8, 100).collect()}
    assert all(abs(d - (1 - unit[i] @ unit[j])) < 1e-12 for (i, j), d in got.items())
    around = {}
    for r in edges.collect():
        around.setdefault(r.src, set()).add(r.dst)
        around.setdefault(r.dst, set()).add(r.src)
    inside = {(a, b) for s in around.values() for a in s for b in s if a != b}
    assert set(got) <= inside and len(got) > n
    # one block a neighbourhood and room for all: every pair of it
    whole = {(r.src, r.dst) for r in graph.local_join(edges, vectors, dim, n, 1000).collect()}
    assert whole == inside


def test_zero_null_and_short_vectors_are_nodes_without_links(spark):
    rows = [(i, [float(i % 5) + 1, float(i % 7), 1.0]) for i in range(30)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0]), (103, [1.0, 1.0, 1.0])]
    b = spark.createDataFrame(rows, "id long, v array<double>")
    g = graph.graph_build(b, m=4, ef_construction=8, dim=3)
    links = {r.id: r.links for r in g.nodes.collect()}
    assert len(links) == 34 and links[100] == links[101] == links[102] == [] and links[103]
    found = graph.graph_search(g, b.where("id < 30"), 3, ef=20).collect()
    assert len(found) == 90 and all(r.id not in (101, 102) for r in found)
    empty = graph.graph_build(b.where("id < 0"), m=4, ef_construction=8, dim=3)
    assert empty.nodes.count() == 0 and graph.graph_search(empty, b, 3).count() == 0


def test_a_sweep_searches_all_its_graphs_at_once(spark, sf, monkeypatch):
    b = fx.base_vectors(spark, sf)
    q = b.where("id < 20")
    grid = spark.createDataFrame([("graph", None, None, m, efc, ef, "x") for m, efc in ((4, 16), (8, 16), (4, 32)) for ef in (5, 10)], sweep.GRID_DDL)
    calls = []
    monkeypatch.setattr(graph, "_beam", lambda *a, f=graph._beam, **kw: calls.append(1) or f(*a, **kw))
    got = sweep.sweep_graph(b, q, knn.build_truth(q, b, 5), grid, k=5, max_iter=1).collect()
    assert calls == [1] and len(got) == 6
    assert {r["index_params"] for r in got} >= {'{"ef":5,"ef_construction":16,"m":4}', '{"ef":10,"ef_construction":32,"m":4}'}


def test_a_family_finds_what_each_of_its_graphs_finds(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(300 + i, [1.0, 0.0, 2.0, 0.0, 1.0, 1.0]) for i in range(20)]
    rows += [(320, [0.0] * 6), (321, None), (322, [1.0])]
    b = spark.createDataFrame(rows, "id long, v array<double>")
    q = b.where("id % 20 = 0 or id > 318")
    vectors, cands, dim = graph.graph_pool(b, 24, 2)
    sets, efs = [(3, 12), (3, 24), (8, 24)], [[5, 9], [9], [5]]
    found = graph.family_search(graph.graph_family(vectors, cands, dim, sets), q, 4, efs)
    got = sorted((r.graph, r.ef, r.query_id, r.rank, r.id, str(r.distance)) for r in found.collect())
    want = []
    for g, (m, efc) in enumerate(sets):
        one = graph.graph_search_multi(graph.graph_from_pool(vectors, cands, dim, m, efc), q, 4, efs[g])
        want += [(g, r.ef, r.query_id, r.rank, r.id, str(r.distance)) for r in one.collect()]
    assert got == sorted(want) and got


def test_few_nodes_have_few_buckets(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        least = spark.sparkContext.defaultParallelism
        assert [graph._buckets(spark, n) for n in (0, 10_000, 1_000_000)] == [least, max(least, 10_000 // graph.BUCKET_NODES), 200]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def _points(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def test_a_search_round_holds_a_bucket_of_nodes_and_not_the_candidates(spark):
    g = graph.graph_build(_points(spark, 60), m=3, ef_construction=6, max_iter=1)
    plan = graph.at_nodes(spark.range(50).selectExpr("0 AS home", "id"), g.nodes)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan


def test_vectors_go_once_to_a_home(spark, monkeypatch):
    b = _points(spark, 300)
    sent = []
    monkeypatch.setattr(graph, "at_nodes", lambda c, n, f=graph.at_nodes: sent.append((c.count(), n.count())) or f(c, n))
    monkeypatch.setattr(graph, "HOME_LEAST", 10 ** 6)     # one home
    g = graph.graph_build(b, m=4, ef_construction=8, max_iter=2)
    assert len(graph.graph_search(g, b, 5, ef=10).collect()) == 1500
    assert len(sent) >= 5 and all(0 < asked <= nodes for asked, nodes in sent)


def test_homes_do_not_change_what_is_built_and_found(spark, monkeypatch):
    b = _points(spark, 300).unionByName(spark.createDataFrame([(300 + i, [1.0, 2.0, 0.0, 1.0, 0.0, 1.0]) for i in range(60)], "id long, v array<double>"))

    def run():
        g = graph.graph_build(b, m=4, ef_construction=10, max_iter=3)
        links = sorted((r.id, tuple(r.links)) for r in g.nodes.collect())
        return links, sorted((r.query_id, r.rank, r.id, r.distance) for r in graph.graph_search(g, b, 5, ef=8).collect())

    one = run()
    monkeypatch.setattr(graph, "HOME_NODES", 20)
    monkeypatch.setattr(graph, "HUB_BLOCKS", 1)
    monkeypatch.setattr(graph, "HOME_POOL", 200)
    homes, count = graph._homes(b, 6, 20)
    held = [r["count"] for r in homes.groupBy("home").count().collect()]
    assert count >= len(held) > 10 and sum(held) == 360 and max(held) <= 60     # 60 equal vectors share several homes
    assert run() == one


def test_tables_of_past_rounds_are_deleted(spark):
    at = checkpoint_dir(spark).removeprefix("file:")
    held = set(os.listdir(at))

    def new():
        return [x.rsplit("-", 1)[0] for x in os.listdir(at) if x not in held]

    b = _points(spark, 200)
    g = graph.graph_build(b, m=4, ef_construction=8, max_iter=3)
    found = graph.graph_search(g, b, 5, ef=10)
    assert "graph-pool" not in new() and "graph-links" not in new() and new().count("graph-beam") == 1
    assert found.count() == 1000
    grid = spark.createDataFrame([("graph", None, None, m, 8, 10, "x") for m in (3, 4)], sweep.GRID_DDL)
    got = sweep.sweep_graph(b, b, knn.build_truth(b, b, 5), grid, k=5, max_iter=2)
    assert "graph-pool" not in new() and "graph-links" not in new() and new().count("graph-beam") == 2
    assert got.count() == 2
