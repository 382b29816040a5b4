import math

import numpy as np
from pyspark.sql import functions as F

from vekta.functions import (cosine_distance, extract_plan_buffers, extract_run_metrics,
                             extract_timing, overlap_size, params_json, params_key, shift_ids,
                             with_stddev_band)
from vekta.operators import knn, metrics, results as R, sweep


def test_cosine_expression_matches_kernel(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(20, 6))
    rows = [(i, a[i].tolist(), a[(i + 1) % 20].tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    got = {r["id"]: r["d"] for r in df.select("id", cosine_distance("a", "b").alias("d")).collect()}
    for i in range(20):
        x, y = a[i], a[(i + 1) % 20]
        assert math.isclose(got[i], 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs_tol=1e-12)
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    vals = [r[0] for r in z.select(cosine_distance("a", "b")).collect()]
    assert math.isnan(vals[0]) and vals[1] is None


def test_id_list_helpers_and_params_key(spark):
    df = spark.createDataFrame([([1, 2, 2, 3], [3, 4, 2]), (None, [1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(overlap_size("a", "b")).collect()] == [2, 0]
    assert df.select(shift_ids("b", -1)).first()[0] == [2, 3, 1]
    m = spark.createDataFrame([({"probes": 16, "lists": 100},)], "m map<string,int>")
    assert m.select(params_key("m")).first()[0] == '{"lists":100,"probes":16}' == \
        params_json({"probes": 16, "lists": 100})


def test_text_extraction(spark):
    out = spark.createDataFrame([
        (1, "x\nlatency average = 1.500 ms\nlatency stddev = 0.250 ms\ntps = 12.000000 (without)\nTime: 42.5 ms"),
        (2, "nothing printed")], "id long, out string")
    r = {x["id"]: x for x in extract_timing(extract_run_metrics(out)).collect()}
    assert (r[1]["latency_average"], r[1]["latency_stddev"], r[1]["tps"], r[1]["time_ms"]) == (1.5, 0.25, 12.0, 42.5)
    assert r[2]["latency_average"] is None and r[2]["tps"] is None and r[2]["time_ms"] is None
    lines = spark.createDataFrame([
        (1, 0, "Buffers: shared hit=9 read=9"), (1, 1, "Index Scan (v <=> q)"),
        (1, 2, "  Buffers: shared hit=5"), (1, 3, "  Buffers: shared hit=7 read=2"),
        (2, 0, "Seq Scan"), (2, 1, "Buffers: shared hit=3 read=4")], "plan_id long, line_no long, line string")
    b = {x["plan_id"]: (x["shared_hit"], x["disk_read"]) for x in extract_plan_buffers(lines).collect()}
    assert b == {1: (5, 0), 2: (0, 0)}


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, x double")
    s = {r["g"]: r for r in metrics.summarize(df, "x", ["g"]).collect()}
    assert s["a"]["x_stddev"] is None and s["b"]["x_mean"] == 3.0
    band = with_stddev_band(metrics.summarize(df, "x", ["g"]), "x_mean", "x_stddev", "x").collect()
    bd = {r["g"]: (r["x_lower"], r["x_upper"]) for r in band}
    assert bd["a"] == (1.0, 1.0) and math.isclose(bd["b"][1] - bd["b"][0], 2 * math.sqrt(2))


def test_lookup_default_and_compare(spark):
    rows = [("recall (after create)", "ivf", "{}", "d", 10, 5, 0.8),
            ("select latency (ms)", "ivf", "{}", "d", 10, 5, 4.0)]
    ddl = "metric_type string, extension string, index_params string, dataset string, n long, k long, metric_value double"
    old = spark.createDataFrame(rows, ddl)
    new = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6] * 1.5) for r in rows], ddl)
    keys = spark.createDataFrame([("recall (after create)", "ivf", "{}", "d", 10, None),
                                  ("recall (after create)", "ivf", "{}", "d", 10, 5)],
                                 "metric_type string, extension string, index_params string, dataset string, n long, k long")
    got = sorted((r["k"], r["metric_value"]) for r in R.lookup_result(R.results_table(old), keys).collect())
    assert got == [(0, 0.0), (5, 0.8)]
    v = {r["metric_type"]: r["verdict"] for r in R.compare_results(old, new).collect()}
    assert v == {"recall (after create)": "better", "select latency (ms)": "worse"}


def test_evaluate_records(spark):
    rec = spark.createDataFrame([(5, 0.9, '{"lists":2}')], "k long, recall double, index_params string")
    lat = spark.createDataFrame([(5, '{"lists":2}', 3.0, 0.5, 100.0)],
                                "k long, index_params string, latency_average double, latency_stddev double, tps double")
    eff = spark.createDataFrame([(5, '{"lists":2}', 40.0, 4.0)],
                                "k long, index_params string, examined_mean double, examined_stddev double")
    ev = sweep.evaluate_search(rec, "ivf", "emb", 500, latency=lat, effort=eff)
    assert ev.count() == 6
    assert {r["metric_type"] for r in ev.collect()} >= {R.METRIC_RECALL_AFTER_CREATE, R.METRIC_SELECT_TPS}
    one = spark.createDataFrame([('{"lists":2}', 10.0, 100)], "index_params string, latency_ms double, size_bytes long")
    b1 = sweep.evaluate_build(one, "ivf", "emb", 500)
    assert {r["metric_type"] for r in b1.collect()} == {R.METRIC_CREATE_LATENCY, R.METRIC_DISK_USAGE}
    two = one.unionByName(spark.createDataFrame([('{"lists":2}', 14.0, 120)], one.schema))
    b2 = {r["metric_type"]: r["metric_value"] for r in sweep.evaluate_build(two, "ivf", "emb", 500).collect()}
    assert b2[R.METRIC_CREATE_LATENCY] == 12.0 and math.isclose(b2[R.METRIC_CREATE_LATENCY_STDDEV], math.sqrt(8))
    store = R.upsert_results(R.results_table(ev), b2 and sweep.evaluate_build(two, "ivf", "emb", 500))
    assert store.count() == 10


def test_sample_and_positions(spark):
    df = spark.range(1000).withColumnRenamed("id", "id")
    s1 = [r["id"] for r in knn.sample_queries(df, 10, seed=1).collect()]
    s2 = [r["id"] for r in knn.sample_queries(df.repartition(7), 10, seed=1).collect()]
    assert s1 == s2 and len(set(s1)) == 10


def test_series_keep_k_apart_unless_merged(spark):
    ddl = "metric_type string, extension string, index_params string, dataset string, n long, k long, metric_value double"
    rows = [("r", "ivf", "{}", "d", 10, 5, 0.5), ("r", "ivf", "{}", "d", 10, 10, 0.7),
            ("t", "ivf", "{}", "d", 10, 5, 3.0)]
    res = R.results_table(spark.createDataFrame(rows, ddl))
    apart = R.metric_series(res, ["r", "t"], "ivf", "{}", "d").collect()
    assert sorted((r["k"], r["r"]) for r in apart) == [(5, 0.5), (10, 0.7)]
    merged = R.metric_series(res, ["r", "t"], "ivf", "{}", "d", merge_k=True).collect()
    assert [(r["n"], r["r"], r["t"]) for r in merged] == [(10, 0.7, 3.0)]


def test_series_whose_metric_is_named_like_a_key_can_be_written(spark):
    from vekta.session import scratch_path
    rows = [("A", "ivf", "{}", "d", 5, 1, 1.5), ("N", "ivf", "{}", "d", 5, 1, 2.5), ("N", "ivf", "{}", "d", 5, 1, 3.5), ("N", "ivf", "{}", "d", 7, 1, 4.5)]
    res = spark.createDataFrame(rows, "metric_type string, extension string, index_params string, dataset string, n long, k long, metric_value double")
    one = R.metric_series(res, ["A", "N"], "ivf", "{}", "d")
    all_params = R.metric_series_all(res, ["A", "N"], "ivf", "d")
    assert one.columns == ["n", "k", "A", "N"] and all_params.columns == ["index_params", "n", "k", "A", "N"]
    assert [tuple(r) for r in one.collect()] == [(5, 1, 1.5, 3.5), (7, 1, None, 4.5)]
    for df in (one, all_params):
        path = scratch_path(spark, "series-out")
        df.write.parquet(path)
        assert df.sparkSession.read.parquet(path).count() == 2
