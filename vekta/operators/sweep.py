"""Parameter grids and sweeps: many parameter sets evaluated with as few
builds and scans as possible.

IVF: one k-means build per distinct ``lists``; per build ONE probe pass at
the largest ``probes`` keeps the top-k per (query, probed cell) with the
cell's probe rank; every smaller probe count is then a filter
``probe_rank <= probes`` (a generator, no join) followed by the grouped
top-k window — 6 probe settings cost one scan.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ensure_shipped
from ..plans.staging import dropped, staged
from ..plans.sizing import BroadcastBlock, BroadcastTooLarge, kernel_dtype, query_limit, vector_dim
from . import kernel as K
from .ivf import IvfIndex, asked_cells, block_candidates, ivf_build, nearest_centroids
from .knn import _prep, rank_candidates
from .recall import recall_curve

# The reference's sweep grids and K.
IVF_LIST_FACTORS = [0.6, 0.8, 1.0, 1.2, 1.4]
IVF_PROBES = [1, 2, 4, 8, 16, 32]
GRAPH_M = [4, 8, 16, 32, 64]
GRAPH_EF_CONSTRUCTION = [32, 64, 128]
GRAPH_EF = [10, 20, 40]
SWEEP_K = 5

GRID_DDL = "method string, lists int, probes int, m int, ef_construction int, ef int, index_params string"


def param_grids(sizes: DataFrame, method: str, n_col: str = "n") -> DataFrame:
    """The parameter sets for every row of ``sizes``, a base of ``n`` rows each: the columns of ``sizes`` and of the grid. ivf:
    lists = int(f * floor(sqrt n)) x probes (30 sets); graph: m x ef_construction x ef with
    ef_construction > 2m (27 sets); exact: one empty set."""
    def each(name: str, values: list) -> "F.Column":
        return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)

    def key(*names: str) -> "F.Column":
        parts = [F.concat(F.lit(f'"{n}":'), F.col(n).cast("string")) for n in sorted(names)]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    own = sizes.columns
    if method == "ivf":
        g = sizes.select("*", each("_f", IVF_LIST_FACTORS)).select("*", each("probes", IVF_PROBES))
        g = g.withColumn("lists", (F.col("_f") * F.floor(F.sqrt(n_col))).cast("int"))
        params = ["lists", "probes"]
    elif method == "graph":
        g = sizes.select("*", each("m", GRAPH_M)).select("*", each("ef_construction", GRAPH_EF_CONSTRUCTION)).select("*", each("ef", GRAPH_EF))
        g = g.where("ef_construction > 2 * m")
        params = ["m", "ef_construction", "ef"]
    elif method == "exact":
        g, params = sizes, []
    else:
        raise ValueError(f"unknown method {method!r}")
    return g.select(*own, F.lit(method).alias("method"),
                    *[F.col(c) if c in params else F.lit(None).cast("int").alias(c) for c in ("lists", "probes", "m", "ef_construction", "ef")],
                    key(*params).alias("index_params"))


def param_grid(spark: SparkSession, method: str, n: int) -> DataFrame:
    """``param_grids`` of one base of ``n`` rows, without its size."""
    return param_grids(spark.range(1).select(F.lit(n).alias("n")), method).drop("n")


def _settings(spark: SparkSession, name: str, values: list[int]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def probe_sweep_candidates(index: IvfIndex, queries: DataFrame, k: int, max_probes: int) -> DataFrame:
    """(query_id, probe_rank, id, distance): top-k per (query, probed cell)."""
    spark = queries.sparkSession
    dim = index.dim
    probe = nearest_centroids(queries, index.centroids, max_probes, dim, id_col="query_id", vec_col="v")
    blk = BroadcastBlock.collect(queries, "query_id", "v", dim, query_limit(spark, dim, max_probes * (k + 1)))
    valid = blk.extra["_valid"]
    qids, qm = blk.ids[valid], blk.matrix[valid]
    qn, q_ok = K.normalise(qm)
    pt = probe.select("query_id", "cell", "probe_rank").toArrow()
    pq = pt.column("query_id").to_numpy()
    pc = pt.column("cell").to_numpy().astype(np.int64)
    pos = {int(q): i for i, q in enumerate(qids)}
    rowq = np.array([pos.get(int(q), -1) for q in pq], dtype=np.int64)
    keep = rowq >= 0
    slot_query, slot_cell = rowq[keep], pc[keep]
    order = np.argsort(slot_cell, kind="stable")
    bounds = np.flatnonzero(np.diff(slot_cell[order])) + 1
    cell_slots = {int(slot_cell[g[0]]): g for g in np.split(order, bounds) if len(g)}
    bc = spark.sparkContext.broadcast((qids, qn, q_ok, cell_slots, slot_query, slot_cell))
    dt = kernel_dtype(spark)

    def run(batches):
        ids, m, ok, cs, sq, sc = bc.value
        yield from K.cell_pair_topk_partition(batches, ids, m, ok, cs, sq, sc, k, dim, "id", "v", "cell",
                                              dtype=dt)
    scan = (index.cells.select("id", "v", F.col("cell").cast("int").alias("cell"))
            .where(F.col("cell").isin(sorted(cell_slots))))
    ensure_shipped(spark)
    cands = scan.mapInArrow(run, "query_id long, cell int, id long, distance double")
    return cands.join(probe.select("query_id", "cell", "probe_rank"), ["query_id", "cell"])


def level_sweep_candidates(index: IvfIndex, queries: DataFrame, n: int, k: int, probes: list[int]) -> DataFrame:
    """(query_id, probe_rank, id, distance) for query sets above the broadcast limit, in one pass: top-k per query, block of rows and step
    between two probe counts. ``probe_rank`` is the upper end of the step, the least probe count that sees the candidate.
    A query's vector goes to a block once, whatever the steps, and its candidates to one partition before they count for every larger probe count."""
    found = block_candidates(index, lambda parts: asked_cells(index, queries, probes[-1], parts, probes), n, k, levels=len(probes))
    return found.withColumnRenamed("level", "probe_rank").repartition("query_id")


def sweep_ivf(base: DataFrame, queries: DataFrame, truth: DataFrame, grid: DataFrame,
              k: int = SWEEP_K, seed: int = 42, id_offset: int | str = 0) -> DataFrame:
    """recall@k per IVF parameter set: (lists, probes, index_params, k,
    recall, hits, queries). One build per distinct lists value."""
    spark = base.sparkSession
    q = _prep(queries, "id", "v", "query_id")
    dim = vector_dim(q, "v")
    nq = q.count()
    truth = staged(truth, "sweep-truth")       # read by every build
    sets = [(r["lists"], r["probes"]) for r in grid.where("method = 'ivf'").select("lists", "probes").collect()]
    out = None
    for lists in sorted({s[0] for s in sets}):
        probes = sorted({p for li, p in sets if li == lists})
        idx = ivf_build(base, lists=lists, seed=seed, dim=dim)
        idx = replace(idx, cells=staged(idx.cells, "sweep-cells"))
        try:
            cands = probe_sweep_candidates(idx, q, k, max(probes))
        except BroadcastTooLarge:
            cands = level_sweep_candidates(idx, q, nq, k, probes)
        parr = F.array(*[F.lit(p) for p in probes])
        per = cands.withColumn("probes", F.explode(F.filter(parr, lambda p: p >= F.col("probe_rank"))))
        top = rank_candidates(per, k, ["probes", "query_id"])
        r = (recall_curve(top, truth, nq, [k], id_offset, by=["probes"], groups=_settings(spark, "probes", probes))
             .withColumn("lists", F.lit(lists))
             .withColumn("index_params", F.concat(F.lit('{"lists":%d,"probes":' % lists),
                                                  F.col("probes").cast("string"), F.lit("}"))))
        out = r if out is None else out.unionByName(r)
    return out.select("lists", "probes", "index_params", "k", "recall", "hits", "queries")


def sweep_graph(base: DataFrame, queries: DataFrame, truth: DataFrame, grid: DataFrame,
                k: int = SWEEP_K, seed: int = 42, max_iter: int | None = None,
                id_offset: int | str = 0) -> DataFrame:
    """recall@k per graph parameter set. Candidates are gathered once, as many as the widest set
    needs; every (m, ef_construction) is pruned from that pool in one pass, and all graphs and ``ef`` values
    are searched together (both are parts of the beam key). Returns (m, ef_construction, ef, index_params, k, recall, hits, queries)."""
    from .graph import family_search, graph_family, graph_pool
    q = _prep(queries, "id", "v", "query_id")
    nq = q.count()
    truth = staged(truth, "sweep-truth")       # read by every graph
    sets = [(r["m"], r["ef_construction"], r["ef"])
            for r in grid.where("method = 'graph'").select("m", "ef_construction", "ef").collect()]
    vectors, cands, dim = graph_pool(base, max(max(m, efc) for m, efc, _ in sets), max_iter, seed=seed)
    graphs = sorted({(m, efc) for m, efc, _ in sets})
    family = graph_family(vectors, cands, dim, graphs)
    dropped(cands)
    efs = [sorted({e for m, efc, e in sets if (m, efc) == g}) for g in graphs]
    found = family_search(family, queries, k, efs, seed=seed)
    groups = base.sparkSession.createDataFrame([(g, e) for g in range(len(graphs)) for e in efs[g]], "graph int, ef int")
    name = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(efc).alias("ef_construction")) for m, efc in graphs])
    out = (recall_curve(found, truth, nq, [k], id_offset, by=["graph", "ef"], groups=groups)
           .withColumn("_set", F.get(name, F.col("graph"))).select("*", "_set.*")
           .withColumn("index_params", F.concat(F.lit('{"ef":'), F.col("ef").cast("string"), F.lit(',"ef_construction":'),
                                                F.col("ef_construction").cast("string"), F.lit(',"m":'), F.col("m").cast("string"), F.lit("}"))))
    return out.select("m", "ef_construction", "ef", "index_params", "k", "recall", "hits", "queries")


def evaluate_search(recall: DataFrame, extension: str, dataset: str, n: int,
                    latency: DataFrame | None = None, effort: DataFrame | None = None,
                    bulk: bool = False) -> DataFrame:
    """Melt one search evaluation into results rows (metric_type,
    metric_value) for the upsert: recall per K, plus latency/tps (from
    ``latency_summary``) and effort mean/stddev (examined candidates, the
    data-level counterpart of buffer hits; with read_mean / read_stddev also
    the reads) when given: eight metrics per K in all."""
    from . import results as R
    rows = recall.select(F.lit(R.METRIC_RECALL_AFTER_CREATE).alias("metric_type"),
                         F.col("recall").alias("metric_value"), F.col("k").cast("long").alias("k"),
                         F.col("index_params"))
    parts = [rows]
    if latency is not None:
        lat = [R.METRIC_SELECT_BULK_LATENCY if bulk else R.METRIC_SELECT_LATENCY,
               R.METRIC_SELECT_BULK_LATENCY_STDDEV if bulk else R.METRIC_SELECT_LATENCY_STDDEV,
               R.METRIC_SELECT_BULK_TPS if bulk else R.METRIC_SELECT_TPS]
        parts.append(latency.select(
            F.col("k").cast("long").alias("k"), "index_params",
            F.expr(f"stack(3, '{lat[0]}', latency_average, '{lat[1]}', latency_stddev, "
                   f"'{lat[2]}', tps) AS (metric_type, metric_value)")))
    if effort is not None:
        hit = R.METRIC_BUFFER_BULK_SHARED_HIT_COUNT if bulk else R.METRIC_BUFFER_SHARED_HIT_COUNT
        hsd = R.METRIC_BUFFER_BULK_SHARED_HIT_COUNT_STDDEV if bulk else R.METRIC_BUFFER_SHARED_HIT_COUNT_STDDEV
        parts.append(effort.select(
            F.col("k").cast("long").alias("k"), "index_params",
            F.expr(f"stack(2, '{hit}', examined_mean, '{hsd}', examined_stddev) AS (metric_type, metric_value)")))
        if "read_mean" in effort.columns:
            rd = R.METRIC_BUFFER_BULK_READ_COUNT if bulk else R.METRIC_BUFFER_READ_COUNT
            rsd = R.METRIC_BUFFER_BULK_READ_COUNT_STDDEV if bulk else R.METRIC_BUFFER_READ_COUNT_STDDEV
            parts.append(effort.select(
                F.col("k").cast("long").alias("k"), "index_params",
                F.expr(f"stack(2, '{rd}', read_mean, '{rsd}', read_stddev) AS (metric_type, metric_value)")))
    out = parts[0].select("metric_type", "metric_value", "k", "index_params")
    for p in parts[1:]:
        out = out.unionByName(p.select("metric_type", "metric_value", "k", "index_params"))
    return (out.withColumn("extension", F.lit(extension)).withColumn("dataset", F.lit(dataset))
            .withColumn("n", F.lit(n).cast("long")))


def evaluate_insert(latency: DataFrame, extension: str, dataset: str, n: int,
                    recall: DataFrame | None = None, bulk: bool = False) -> DataFrame:
    """Insert totals (one ``latency_summary`` row per index configuration,
    with ``index_params``) -> results rows: insert latency, its stddev and
    throughput (k = 0), plus recall after insert per K when given."""
    from . import results as R
    lat = R.METRIC_INSERT_BULK_LATENCY if bulk else R.METRIC_INSERT_LATENCY
    sd = R.METRIC_INSERT_BULK_LATENCY_STDDEV if bulk else R.METRIC_INSERT_LATENCY_STDDEV
    tps = R.METRIC_INSERT_BULK_TPS if bulk else R.METRIC_INSERT_TPS
    out = latency.select(
        "index_params", F.lit(0).cast("long").alias("k"),
        F.expr(f"stack(3, '{lat}', CAST(latency_average AS DOUBLE), '{sd}', CAST(latency_stddev AS DOUBLE), "
               f"'{tps}', CAST(tps AS DOUBLE)) AS (metric_type, metric_value)"))
    if recall is not None:
        out = out.unionByName(recall.select(
            "index_params", F.col("k").cast("long").alias("k"),
            F.lit(R.METRIC_RECALL_AFTER_INSERT).alias("metric_type"), F.col("recall").alias("metric_value")))
    return (out.withColumn("extension", F.lit(extension)).withColumn("dataset", F.lit(dataset))
            .withColumn("n", F.lit(n).cast("long")))


def evaluate_build(records: DataFrame, extension: str, dataset: str, n: int) -> DataFrame:
    """Build records (index_params, latency_ms, size_bytes per rebuild) ->
    results rows: averages always, sample stddevs only with > 1 rebuild."""
    from . import results as R
    from .metrics import build_summary
    s = build_summary(records, ["index_params"])
    melted = s.select(
        "index_params", "builds",
        F.expr(f"stack(4, '{R.METRIC_CREATE_LATENCY}', CAST(latency_average AS DOUBLE), "
               f"'{R.METRIC_CREATE_LATENCY_STDDEV}', CAST(latency_stddev AS DOUBLE), "
               f"'{R.METRIC_DISK_USAGE}', CAST(size_average AS DOUBLE), "
               f"'{R.METRIC_DISK_USAGE_STDDEV}', CAST(size_stddev AS DOUBLE)) AS (metric_type, metric_value)"))
    melted = melted.where(~F.col("metric_type").contains("stddev") | (F.col("builds") > 1)).drop("builds")
    return (melted.withColumn("extension", F.lit(extension)).withColumn("dataset", F.lit(dataset))
            .withColumn("n", F.lit(n).cast("long")).withColumn("k", F.lit(0).cast("long")))
