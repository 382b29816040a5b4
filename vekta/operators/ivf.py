"""IVF (inverted-file) approximate search on DataFrames.

Index = two tables:
  * centroids (cell, v)            — at most ``lists`` rows
  * cells     (id, v, cell)        — every base row with its nearest centroid,
                                     range-partitioned and sorted by cell so
                                     Parquet row-group min/max on ``cell``
                                     skips unprobed cells.

Search: each query's ``probes`` nearest centroids (a pure map against the
broadcast centroid block), then the base scan keeps only probed cells
(literal ``IN`` pushed to the scan) and the cell kernel compares a row only
with the queries that probe its cell. No shuffle of the base; no cell-keyed
shuffle, so a hot cell (a third of all rows) cannot pile up in one task.
Above the broadcast limit both sides are dealt to bounded blocks (``block_candidates``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shipping import ensure_shipped
from ..plans.staging import staged
from ..sources.vectors import vector_problem
from ..plans.sizing import (GROUPS_PER_CORE, BroadcastBlock, BroadcastTooLarge, block_limit, broadcast_limit,
                            dealt, grid_partitions, grid_shape, kernel_dtype, query_limit, vector_dim)
from . import kernel as K
from .knn import CANDIDATES_DDL, _empty, _prep, merge_topk

# Index parameter defaults of the reference.
DEFAULT_LISTS = 100
DEFAULT_PROBES = 16


@dataclass
class IvfIndex:
    centroids: DataFrame   # (cell int, v array<double>)
    cells: DataFrame       # (id long, v array<float>, cell int)
    lists: int
    dim: int
    coarse: DataFrame | None = None   # (cell, v) of the upper level; centroids then have its cell as ``coarse``
    buckets: int | None = None        # cells are partitioned by ``bucket`` = cell modulo this (sources.cell_store)


def bucket_of(cell: Column, buckets: int) -> Column:
    """Folder of a cell in a store by bucket; rows without a cell are in -1."""
    return F.coalesce(F.pmod(cell.cast("int"), F.lit(buckets)), F.lit(-1)).cast("int")


def _centroid_block(centroids: DataFrame, dim: int) -> BroadcastBlock:
    spark = centroids.sparkSession
    c = centroids.select(F.col("cell").cast("long").alias("cell"), "v")
    return BroadcastBlock.collect(c, "cell", "v", dim, broadcast_limit(spark))


def nearest_centroids(df: DataFrame, centroids: DataFrame, n: int, dim: int,
                      id_col: str = "id", vec_col: str = "v",
                      out_cell: str = "cell", out_rank: str = "probe_rank",
                      out_dist: str = "cell_distance") -> DataFrame:
    """For every row of ``df``: its n nearest centroids (rank 1..n; ties by
    cell id). The centroid table is size-checked and broadcast; the rows are
    streamed through a map, so this never shuffles."""
    spark = df.sparkSession
    try:
        blk = _centroid_block(centroids, dim)
    except BroadcastTooLarge:
        return _centroids_by_join(df, centroids, n, dim, id_col, vec_col, out_cell, out_rank, out_dist)
    cn, c_ok = K.normalise(blk.matrix, blk.extra["_valid"])
    bc = spark.sparkContext.broadcast((blk.ids, cn, c_ok))
    dt = kernel_dtype(spark)

    def run(batches):
        ids, m, ok = bc.value
        yield from K.nearest_of_block(batches, ids, m, ok, n, dim, id_col, vec_col,
                                      out_cell, out_rank, out_dist, dtype=dt)
    ensure_shipped(spark)
    schema = f"{id_col} long, {out_cell} long, {out_rank} long, {out_dist} double"
    return (df.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col))
            .mapInArrow(run, schema)
            .withColumn(out_cell, F.col(out_cell).cast("int")))


def _centroids_by_join(df: DataFrame, centroids: DataFrame, n: int, dim: int, id_col: str,
                       vec_col: str, out_cell: str, out_rank: str, out_dist: str) -> DataFrame:
    """Centroid table above the broadcast limit (many lists x high dimension):
    an exact kNN join with the centroids as the base side — the rows are
    broadcast when they are few (query probes), else the grid path."""
    from .knn import knn_join
    c = centroids.select(F.col("cell").cast("long").alias("id"), F.col("v"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    r = knn_join(rows, c, n, dim=dim)
    return r.select(F.col("query_id").alias(id_col), F.col("id").cast("int").alias(out_cell),
                    F.col("rank").alias(out_rank), F.col("distance").alias(out_dist))


def assign_cells(df: DataFrame, centroids: DataFrame, dim: int, id_col: str = "id",
                 vec_col: str = "v") -> DataFrame:
    """(id, cell, cell_distance): the nearest centroid of every row."""
    return (nearest_centroids(df, centroids, 1, dim, id_col, vec_col)
            .drop("probe_rank"))


def with_cells(df: DataFrame, centroids: DataFrame, dim: int, vec_col: str = "v",
               out_cell: str = "cell", out_dist: str | None = None, id_col: str = "id") -> DataFrame:
    """Every row of ``df`` with its nearest centroid appended (all columns
    pass through). One map over the rows — no join back by id, so assigning
    a 100 TB base costs one scan, not a shuffle of the base."""
    spark = df.sparkSession
    try:
        blk = _centroid_block(centroids, dim)
    except BroadcastTooLarge:
        if df.isStreaming:
            raise ValueError("centroid table exceeds vekta.broadcast.maxBytes; a streaming assignment "
                             "needs the centroids broadcast (raise the limit or use fewer lists)")
        # centroid table above the broadcast limit: assign by kNN join, then
        # attach by id (a shuffle, only on this fallback path)
        # (ids may repeat, so rows go by a number of their own, fixed by the written table)
        rows = staged(df.withColumn("_uid", F.monotonically_increasing_id()), "assign")
        a = _centroids_by_join(rows, centroids, 1, dim, "_uid", vec_col, out_cell, "_rank", "_dist")
        a = a.select("_uid", out_cell, *([F.col("_dist").alias(out_dist)] if out_dist else []))
        return rows.join(a, "_uid", "left").select(*df.columns, out_cell, *([out_dist] if out_dist else []))
    cn, c_ok = K.normalise(blk.matrix, blk.extra["_valid"])
    bc = spark.sparkContext.broadcast((blk.ids, cn, c_ok))
    dt = kernel_dtype(spark)
    names = df.columns

    def run(batches):
        ids, m, ok = bc.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            cell, dist = K.nearest_one(rb.column(vec_col), ids, m, ok, dim, dtype=dt)
            cols = [rb.column(c) for c in names] + [pa.array(cell, pa.int32(), mask=cell < 0)]
            out = names + [out_cell]
            if out_dist:
                cols.append(pa.array(dist, pa.float64()))
                out.append(out_dist)
            yield pa.RecordBatch.from_arrays(cols, names=out)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ddl += f", `{out_cell}` int" + (f", `{out_dist}` double" if out_dist else "")
    ensure_shipped(spark)
    return df.mapInArrow(run, ddl)


def label_centroids(base: DataFrame, cell_col: str = "label", vec_col: str = "v") -> DataFrame:
    """Per-cell mean vector (double), with map-side partial aggregation, so a
    cell holding a third of all rows costs no more than any other."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    dim = vector_dim(base, vec_col)
    return (base.where(vector_problem(F.col(vec_col), dim or 0).isNull())
            .select(F.col(cell_col).cast("int").alias("cell"),
                    array_to_vector(F.col(vec_col)).alias("_f"))
            .groupBy("cell").agg(Summarizer.mean(F.col("_f")).alias("_m"))
            .select("cell", vector_to_array("_m").alias("v")))


# Target bytes per index partition when the index is laid out by cell.
LAYOUT_PARTITION_BYTES = 256 * 1024 * 1024


def _layout(cells: DataFrame, rows: int | None, dim: int) -> DataFrame:
    """Cluster rows by cell for min/max skipping: range partitions on
    (cell, id) — the id splits a hot cell over as many partitions as its
    size needs — sorted within partitions. The partition count follows the
    data size (~256 MB each), not the number of lists."""
    spark = cells.sparkSession
    if rows is None:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    else:
        n = max(spark.sparkContext.defaultParallelism,
                -(-int(rows) * (dim * 4 + 16) // LAYOUT_PARTITION_BYTES))
    return cells.repartitionByRange(n, "cell", "id").sortWithinPartitions("cell", "id")


def ivf_from_labels(base: DataFrame, cell_col: str = "label", id_col: str = "id",
                    vec_col: str = "v", dim: int | None = None, layout: bool = False) -> IvfIndex:
    """Deterministic IVF index whose cells are a given label column and whose
    centroids are the per-label means."""
    b = base.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"),
                    F.col(cell_col).cast("int").alias("cell"))
    dim = dim or vector_dim(b, "v")
    cent = label_centroids(b, "cell", "v")
    cells = _layout(b, None, dim) if layout else b
    return IvfIndex(cent, cells, lists=-1, dim=dim)


def ivf_build(base: DataFrame, lists: int = DEFAULT_LISTS, seed: int = 42, max_iter: int = 10,
              rows_per_list: int | None = 256, id_col: str = "id", vec_col: str = "v",
              dim: int | None = None, layout: bool = True) -> IvfIndex:
    """k-means IVF index (cosine). Centroids are fitted by Spark ML KMeans on
    about ``rows_per_list`` rows for each list, drawn by a seeded hash of the
    id (None: all rows); every row is then assigned by the
    broadcast-centroid kernel. Vectors without a direction (NULL, wrong
    length, NULL element, zero) take no part in the fit; NULL and wrong-length
    ones get no cell."""
    b = base.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    dim = dim or vector_dim(b, "v")
    n = b.count()
    lists = max(1, min(int(lists), n))
    usable = b.where(vector_problem(F.col("v"), dim or 0).isNull())
    cent = fit_centroids(usable, n, lists, rows_per_list, seed, max_iter)
    cells = with_cells(b, cent, dim)
    if layout:
        cells = _layout(cells, n, dim)
    return IvfIndex(cent, cells, lists=cent.count(), dim=dim)


def fit_centroids(usable: DataFrame, n: int, lists: int, rows_per_list: int | None, seed: int, max_iter: int) -> DataFrame:
    """(cell, v) of Spark ML KMeans (cosine) on about ``rows_per_list`` of the ``n`` rows (id, v) for each list."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    one_in = 1 if rows_per_list is None else max(1, n // (rows_per_list * lists))
    sample = usable.where(F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(one_in)) == 0)
    # the sample follows ``lists``; MLlib iterates over it, so cache it
    feats = sample.select(array_to_vector("v").alias("features")).persist()
    try:
        model = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=max_iter,
                       featuresCol="features").fit(feats)
    finally:
        feats.unpersist()
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return usable.sparkSession.createDataFrame(centers, "cell int, v array<double>")


def _cell_map(qids: np.ndarray, probe_q: np.ndarray, probe_c: np.ndarray) -> dict:
    """cell -> sorted positions (in the query block) of the queries probing it."""
    import pandas as pd
    rows = pd.Index(qids).get_indexer(probe_q)
    keep = rows >= 0
    df = pd.DataFrame({"cell": probe_c[keep].astype(np.int64), "row": rows[keep].astype(np.int64)})
    return {int(c): np.sort(g["row"].to_numpy()) for c, g in df.groupby("cell", sort=True)}


def _probe_table(queries: DataFrame, index: IvfIndex, probes: int) -> DataFrame:
    if index.coarse is not None:
        from .two_level import probe_two_level
        return probe_two_level(queries, index, probes)
    return nearest_centroids(queries, index.centroids, probes, index.dim,
                             id_col="query_id", vec_col="v")


def ivf_candidates(index: IvfIndex, queries: DataFrame, k: int, probes: int,
                   counts: bool = False) -> DataFrame:
    """Partial candidates (query_id, id, distance) — or (query_id, examined)."""
    return probed_candidates(index, queries, lambda: _probe_table(queries, index, probes),
                             lambda parts: asked_cells(index, queries, probes, parts), k, probes, counts,
                             every=0 <= index.lists <= probes)


def asked_cells(index: IvfIndex, queries: DataFrame, probes: int, parts: int, levels: list[int] | None = None) -> DataFrame:
    """(query_id, v, part, cells): the ``probes`` nearest cells of a query, a row for each part (cell modulo ``parts``) that
    holds one of them. With ``levels`` (ascending probe counts) also ``levels``: for each of ``cells`` the least of
    the levels that its rank is within. A search of all lists asks for every cell (``cells`` is null), whatever their order."""
    spark = queries.sparkSession
    dim, dt = index.dim, kernel_dtype(spark)
    if levels is None and 0 <= index.lists <= probes:
        spread = queries.repartition(GROUPS_PER_CORE * spark.sparkContext.defaultParallelism) if parts > 1 else queries
        return (spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
                .select("query_id", "v", "part", F.lit(None).cast("array<int>").alias("cells")))
    kind = queries.schema["v"].dataType.simpleString()
    blk = None
    if index.coarse is None:
        try:
            blk = _centroid_block(index.centroids, dim)
        except BroadcastTooLarge:
            pass
    if blk is None:
        probe = _probe_table(queries, index, probes)
        cell = F.col("cell").cast("int")
        asked = probe.select("query_id", F.pmod(cell, F.lit(parts)).cast("int").alias("part"),
                             F.struct(cell.alias("cell"), *([] if levels is None else [_level(F.col("probe_rank"), levels).alias("level")])).alias("c"))
        lists = {"cells": "cell"} if levels is None else {"cells": "cell", "levels": "level"}
        cells = asked.groupBy("query_id", "part").agg(F.collect_list("c").alias("c"))
        return (cells.join(queries.select("query_id", "v"), "query_id")
                .select("query_id", "v", "part", *[F.col(f"c.{of}").alias(name) for name, of in lists.items()]))
    cn, c_ok = K.normalise(blk.matrix, blk.extra["_valid"])
    sent = spark.sparkContext.broadcast((blk.ids, cn, c_ok))
    steps = np.array(levels or [], dtype=np.int64)

    def ask(batches):
        ids, m, ok = sent.value
        for rb in batches:
            for s in range(0, rb.num_rows, ASKED_ROWS):
                part = rb.slice(s, ASKED_ROWS).append_column("row", pa.array(np.arange(min(ASKED_ROWS, rb.num_rows - s))))
                for near in K.nearest_of_block(iter([part]), ids, m, ok, probes, dim, "row", "v", "cell", "rank", "distance", dtype=dt):
                    row, cell = near.column("row").to_numpy(), near.column("cell").to_numpy()
                    level = steps[np.searchsorted(steps, near.column("rank").to_numpy())] if len(steps) else None
                    yield K.asked_batch({"query_id": part.column("query_id")}, part.column("v"), row, cell, parts, level)

    ensure_shipped(spark)
    return (queries.select("query_id", "v").repartition(GROUPS_PER_CORE * spark.sparkContext.defaultParallelism)
            .mapInArrow(ask, f"query_id long, v {kind}, part int, cells array<int>" + (", levels array<int>" if levels else "")))


def _level(rank: Column, levels: list[int]) -> Column:
    return F.get(F.filter(F.array(*[F.lit(p) for p in levels]), lambda p: p >= rank), F.lit(0))


# Queries whose cells are listed at a time.
ASKED_ROWS = 1024
# Cells that a search asks for are broadcast to its scan up to this many (12 bytes each).
MAX_ASKED = 1_000_000


def _asked_rows(index: IvfIndex, probe: DataFrame) -> DataFrame:
    """Rows (id, v, cell) of the cells in ``probe``, by a semi join on (bucket, cell): Spark turns the asked buckets into a
    dynamic filter on the folders of the scan, so unasked ones are never listed into tasks or read."""
    asked = (probe.where(F.col("cell") >= 0).select(F.col("cell").cast("int").alias("cell")).distinct()
             .withColumn("bucket", bucket_of(F.col("cell"), index.buckets)))
    if 0 <= index.lists <= MAX_ASKED:
        asked = F.broadcast(asked)
    return index.cells.join(asked, ["bucket", "cell"], "left_semi").select("id", "v", "cell")


def probed_candidates(index: IvfIndex, queries: DataFrame, pairs: Callable[[], DataFrame], asked: Callable[[int], DataFrame],
                      k: int, most: int, counts: bool = False, every: bool = False) -> DataFrame:
    """Candidates of the cells that queries ask for, at most ``most`` a query (``every``: all cells). ``pairs()`` has them as
    (query_id, cell), for queries few enough to broadcast; ``asked(parts)`` has one row a query and part (``asked_cells``)."""
    spark = queries.sparkSession
    dim = index.dim
    try:
        blk = BroadcastBlock.collect(queries, "query_id", "v", dim, query_limit(spark, dim, k + most))
    except BroadcastTooLarge:
        return block_candidates(index, asked, queries.count(), k, counts, every=every)
    probe = pairs()
    if index.buckets:
        probe = staged(probe.select("query_id", "cell"), "probes")     # read by the scan's filter and by the kernel's map
    valid = blk.extra["_valid"]
    qids, qm = blk.ids[valid], blk.matrix[valid]
    qn, q_ok = K.normalise(qm)
    pt = probe.select("query_id", "cell").toArrow()  # Q x probes ints: bounded with the block
    cq = _cell_map(qids, pt.column("query_id").to_numpy(), pt.column("cell").to_numpy())
    if not cq:
        return spark.createDataFrame([], "query_id long, examined long" if counts else CANDIDATES_DDL)
    bc = spark.sparkContext.broadcast((qids, qn, q_ok, cq))
    dt = kernel_dtype(spark)

    def run(batches):
        ids, m, ok, cmap = bc.value
        yield from K.cell_topk_partition(batches, ids, m, ok, cmap, k, dim, "id", "v", "cell", dtype=dt,
                                         counts=counts)
    if index.buckets:
        scan = _asked_rows(index, probe)
    else:
        scan = index.cells.select("id", "v", F.col("cell").cast("int").alias("cell"))
        scan = scan.where(F.col("cell").isin(sorted(cq)))
    schema = "query_id long, examined long" if counts else CANDIDATES_DDL
    ensure_shipped(spark)
    return scan.mapInArrow(run, schema)


def block_candidates(index: IvfIndex, asked: Callable[[int], DataFrame], queries: int, k: int, counts: bool = False,
                     every: bool = False, levels: int = 0) -> DataFrame:
    """Shuffle path: (part, salt, qb) groups, bounded on both sides, numbered and dealt by number.

    A part is the cells of one remainder, as many parts as the rows need blocks. A query goes to a part once, with the
    list of its cells there, not once a cell, so what is sent grows with the parts a query meets. A part with more rows than
    a block holds (a hot cell) is split into salts; queries are dealt to query blocks. Each row goes to all query blocks of
    its salt and each query to all salts of its part. Where ``asked`` has ``levels`` (at most that many a query), a query's
    k nearest of each level are kept: (query_id, level, id, distance)."""
    spark = index.cells.sparkSession
    dim, dt = index.dim, kernel_dtype(spark)
    held = index.cells.count()
    qb, parts = grid_shape(spark, queries, held, dim, 0 if counts else k * max(1, levels))
    wanted = asked(parts)
    if index.buckets and not every:
        def distinct(batches):
            for rb in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(rb.column("cells").flatten().to_numpy()), pa.int32())], ["cell"])
        rows = _asked_rows(index, wanted.select("cells").mapInArrow(distinct, "cell int"))
    else:
        rows = index.cells.select("id", "v", F.col("cell").cast("int").alias("cell"))
    rows = rows.where("cell is not null").withColumn("part", F.pmod("cell", F.lit(parts)).cast("int"))
    most = max(1, block_limit(spark) // max(1, dim * 8))
    salts = rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("salts"))    # one row a part
    salts = salts.withColumn("before", F.sum("salts").over(Window.orderBy("part")) - F.col("salts"))
    n = grid_partitions(qb * (parts + math.ceil(held / most)))    # no part has more salts than its blocks and one
    group = ((F.col("before") + F.col("salt")) * F.lit(qb) + F.col("qb")).cast("int").alias("block")
    b = (dealt(rows, held, qb, dim).join(F.broadcast(salts), "part")
         .withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
         .select(group, "id", "v", "cell").repartitionById(n, "block"))
    q = (wanted.join(F.broadcast(salts), "part")
         .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
         .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int"))
         .select(group, "query_id", "v", "cells", *(["levels"] if levels else [])).repartitionById(n, "block"))

    def meet(qt: pa.Table, bt: pa.Table) -> pa.Table:
        return K.cells_topk(qt, bt, k, dim, ["query_id"], dt, counts)
    schema = "query_id long, examined long" if counts else f"query_id long, {'level int, ' if levels else ''}id long, distance double"
    ensure_shipped(spark)
    return q.groupBy("block").cogroup(b.groupBy("block")).applyInArrow(meet, schema)


def ivf_search(index: IvfIndex, queries: DataFrame, k: int, probes: int = DEFAULT_PROBES,
               query_id: str = "id", query_vec: str = "v") -> DataFrame:
    """Approximate k nearest: (query_id, id, distance, rank)."""
    q = _prep(queries, query_id, query_vec, "query_id")
    if k <= 0 or probes <= 0:
        return _empty(queries.sparkSession)
    return merge_topk(ivf_candidates(index, q, k, probes), k, source=index.cells)


def search_effort(index: IvfIndex | None, queries: DataFrame, base: DataFrame | None = None,
                  probes: int = DEFAULT_PROBES, query_id: str = "id",
                  query_vec: str = "v") -> DataFrame:
    """Candidates examined per query: (query_id, examined), from the cells'
    row counts; no distance but those to the centroids is computed.

    ``index=None`` measures exact search over ``base`` (every valid row)."""
    q = _prep(queries, query_id, query_vec, "query_id")
    if index is None:
        dim = vector_dim(q, "v")
        n = _countable(_prep(base, "id", "v"), dim).agg(F.count(F.lit(1)).alias("n")).scalar()
        return _countable(q, dim).select("query_id", n.cast("long").alias("examined")).where("examined > 0")
    sizes = (_countable(index.cells, index.dim).groupBy(F.col("cell").cast("int").alias("cell"))
             .agg(F.count(F.lit(1)).alias("rows")))  # one row per list
    return (_probe_table(q, index, probes).join(sizes, "cell")
            .groupBy("query_id").agg(F.sum("rows").cast("long").alias("examined")))


def _countable(df: DataFrame, dim: int | None) -> DataFrame:
    """Rows whose vector a search compares: the right length, no NULL."""
    return df.where((F.size("v") == F.lit(dim or 0)) & ~F.exists("v", lambda x: x.isNull()))
