"""Exact nearest neighbours with pruning: pivots, their cells and the triangle inequality.

Angles between vectors are a metric. Every base row belongs to the cell of its nearest pivot, and a
cell is described by the least and greatest angle of its rows to the pivot. A first pass searches the cells nearest
to a query, which bounds the angle of its k-th neighbour from above. A cell can hold a
neighbour only if, by the triangle inequality, neither the cell's ring around its pivot nor the border
between the cell and the query's own lies farther off than that; the second pass meets those cells only, in the same
bounded (cell, salt, query block) groups as a cell search. The result is that of ``knn_join``.

Defined results: rows without a direction (zero vectors) rank last, as in ``knn_join``, and are met only by queries with fewer
than k other rows; null and wrong-length vectors take no part; a query without direction meets all cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shipping import ensure_shipped
from ..plans.sizing import vector_dim
from ..plans.staging import staged
from ..sources.vectors import vector_problem
from . import kernel as K
from .ivf import IvfIndex, ivf_search, probed_candidates, with_cells
from .knn import _empty, _prep, merge_topk, sample_queries

MOST_PIVOTS = 4096     # pivots are broadcast: at most this many, whatever the base
FIRST_CELLS = 2        # cells of the first pass
SLACK = 1e-6           # radians; more than arccos loses on double distances


@dataclass
class PivotIndex:
    cells: IvfIndex      # centroids: the pivots; cells: id, v, cell, angle
    rings: DataFrame     # cell, rows, low, high: row count and angles of a cell to its pivot


def pivot_index(base: DataFrame, pivots: int | None = None, seed: int = 42, id_col: str = "id", vec_col: str = "v",
                dim: int | None = None) -> PivotIndex:
    """Cells around ``pivots`` sampled rows (default: the root of the row count). Written to the shared folder.
    Rows without direction form cell -1, which has no pivot."""
    b = _prep(base, id_col, vec_col)
    dim = dim or vector_dim(b, "v") or 0
    usable = b.where(vector_problem(F.col("v"), dim).isNull())
    if pivots is None:
        pivots = math.isqrt(b.count())
    chosen = staged(sample_queries(usable.dropDuplicates(["id"]), max(1, min(pivots, MOST_PIVOTS)), seed=seed), "pivots")
    centroids = chosen.select((F.row_number().over(Window.orderBy("id")) - 1).alias("cell"), "v")   # at most MOST_PIVOTS rows
    rows = with_cells(b.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull())), staged(centroids, "pivot-cells"), dim, out_dist="angle")
    d = F.col("angle")
    has = d.isNotNull() & ~F.isnan(d)
    rows = rows.select("id", "v", F.when(has, F.col("cell")).otherwise(-1).alias("cell"),
                       F.when(has, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d)))).otherwise(0.0).alias("angle"))
    rows = staged(rows, "pivot-rows")
    rings = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    return PivotIndex(IvfIndex(staged(centroids, "pivot-centroids"), rows, pivots, dim), staged(rings, "pivot-rings"))


def possible_cells(index: PivotIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, cell) of every cell that can hold one of a query's k nearest rows. ``queries`` has (query_id, v)."""
    return _pairs(_asked(index, _bounded(index, queries, k), 1))


def _pairs(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", F.explode("cells").alias("cell"))


def _bounded(index: PivotIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, v, far): the first pass; ``far`` bounds the distance of the k-th neighbour (null: fewer than k were found)."""
    first = ivf_search(index.cells, queries, k, probes=FIRST_CELLS, query_id="query_id")
    reach = first.groupBy("query_id").agg(F.count_if(~F.isnan("distance")).alias("found"),
                                          F.max(F.when(~F.isnan("distance"), F.col("distance"))).alias("far"))
    return queries.join(reach.where(F.col("found") >= k), "query_id", "left").select("query_id", "v", "far")


def _asked(index: PivotIndex, bounded: DataFrame, parts: int) -> DataFrame:
    """(query_id, v, part, cells) of the cells that can hold a near row (``ivf.asked_cells``)."""
    spark = bounded.sparkSession
    ivf, dim = index.cells, index.cells.dim
    ring = {r["cell"]: r for r in index.rings.collect()}                       # at most MOST_PIVOTS + 1 rows
    table = ivf.centroids.toArrow()
    cells = table.column("cell").to_numpy()
    pivots, ok = K.vectors_from_arrow(table.column("v"), dim)
    pivots, _ = K.normalise(pivots, ok)
    held = np.array([c in ring for c in cells.tolist()], bool)
    cells, pivots = cells[held], pivots[held]
    low, high = (np.array([ring[c][n] for c in cells.tolist()], float) for n in ("low", "high"))
    sent = spark.sparkContext.broadcast((cells, pivots, low, high, -1 in ring))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, pivots, low, high, aimless = sent.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            q, valid = K.vectors_from_arrow(rb.column("v"), dim)
            qn, q_ok = K.normalise(q, valid)
            far = rb.column("far").to_numpy(zero_copy_only=False).astype(np.float64)
            ids = rb.column("query_id").to_numpy()
            step = max(1, K.BLOCK_CELLS // max(1, len(cells)))
            for s in range(0, len(ids), step):
                at = slice(s, s + step)
                phi = np.arccos(np.clip(qn[at] @ pivots.T, -1, 1)) if len(cells) else np.zeros((len(ids[at]), 0))
                least = np.maximum(phi - high, low - phi)
                if len(cells):
                    least = np.maximum(least, (phi - phi.min(axis=1, keepdims=True)) / 2)
                reach = np.arccos(np.clip(1 - far[at], -1, 1))
                all_cells = np.isnan(far[at]) | ~q_ok[at]
                row, col = np.nonzero((least <= reach[:, None] + SLACK) | all_cells[:, None])
                keep = valid[at][row]
                row, col = row[keep], col[keep]
                lost = np.flatnonzero(all_cells & valid[at]) if aimless else np.zeros(0, np.int64)
                yield K.asked_batch({"query_id": rb.column("query_id").slice(s, step)}, rb.column("v").slice(s, step),
                                    np.concatenate([row, lost]), np.concatenate([cells[col], np.full(len(lost), -1)]), parts)

    ensure_shipped(spark)
    kind = bounded.schema["v"].dataType.simpleString()
    return bounded.select("query_id", "v", "far").mapInArrow(choose, f"query_id long, v {kind}, part int, cells array<int>")


def knn_join_pruned(queries: DataFrame, base: DataFrame | PivotIndex, k: int, *, query_id: str = "id", query_vec: str = "v",
                    pivots: int | None = None, seed: int = 42) -> DataFrame:
    """Exact k nearest base rows for every query row, like ``knn_join``: (query_id, id, distance, rank)."""
    index = base if isinstance(base, PivotIndex) else pivot_index(base, pivots, seed)
    q = _prep(queries, query_id, query_vec, "query_id")
    if k <= 0 or index.cells.dim == 0:
        return _empty(queries.sparkSession)
    bounded = staged(_bounded(index, q, k), "pivot-bounds")
    most = index.rings.count()
    found = probed_candidates(index.cells, q, lambda: _pairs(_asked(index, bounded, 1)), lambda parts: _asked(index, bounded, parts), k, most)
    return merge_topk(found, k, source=index.cells.cells)


def pruned_effort(queries: DataFrame, index: PivotIndex, k: int, *, query_id: str = "id", query_vec: str = "v") -> DataFrame:
    """(query_id, examined): rows in the cells that a query meets in the second pass."""
    probe = possible_cells(index, _prep(queries, query_id, query_vec, "query_id"), k)
    return probe.join(index.rings, "cell").groupBy("query_id").agg(F.sum("rows").cast("long").alias("examined"))
