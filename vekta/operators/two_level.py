"""Two-level cells: k-means for numbers of lists whose centroids fit neither the driver nor one block.

The root of ``lists`` coarse centroids is fitted over the whole base's sample and broadcast. Rows meet the fine centroids
of their coarse cell only, in bounded groups: the sample of a coarse cell is fitted in grouped tasks, one task for each
(coarse cell, salt), and a coarse cell that holds many rows is fitted and assigned in several salts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shipping import ensure_shipped
from ..plans.sizing import block_limit, kernel_dtype, vector_dim
from ..plans.staging import staged
from ..sources.vectors import vector_problem
from . import kernel as K
from .ivf import IvfIndex, _layout, fit_centroids, nearest_centroids, with_cells
from .knn import rank_candidates

FIT_ITERATIONS = 10
COARSE_PROBES = 4       # coarse cells whose fine centroids a query meets, at least


def spherical_kmeans(v: np.ndarray, lists: int, seed: int, iterations: int = FIT_ITERATIONS) -> np.ndarray:
    """Centroids of normalised rows ``v`` under cosine; a centroid that loses all rows moves to the row farthest from its own."""
    g = np.random.default_rng(seed)
    centres = v[g.permutation(len(v))[:lists]].copy()
    for _ in range(iterations):
        best, score = np.zeros(len(v), np.int64), np.zeros(len(v))
        step = max(1, K.BLOCK_CELLS // max(1, len(centres)))
        for s in range(0, len(v), step):
            d = v[s:s + step] @ centres.T
            best[s:s + step] = d.argmax(axis=1)
            score[s:s + step] = d.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, v)
        empty = np.flatnonzero(np.bincount(best, minlength=len(centres)) == 0)
        sums[empty] = v[np.argsort(score, kind="stable")[:len(empty)]]
        sums, ok = K.normalise(sums)
        moved = np.where(ok[:, None], sums, centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def _salted(rows: DataFrame, most: int, key: str) -> DataFrame:
    """``rows`` with ``salt`` and ``salts``: a coarse cell of n rows has ceil(n / most) salts."""
    salts = rows.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("salts"))   # one row a coarse cell
    return (rows.join(F.broadcast(salts), "coarse")
            .withColumn("salt", F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.col("salts")).cast("int")))


def fit_two_level(base: DataFrame, lists: int, dim: int, seed: int = 42, rows_per_list: int = 64) -> tuple[DataFrame, DataFrame]:
    """(coarse, centroids): coarse (cell, v); centroids (cell, v, coarse), about ``lists``. ``base`` has (id, v). Fitted on
    about ``rows_per_list`` rows a list, drawn by a seeded hash of the id."""
    usable = base.where(vector_problem(F.col("v"), dim).isNull())
    n = usable.count()
    lists = max(1, min(int(lists), n))
    roots = math.isqrt(lists - 1) + 1 if lists > 1 else 1
    coarse = staged(fit_centroids(usable, n, roots, 256, seed, FIT_ITERATIONS), "coarse-centroids")
    one_in = max(1, n // (rows_per_list * lists))
    sample = usable.where(F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id")), F.lit(one_in)) == 0)
    sample = staged(with_cells(sample.select("id", "v"), coarse, dim, out_cell="coarse"), "coarse-sample")
    drawn = max(1, sample.count())
    share = lists / drawn
    # a group fits about 2 root(lists) lists on its share of rows
    groups = _salted(sample, max(1, math.ceil(2 * roots / share)), "id").select("coarse", "salt", "id", "v")

    def fit(tbl: pa.Table) -> pa.Table:
        tbl = tbl.sort_by("id")
        v, valid = K.vectors_from_arrow(tbl.column("v"), dim)
        v, ok = K.normalise(v, valid)
        v = v[ok]
        c = spherical_kmeans(v, max(1, round(share * len(v))), seed) if len(v) else v
        key = {k: tbl.column(k)[0].as_py() for k in ("coarse", "salt")}
        return pa.table({"coarse": pa.array([key["coarse"]] * len(c), pa.int32()), "salt": pa.array([key["salt"]] * len(c), pa.int32()),
                         "j": pa.array(range(len(c)), pa.int32()), "v": pa.array(list(c), pa.list_(pa.float64()))})

    ensure_shipped(base.sparkSession)
    fine = groups.groupBy("coarse", "salt").applyInArrow(fit, "coarse int, salt int, j int, v array<double>")
    number = F.row_number().over(Window.orderBy("coarse", "salt", "j")) - 1        # at most ``lists`` rows
    return coarse, staged(staged(fine, "fine-centroids").select(number.alias("cell"), "v", "coarse"), "centroids")


def assign_two_level(rows: DataFrame, coarse: DataFrame, centroids: DataFrame, dim: int) -> DataFrame:
    """(id, v, cell): each row's nearest fine centroid in its nearest coarse cell. Null and wrong-length vectors get no cell."""
    return assign_inside(staged(with_cells(rows.select("id", "v"), coarse, dim, out_cell="coarse"), "coarse-rows"), centroids, dim)


def assign_inside(near: DataFrame, centroids: DataFrame, dim: int) -> DataFrame:
    """(id, v, cell) of rows (id, v, coarse): the nearest of the centroids (cell, v, coarse) with the row's ``coarse``, which
    gets as many groups as its rows need. ``near`` is read several times."""
    spark = near.sparkSession
    lost = near.where(F.col("coarse").isNull()).select("id", "v", F.lit(None).cast("int").alias("cell"))
    dealt = _salted(near.where(F.col("coarse").isNotNull()), max(1, block_limit(spark) // max(1, dim * 8)), "id")
    salts = dealt.groupBy("coarse").agg(F.max("salts").alias("salts"))
    there = (centroids.join(F.broadcast(salts), "coarse")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("coarse", "salt", "cell", "v"))
    kind, dt = near.schema["v"].dataType.simpleString(), kernel_dtype(spark)

    def nearest(r: pa.Table, c: pa.Table) -> pa.Table:
        cv, valid = K.vectors_from_arrow(c.column("v"), dim)
        cn, ok = K.normalise(cv, valid)
        cell = np.full(r.num_rows, -1, np.int64)
        if len(cn) and r.num_rows:
            cell, _ = K.nearest_one(r.column("v").combine_chunks(), c.column("cell").to_numpy().astype(np.int64), cn, ok, dim, dtype=dt)
        return pa.table({"id": r.column("id"), "v": r.column("v"), "cell": pa.array(cell, pa.int32(), mask=cell < 0)})

    ensure_shipped(spark)
    found = (dealt.select("coarse", "salt", "id", "v").groupBy("coarse", "salt").cogroup(there.groupBy("coarse", "salt"))
             .applyInArrow(nearest, f"id long, v {kind}, cell int"))
    return found.unionByName(lost)


def probe_two_level(queries: DataFrame, index: IvfIndex, probes: int) -> DataFrame:
    """(query_id, cell, probe_rank): the nearest fine centroids in a query's nearest coarse cells, of which there are
    enough to hold ``probes`` lists on average, twice over."""
    spark = queries.sparkSession
    roots = index.coarse.count()
    wide = min(roots, max(COARSE_PROBES, math.ceil(2 * probes * roots / max(1, index.lists))))
    dim, dt = index.dim, kernel_dtype(spark)
    coarse = nearest_centroids(queries, index.coarse, wide, dim, "query_id", "v", out_cell="coarse")
    asked = coarse.select("query_id", "coarse").join(queries.select("query_id", "v"), "query_id")
    dealt = _salted(asked, max(1, block_limit(spark) // max(1, dim * 8 + probes * 16)), "query_id")     # vectors and kept cells
    salts = dealt.groupBy("coarse").agg(F.max("salts").alias("salts"))
    there = (index.centroids.join(F.broadcast(salts), "coarse")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
             .select("coarse", "salt", F.col("cell").cast("long").alias("id"), "v"))

    def nearest(q: pa.Table, c: pa.Table) -> pa.Table:
        return K.block_pair_topk(q, c, min(probes, c.num_rows), dim, "query_id", "v", "id", "v", dtype=dt)

    ensure_shipped(spark)
    found = (dealt.select("coarse", "salt", "query_id", "v").groupBy("coarse", "salt").cogroup(there.groupBy("coarse", "salt"))
             .applyInArrow(nearest, "query_id long, id long, distance double"))
    return rank_candidates(found, probes).select("query_id", F.col("id").cast("int").alias("cell"), F.col("rank").alias("probe_rank"))


def ivf_build_two_level(base: DataFrame, lists: int, seed: int = 42, rows_per_list: int = 64, id_col: str = "id",
                        vec_col: str = "v", dim: int | None = None) -> IvfIndex:
    """IVF index with two levels of cells (cosine); searched, stored and appended to like any other."""
    b = base.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    dim = dim or vector_dim(b, "v") or 0
    coarse, centroids = fit_two_level(b, lists, dim, seed, rows_per_list)
    cells = _layout(assign_two_level(b, coarse, centroids, dim), b.count(), dim)
    return IvfIndex(centroids, cells, lists=centroids.count(), dim=dim, coarse=coarse)
