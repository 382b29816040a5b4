"""recall@K of a search result against a ground-truth table.

Per query: hits = |set(truth[1:K]) ∩ set(found ids with rank <= K)|; with
``id_offset='best'`` the found ids are also tried shifted by -1 and the larger
overlap counts (truth files whose ids are one lower than the base ids).
recall = Σ hits / (#queries × K). The denominator counts every query, also
those that found fewer than K rows or nothing, or that have no truth row
(0 hits; reported in ``missing_truth``).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import overlap_size, shift_ids

# The K list the reference sweeps by default.
DEFAULT_K_VALUES = [1, 3, 5, 10, 20, 40, 80]


def _hits(found, truth, id_offset):
    if id_offset == "best":
        return F.greatest(overlap_size(truth, found), overlap_size(truth, shift_ids(found, -1)))
    if id_offset:
        return overlap_size(truth, shift_ids(found, int(id_offset)))
    return overlap_size(truth, found)


def per_query_hits(neighbours: DataFrame, truth: DataFrame, ks: Iterable[int],
                   id_offset: int | str = 0, by: Sequence[str] = ()) -> DataFrame:
    """(k, query_id, hits, has_truth) for every query with at least one found row.

    A found row of rank r counts for every K >= r (one generator, no join
    with the K list); each (query, K) group holds at most K ids.
    """
    ks = sorted({int(k) for k in ks})
    karr = F.array(*[F.lit(k) for k in ks])
    found = (neighbours.select(*by, "query_id", "id", "rank")
             .withColumn("k", F.explode(F.filter(karr, lambda x: x >= F.col("rank"))))
             .groupBy(*by, "k", "query_id").agg(F.collect_list("id").alias("found")))
    t = truth.select(F.col("id").alias("query_id"), F.col("indices"))
    j = found.join(t, "query_id", "left")
    return j.select(
        *by, "k", "query_id",
        _hits(F.col("found"), F.slice(F.coalesce(F.col("indices"), F.array().cast("array<bigint>")),
                                      1, F.col("k")), id_offset).cast("long").alias("hits"),
        F.col("indices").isNotNull().alias("has_truth"))


def recall_curve(neighbours: DataFrame, truth: DataFrame, n_queries: int,
                 ks: Iterable[int] = DEFAULT_K_VALUES, id_offset: int | str = 0,
                 by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """One row per K: (k, recall, hits, queries, missing_truth); with ``by``,
    one per group and K. ``groups`` lists the groups, also those that found nothing
    (default: the ones in ``neighbours``).

    ``neighbours`` holds (query_id, id, rank) searched once at max(ks).
    ``n_queries`` is the number of issued queries (the denominator).
    """
    spark = neighbours.sparkSession
    ks = sorted({int(k) for k in ks})
    h = per_query_hits(neighbours, truth, ks, id_offset, by)
    agg = h.groupBy(*by, "k").agg(F.sum("hits").alias("hits"),
                             F.sum(F.when(~F.col("has_truth"), 1).otherwise(0)).alias("missing_truth"))
    if by:
        # every group has a row for each K; finding nothing is recall 0
        karr = F.array(*[F.lit(k) for k in ks])
        groups = neighbours.select(*by) if groups is None else groups.select(*by)
        every = groups.distinct().withColumn("k", F.explode(karr))
        agg = every.join(agg, [*by, "k"], "left").fillna(0, ["hits", "missing_truth"])
        return agg.select(*by, F.col("k").cast("long").alias("k"),
                          (F.col("hits").cast("double") / F.lit(float(n_queries)) / F.col("k")).alias("recall"),
                          F.col("hits").cast("long").alias("hits"),
                          F.lit(n_queries).cast("long").alias("queries"),
                          F.col("missing_truth").cast("long").alias("missing_truth"))
    kdf = spark.createDataFrame([(k,) for k in ks], "k int")
    return (kdf.join(F.broadcast(agg), "k", "left")
            .select(F.col("k").cast("long").alias("k"),
                    (F.coalesce(F.col("hits"), F.lit(0)).cast("double") / F.lit(float(n_queries)) / F.col("k"))
                    .alias("recall"),
                    F.coalesce(F.col("hits"), F.lit(0)).cast("long").alias("hits"),
                    F.lit(n_queries).cast("long").alias("queries"),
                    F.coalesce(F.col("missing_truth"), F.lit(0)).cast("long").alias("missing_truth")))


def recall_at_k(neighbours: DataFrame, truth: DataFrame, n_queries: int, k: int,
                id_offset: int | str = 0) -> DataFrame:
    """Single-K recall; same columns as ``recall_curve``."""
    return recall_curve(neighbours, truth, n_queries, [k], id_offset)
