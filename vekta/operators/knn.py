"""Exact nearest neighbours: single query, bulk kNN join, truth building,
neighbour lists, seeded query samples and point-query workloads.

Plan shape of ``knn_join`` (broadcast path)::

    Scan base [id, v]  ->  MapInArrow(kernel: <= k rows per query per task)
      -> WindowGroupLimit(partial) -> Exchange(query_id) -> Sort
      -> WindowGroupLimit(final) -> Window(row_number) -> Filter(rank <= k)

The base is never shuffled; only (query_id, id, distance) candidates move,
at most k per query per task. When the query side is larger than the
broadcast limit the grid path shuffles both sides into bounded
(query block x base block) groups instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ensure_shipped
from ..plans.staging import staged
from ..plans.sizing import (BroadcastBlock, BroadcastTooLarge, dealt, grid_partitions, grid_shape, kernel_dtype,
                            query_limit, vector_dim)
from . import kernel as K

CANDIDATES_DDL = "query_id long, id long, distance double"
NEIGHBOURS_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("distance", T.DoubleType()), T.StructField("rank", T.LongType())])


def _prep(df: DataFrame, id_col: str, vec_col: str, out_id: str = "id") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(out_id), F.col(vec_col).alias("v"))


def _empty(spark) -> DataFrame:
    return spark.createDataFrame([], NEIGHBOURS_SCHEMA)


def rank_candidates(cands: DataFrame, k: int, key: str | list[str] = "query_id") -> DataFrame:
    """Global top-k per key over partial candidates, ties by id, NaN last.

    ``row_number() <= k`` is planned as WindowGroupLimit partial/final, so
    each task forwards at most k rows per key before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(F.col("distance").asc_nulls_last(), F.col("id").asc())
    return (cands.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("long")))


def _query_block(queries: DataFrame, dim: int, k: int) -> BroadcastBlock:
    spark = queries.sparkSession
    return BroadcastBlock.collect(queries, "query_id", "v", dim, query_limit(spark, dim, k))


def exact_candidates(queries: DataFrame, base: DataFrame, k: int, dim: int,
                     counts: bool = False) -> DataFrame:
    """Partial top-k candidates (query_id, id, distance); size-checked
    broadcast of the query side, grid path above the limit.

    ``queries`` has (query_id, v); ``base`` has (id, v).
    With ``counts=True`` returns (query_id, examined) partial counts instead.
    """
    spark = queries.sparkSession
    try:
        block = _query_block(queries, dim, k)
    except BroadcastTooLarge:
        return _grid_candidates(queries, base, k, dim, queries.count(), counts)
    valid = block.extra["_valid"]
    qids, qn = block.ids[valid], block.matrix[valid]
    qn, q_ok = K.normalise(qn)
    bc = spark.sparkContext.broadcast((qids, qn, q_ok))
    dt = kernel_dtype(spark)

    def run(batches):
        ids, m, ok = bc.value
        yield from K.exact_topk_partition(batches, ids, m, ok, k, dim, "id", "v", dtype=dt, counts=counts)
    schema = "query_id long, examined long" if counts else CANDIDATES_DDL
    ensure_shipped(spark)
    return base.mapInArrow(run, schema)


def _grid_candidates(queries: DataFrame, base: DataFrame, k: int, dim: int, nq: int,
                     counts: bool) -> DataFrame:
    """Shuffle path for query sets above the broadcast limit.

    Query blocks (qb) x base blocks (bb): each query row is replicated to the
    NB base blocks and each base row to the QB query blocks, so every group
    (qb, bb) holds at most one bounded block of each side. Hash bucketing by
    id keeps groups even whatever the id distribution. Groups are numbered and
    dealt by number, so no task gets two while another gets none.
    """
    spark = queries.sparkSession
    nb = base.count()
    qb_n, bb_n = grid_shape(spark, nq, nb, dim, 0 if counts else k)
    dt = kernel_dtype(spark)
    parts = grid_partitions(qb_n * bb_n)
    group = (F.col("qb") * F.lit(bb_n) + F.col("bb")).cast("int").alias("block")
    qg = (dealt(queries, nq, bb_n, dim).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb_n)))
          .withColumn("bb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bb_n - 1).cast("long"))))
          .select(group, "query_id", "v").repartitionById(parts, "block"))
    bg = (dealt(base, nb, qb_n, dim).withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(bb_n)))
          .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb_n - 1).cast("long"))))
          .select(group, "id", "v").repartitionById(parts, "block"))

    def pair(qt, bt):
        if counts:
            import pyarrow as pa
            qids = qt.column("query_id").to_numpy()
            _, ok = K.vectors_from_arrow(bt.column("v"), dim)
            return pa.table({"query_id": pa.array(qids, pa.int64()),
                             "examined": pa.array(np.full(len(qids), int(ok.sum())), pa.int64())})
        return K.block_pair_topk(qt, bt, k, dim, "query_id", "v", "id", "v", dtype=dt)
    schema = "query_id long, examined long" if counts else CANDIDATES_DDL
    ensure_shipped(spark)
    return qg.groupBy("block").cogroup(bg.groupBy("block")).applyInArrow(pair, schema)


def knn_join(queries: DataFrame, base: DataFrame, k: int, *, query_id: str = "id",
             query_vec: str = "v", base_id: str = "id", base_vec: str = "v",
             dim: int | None = None) -> DataFrame:
    """Exact k nearest base rows for every query row (cosine distance).

    Returns (query_id, id, distance, rank): rank 1..k by (distance, id).
    Queries whose vector is NULL or of the wrong length get no rows; k > N
    returns N rows per query; k = 0 returns no rows.
    """
    spark = queries.sparkSession
    q = _prep(queries, query_id, query_vec, "query_id")
    b = _prep(base, base_id, base_vec)
    if dim is None:
        dim = vector_dim(q, "v")
    if dim is None or k <= 0:
        return _empty(spark)
    return merge_topk(exact_candidates(q, b, k, dim), k, source=b)


# Above this many candidate partitions the merge goes through an
# intermediate level, so no final group holds more than ~sqrt(P) x k rows.
TREE_MERGE_PARTITIONS = 1024


def scan_tasks(df: DataFrame) -> int:
    """About how many tasks a scan of ``df`` takes, from the planner's size
    estimate alone (nothing runs)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m")
    per_task = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(split)
    return max(1, size // max(1, per_task))


def merge_topk(cands: DataFrame, k: int, key: str = "query_id", source: DataFrame | None = None) -> DataFrame:
    """Global top-k per key over per-task partial top-k lists. With P tasks a
    key's final group would hold P x k rows; for large P (estimated from the
    scanned ``source``) an intermediate merge by (key, task mod sqrt(P))
    bounds every group to ~sqrt(P) x k."""
    import math
    parts = scan_tasks(cands if source is None else source)
    if parts <= TREE_MERGE_PARTITIONS:
        return rank_candidates(cands, k, key)
    fan = int(math.ceil(math.sqrt(parts)))
    mid = rank_candidates(cands.withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(fan))),
                          k, [key, "_g"])
    return rank_candidates(mid.drop("_g", "rank"), k, key)


def knn(base: DataFrame, query: DataFrame, k: int, *, query_id: str = "id",
        query_vec: str = "v", base_id: str = "id", base_vec: str = "v",
        payload: bool = True) -> DataFrame:
    """Single-query kNN (the ``ORDER BY v <=> q LIMIT k`` form): ``query`` is a
    DataFrame that selects the query row(s), e.g. ``queries.where(id == 7)``.
    An unknown id yields no rows. With ``payload`` the base vector is joined
    back for the k winners only (the distance pass carries ids alone)."""
    out = knn_join(query, base, k, query_id=query_id, query_vec=query_vec,
                   base_id=base_id, base_vec=base_vec)
    if not payload:
        return out
    vecs = base.select(F.col(base_id).cast("long").alias("id"), F.col(base_vec).alias("v"))
    return out.join(vecs, "id").select("query_id", "id", "v", "distance", "rank")


def neighbour_lists(neighbours: DataFrame, out_col: str = "base_ids") -> DataFrame:
    """(query_id, [ids nearest first]); each group holds at most k rows."""
    srt = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("id"))))
    return (neighbours.groupBy("query_id")
            .agg(F.transform(srt, lambda s: s["id"]).alias(out_col)))


def build_truth(queries: DataFrame, base: DataFrame, k: int, **cols) -> DataFrame:
    """Exact ground truth: (id, indices) with the k nearest ids, nearest first."""
    nb = knn_join(queries, base, k, **cols)
    return neighbour_lists(nb, "indices").withColumnRenamed("query_id", "id")


def sample_queries(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Seeded, reproducible 'ORDER BY random() LIMIT n': order by
    md5('<seed>:<id>') (planned as TakeOrderedAndProject, no full sort)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.orderBy(key, F.col(id_col)).limit(n)


def hash_draw(seed: int, col) -> "F.Column":
    """Deterministic 60-bit draw from md5('<seed>:<col>')."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def with_positions(df: DataFrame, order_col: str, out: str = "pos") -> DataFrame:
    """0-based position in ``order_col`` order without a single-partition
    window: range-sort, number rows inside each partition, then add the
    running total of the partition sizes (one row per partition). The sorted
    rows are written once, and sizes and positions come from that one table:
    two sorts of the same rows need not draw the same partition bounds."""
    srt = staged(df.orderBy(order_col)
                 .withColumn("_p", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id()), "positions")
    sizes = srt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_p").cast("long"), 33)
    return (srt.join(offs, "_p")
            .withColumn(out, F.col("_off") + local)
            .drop("_p", "_mid", "_off"))


def point_workload(queries: DataFrame, base: DataFrame, k: int, t: int | None = None,
                   seed: int = 42, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """Random point-query workload: t transactions, each a uniform draw among
    the existing query ids (md5-seeded), answered by one kNN join over the
    distinct drawn ids. Returns (txn, query_id, id, distance, rank)."""
    spark = queries.sparkSession
    pos = with_positions(queries.select(id_col), id_col)
    n = pos.count()
    if t is None:
        t = n
    txns = (spark.range(t).withColumnRenamed("id", "txn")
            .withColumn("pos", F.pmod(hash_draw(seed, F.col("txn")), F.lit(n))))
    drawn = txns.join(pos, "pos").select("txn", F.col(id_col).cast("long").alias("query_id"))
    wanted = queries.join(drawn.select(F.col("query_id").alias(id_col)).distinct(), id_col, "left_semi")
    res = knn_join(wanted, base, k, query_id=id_col, query_vec=vec_col)
    return drawn.join(res, "query_id").select("txn", "query_id", "id", "distance", "rank")
