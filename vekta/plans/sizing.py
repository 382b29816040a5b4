"""Size checks that decide between a broadcast plan and a shuffle plan.

Every broadcast in vekta goes through ``BroadcastBlock``: the side is counted
first, its in-memory size is bounded (rows x dim x 8 bytes), and only a side
under the limit is collected and shipped to executors. Above the limit the
caller takes the shuffle (grid) path instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
DEFAULT_QUERY_BYTES = 8 * 1024 * 1024
DEFAULT_BLOCK_BYTES = 64 * 1024 * 1024
# Least rows of a block that is made smaller only so that all cores have work.
SMALL_QUERY_BLOCK, SMALL_BLOCK = 8192, 4096
GROUPS_PER_CORE = 3
MOST_PARTITIONS = 8192


def kernel_dtype(spark: SparkSession):
    """float64 (default; distances agree with SQL engines to the last digit
    that is compared) or float32 (``vekta.kernel.precision=single``: about
    twice the matmul throughput and half the memory per block)."""
    v = (spark.conf.get("vekta.kernel.precision", None) or "double").lower()
    return np.float32 if v in ("single", "float", "float32") else np.float64


def broadcast_limit(spark: SparkSession) -> int:
    v = spark.conf.get("vekta.broadcast.maxBytes", None)
    return int(v) if v else DEFAULT_BROADCAST_BYTES


def query_limit(spark: SparkSession, dim: int, kept: int) -> int:
    """Bytes of query vectors to broadcast when a task also keeps ``kept``
    (distance, id) pairs for each query: vectors and pairs together stay
    within the broadcast limit, or DEFAULT_QUERY_BYTES where none is set: every
    task keeps pairs for all queries and meets them all, so a larger set is dealt out in blocks."""
    set_limit = spark.conf.get("vekta.broadcast.maxBytes", None)
    return max(1, (int(set_limit) if set_limit else DEFAULT_QUERY_BYTES) * int(dim) // (int(dim) + 2 * max(0, int(kept))))


def block_limit(spark: SparkSession) -> int:
    v = spark.conf.get("vekta.block.maxBytes", None)
    return int(v) if v else DEFAULT_BLOCK_BYTES


def vector_dim(df: DataFrame, vec_col: str) -> int | None:
    """The length that most vectors have (the larger of two that tie), so a
    malformed row never decides. Reads one column; pass ``dim`` where it is known."""
    r = (df.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count()
         .orderBy(F.desc("count"), F.desc("d")).first())
    return None if r is None else int(r["d"])


def vector_bytes(rows: int, dim: int) -> int:
    return int(rows) * int(dim) * 8


def grid_shape(spark: SparkSession, queries: int, rows: int, dim: int, kept: int) -> tuple[int, int]:
    """(query blocks, row blocks) of an all-pairs job. Each side of a group fits a bounded block (queries with the ``kept``
    pairs they hold), so no task grows with the tables; small tables are cut further until every core has some groups."""
    dim, kept, limit = max(1, int(dim)), max(0, int(kept)), block_limit(spark)
    most_queries, most_rows = max(1, limit // 2 // (8 * dim + 16 * kept)), max(1, limit // (8 * dim))
    qb, bb = max(1, math.ceil(queries / most_queries)), max(1, math.ceil(rows / most_rows))
    while qb * bb < GROUPS_PER_CORE * spark.sparkContext.defaultParallelism:
        if queries / qb >= 2 * SMALL_QUERY_BLOCK:
            qb *= 2
        elif rows / bb >= 2 * SMALL_BLOCK:
            bb *= 2
        elif queries / qb >= 2 * SMALL_BLOCK // 4:
            qb *= 2
        else:
            break
    return qb, bb


def grid_partitions(groups: int) -> int:
    """Shuffle partitions for ``groups`` groups that are numbered from 0 and dealt by number: one a task, as long as that many tasks are sound."""
    return max(1, min(int(groups), MOST_PARTITIONS))


def dealt(df: DataFrame, rows: int, copies: int, dim: int) -> DataFrame:
    """The ``rows`` rows of ``df``, dealt to tasks that send about a block each when every row goes out in ``copies`` copies.
    Otherwise a table of one file and row group would be copied by one task, whose work grows with both tables."""
    if copies <= 1:
        return df
    spark = df.sparkSession
    blocks = math.ceil(int(rows) * int(copies) * max(1, int(dim)) * 4 / block_limit(spark))
    return df.repartition(min(max(spark.sparkContext.defaultParallelism, blocks), MOST_PARTITIONS))


@dataclass
class BroadcastBlock:
    """A size-checked block of vectors shipped to every task."""
    ids: np.ndarray
    matrix: np.ndarray
    extra: dict

    @staticmethod
    def collect(df: DataFrame, id_col: str, vec_col: str, dim: int,
                limit: int, extra_cols: tuple[str, ...] = ()) -> "BroadcastBlock":
        """Collect at most ``limit`` bytes of vectors: one job that fetches
        ``max_rows + 1`` rows and refuses the block when the extra row came
        back, so the bound holds whatever the size of ``df``."""
        from ..operators.kernel import vectors_from_arrow
        max_rows = max(1, int(limit) // max(1, int(dim) * 8))
        tbl: pa.Table = df.select(id_col, vec_col, *extra_cols).limit(max_rows + 1).toArrow()
        if tbl.num_rows > max_rows:
            raise BroadcastTooLarge(tbl.num_rows, dim, limit)
        ids = tbl.column(id_col).to_numpy().astype(np.int64)
        m, valid = vectors_from_arrow(tbl.column(vec_col), dim)
        extra = {c: tbl.column(c).to_numpy(zero_copy_only=False) for c in extra_cols}
        extra["_valid"] = valid
        return BroadcastBlock(ids, m, extra)


class BroadcastTooLarge(Exception):
    def __init__(self, rows: int, dim: int, limit: int):
        super().__init__(f"more than {rows - 1} vectors x {dim} dims exceed broadcast limit {limit} bytes")
        self.rows, self.dim, self.limit = rows, dim, limit
