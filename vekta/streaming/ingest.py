"""Continuous vector ingest: a file stream of new vectors is assigned to the
fixed centroids of an index and
appended batch by batch. Each micro-batch is written under its batch id with
overwrite, so a replay after a failure rewrites the same folder instead of
adding duplicates; the checkpoint records which batches are done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import assigned, unknown_ids
from ..operators.ivf import IvfIndex, with_cells


def assign_stream(index: IvfIndex, stream: DataFrame, id_col: str = "id",
                  vec_col: str = "v", event_time: str | None = None,
                  dedupe_within: str | None = None) -> DataFrame:
    """Streaming DataFrame (id, v, cell[, event_time]). With ``event_time``
    and ``dedupe_within`` duplicate ids are dropped inside the watermark."""
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")]
    if event_time:
        cols.append(F.col(event_time))
    s = stream.select(*cols)
    if event_time and dedupe_within:
        s = s.withWatermark(event_time, dedupe_within).dropDuplicatesWithinWatermark(["id"])
    return with_cells(s, index.centroids, index.dim)


def ingest_stream(index: IvfIndex, stream: DataFrame, out_path: str, checkpoint: str,
                  id_col: str = "id", vec_col: str = "v", trigger_available_now: bool = True, distinct_ids: bool = False):
    """Start the ingest query; returns the StreamingQuery. The appended rows
    land in ``out_path/batch=<id>``; ``read_ingested`` reads them back. A batch
    is assigned as a table, so centroids above the broadcast limit and indexes
    with two levels of cells work as in a batch append. ``distinct_ids`` leaves
    out ids that the index or an earlier batch holds, whenever they came (the
    state is the written batches themselves, without a watermark); a replayed
    batch sees the batches before it only, so it keeps the same rows."""
    spark = stream.sparkSession
    rows = stream.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))

    def write(batch: DataFrame, batch_id: int) -> None:
        if distinct_ids:
            held = index.cells.select("id")
            if _has_batches(spark, out_path):
                earlier = spark.read.schema("id long, batch long").parquet(out_path).where(F.col("batch") < batch_id)
                held = held.unionByName(earlier.select("id"))
            batch = unknown_ids(batch, held)
        assigned(index, batch).select("id", "v", "cell").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    w = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w
    return w.start()


def _has_batches(spark, out_path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_path}/batch=*")
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def read_ingested(spark, out_path: str) -> DataFrame:
    return spark.read.parquet(out_path).drop("batch")
