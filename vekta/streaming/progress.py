"""Rolling progress metrics over a stream of request events.

Windowed aggregation with a watermark: rows later than the watermark are
dropped by the engine. Results are written per micro-batch (update mode) to
``out/batch=<id>``; a replayed batch overwrites its own folder. The latest
row per window across batches is the current value (``read_progress``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metrics import latency_windows


def source_stream(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """Stream the Parquet files of one table in a folder as they appear. The table is a folder of files
    (``<table>.parquet/…`` or ``<table>/…``, whatever their names), else the files ``<table>*.parquet``."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    for name in (f"{table}.parquet", table):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.getFileStatus(path).isDirectory():
            return reader.option("pathGlobFilter", "*.parquet").parquet(path.toString())
    return reader.option("pathGlobFilter", f"{table}*.parquet").parquet(folder)


def start_progress(stream: DataFrame, out_path: str, checkpoint: str, duration: str = "5 seconds",
                   by: Sequence[str] = (), ts: str = "ts", latency: str = "value",
                   watermark: str = "10 minutes", available_now: bool = True,
                   state_partitions: int | None = None):
    """``state_partitions`` sizes the aggregation state (it is fixed in the
    checkpoint when the query first starts); default: the session's shuffle
    partitions."""
    agg = latency_windows(stream, duration, by, ts, latency, watermark=watermark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    w = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    if state_partitions is None:
        return w.start()
    spark = stream.sparkSession
    key = "spark.sql.shuffle.partitions"
    prev = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return w.start()
    finally:
        spark.conf.set(key, prev)


def read_progress(spark: SparkSession, out_path: str, by: Sequence[str] = ()) -> DataFrame:
    """Latest value per (window, keys) over all written batches."""
    r = spark.read.parquet(out_path)
    w = Window.partitionBy("window_start", *by).orderBy(F.col("batch").desc())
    return r.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "batch")
