"""Measurement summaries: mean / sample stddev, latency and throughput of a
request log, rolling windows, index size statistics, build records.

All are grouped aggregations with partial (map-side) aggregation; a group
holding a third of the rows costs one partial row per task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarize(df: DataFrame, value: str, by: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """count, mean and *sample* stddev (NULL when count = 1) of ``value``."""
    p = prefix or value
    aggs = [F.count(F.col(value)).cast("long").alias(f"{p}_count"),
            F.avg(value).alias(f"{p}_mean"),
            F.stddev_samp(value).alias(f"{p}_stddev")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def span_seconds(ts: Column | str) -> Column:
    """max(ts) - min(ts) in seconds (aggregate expression)."""
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")
    return (F.unix_micros(F.max(c)) - F.unix_micros(F.min(c))).cast("double") / F.lit(1e6)


def latency_summary(log: DataFrame, by: Sequence[str] = (), ts: str = "ts",
                    latency: str = "value") -> DataFrame:
    """Per run: requests, latency average / sample stddev (ms) and throughput
    (requests per second over the run's time span; NULL when the span is 0)."""
    span = span_seconds(ts)
    aggs = [F.count(F.lit(1)).cast("long").alias("requests"),
            F.avg(latency).alias("latency_average"),
            F.stddev_samp(latency).alias("latency_stddev"),
            F.when(span > 0, F.count(F.lit(1)) / span).alias("tps")]
    return log.groupBy(*by).agg(*aggs) if by else log.agg(*aggs)


def latency_windows(log: DataFrame, duration: str = "5 seconds", by: Sequence[str] = (),
                    ts: str = "ts", latency: str = "value",
                    watermark: str | None = None) -> DataFrame:
    """Tumbling-window progress metrics (batch or stream). With ``watermark``
    rows later than the watermark are dropped by the streaming engine."""
    src = log
    if watermark:
        # event-time watermarks need TIMESTAMP (session time zone), not NTZ
        ntz = log.schema[ts].dataType.typeName() == "timestamp_ntz"
        src = log.withColumn(ts, F.col(ts).cast("timestamp")) if ntz else log
        src = src.withWatermark(ts, watermark)
    return (src.groupBy(F.window(ts, duration).alias("w"), *by)
            .agg(F.count(F.lit(1)).cast("long").alias("requests"),
                 F.avg(latency).alias("latency_average"),
                 F.stddev_samp(latency).alias("latency_stddev"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *by, "requests", "latency_average", "latency_stddev"))


def index_stats(cells: DataFrame, centroids: DataFrame | None = None,
                edges: DataFrame | None = None, vec: str = "v") -> DataFrame:
    """Rows, payload bytes (4 per float + 8 per id), cells and per-cell row
    spread of an IVF index; edges of a graph index. One row."""
    cols = [F.count(F.lit(1)).cast("long").alias("rows"),
            F.sum(F.size(vec) * 4 + 8).cast("long").alias("payload_bytes")]
    out = cells.agg(*cols)
    if "cell" in cells.columns:
        per = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
        spread = per.agg(F.count(F.lit(1)).cast("long").alias("cells"),
                         F.min("_n").cast("long").alias("min_cell_rows"),
                         F.max("_n").cast("long").alias("max_cell_rows"),
                         F.avg("_n").alias("mean_cell_rows"))
        out = _one_row_combine(out, spread)
    if centroids is not None:
        out = _one_row_combine(out, centroids.agg(
            F.sum(F.size("v") * 8 + 4).cast("long").alias("centroid_bytes")))
    if edges is not None:
        out = _one_row_combine(out, edges.agg(F.count(F.lit(1)).cast("long").alias("edges")))
    return out


def _one_row_combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side combination of two single-row aggregates: the columns of
    ``b`` arrive as a scalar subquery (no join)."""
    from ..plans.scalars import attach_scalars
    return attach_scalars(a, b)


def files_bytes(df: DataFrame) -> DataFrame:
    """On-disk bytes of a file-backed DataFrame from its file metadata."""
    return (df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
            .distinct().agg(F.sum("s").cast("long").alias("disk_bytes")))


def build_summary(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Build records (latency_ms, size_bytes per rebuild) -> means, and sample
    stddevs when there is more than one rebuild."""
    aggs = [F.count(F.lit(1)).cast("long").alias("builds"),
            F.avg("latency_ms").alias("latency_average"),
            F.stddev_samp("latency_ms").alias("latency_stddev"),
            F.avg("size_bytes").alias("size_average"),
            F.stddev_samp("size_bytes").alias("size_stddev")]
    return records.groupBy(*by).agg(*aggs) if by else records.agg(*aggs)
