"""Extraction of measurements from captured run output and plan text.

The inputs are tables of text (one run output per row, or one plan line per
row), so extraction is a distributed projection / aggregation, not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The line shapes of the load driver's summary and of the
# plan text, which must match what that tooling prints.
LATENCY_AVG_PATTERN = r"latency average = (\d+\.\d+) ms"
LATENCY_STDDEV_PATTERN = r"latency stddev = (\d+\.\d+) ms"
TPS_PATTERN = r"tps = (\d+\.\d+)"
TIMING_PATTERN = r"^Time: *([0-9.]+)"
PLAN_MARKER = " <=> "
BUFFERS_MARKER = "Buffers"
SHARED_HIT_PATTERN = r"shared hit=(\d+)"
READ_PATTERN = r"read=(\d+)"


def _first_number(text: Column, pattern: str) -> Column:
    """First match of ``pattern`` group 1 as double, NULL when absent."""
    s = F.regexp_extract(text, pattern, 1)
    return F.when(s == "", F.lit(None).cast("double")).otherwise(s.try_cast("double"))


def extract_run_metrics(df: DataFrame, text_col: str = "out") -> DataFrame:
    """Adds latency_average, latency_stddev, tps (double, NULL if not printed)."""
    t = F.col(text_col)
    return (df.withColumn("latency_average", _first_number(t, LATENCY_AVG_PATTERN))
              .withColumn("latency_stddev", _first_number(t, LATENCY_STDDEV_PATTERN))
              .withColumn("tps", _first_number(t, TPS_PATTERN)))


def extract_timing(df: DataFrame, text_col: str = "out") -> DataFrame:
    """Adds ``time_ms`` from the first line starting with ``Time:``."""
    line = F.regexp_extract(F.col(text_col), r"(?m)" + TIMING_PATTERN, 1)
    return df.withColumn("time_ms", F.when(line == "", F.lit(None).cast("double"))
                         .otherwise(line.try_cast("double")))


def extract_plan_buffers(lines: DataFrame, plan_col: str = "plan_id",
                         line_no: str = "line_no", text: str = "line") -> DataFrame:
    """Per plan: buffers of the first ``Buffers`` line after the first line
    holding the distance operator. Missing numbers are 0; a plan with no such
    line yields 0/0 as well (the search found nothing to report).

    Output: plan_id, shared_hit (bigint), disk_read (bigint).
    """
    t = F.col(text)
    # window and aggregate share one exchange by plan
    marker = F.min(F.when(t.contains(PLAN_MARKER), F.col(line_no))).over(Window.partitionBy(plan_col))
    after = (F.col(line_no) > F.col("_m")) & t.contains(BUFFERS_MARKER)
    buf = (lines.withColumn("_m", marker).groupBy(plan_col)
           .agg(F.min_by(F.when(after, t), F.when(after, F.col(line_no))).alias("_buf")))
    hit = F.regexp_extract(F.col("_buf"), SHARED_HIT_PATTERN, 1)
    rd = F.regexp_extract(F.col("_buf"), READ_PATTERN, 1)
    return buf.select(plan_col,
                      F.coalesce(F.when(hit != "", hit.cast("bigint")), F.lit(0).cast("bigint")).alias("shared_hit"),
                      F.coalesce(F.when(rd != "", rd.cast("bigint")), F.lit(0).cast("bigint")).alias("disk_read"))
