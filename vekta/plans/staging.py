"""Materialised intermediate tables in the shared folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from ..session import scratch_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table under ``spark.checkpoint.dir`` and read it
    back. What reads the result twice sees the same rows twice, and a lost
    executor costs a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that ``staged`` returned and that nothing reads any more, and let Spark delete the shuffle files of
    jobs that are over, which it does once the JVM collects their plans. A loop that stages a table each round
    holds two of them and the shuffles of about one round, however many rounds it takes."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del df
    gc.collect()
    jvm.System.gc()
