"""Attach the values of a one-row aggregate to every row of another
DataFrame as a scalar subquery (evaluated once, shipped as a value) —
not as a join, which Catalyst would plan as a nested-loop join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or one_row.columns
    s = one_row.select(F.struct(*cols).alias("_s")).scalar()
    for c in cols:
        df = df.withColumn(c, s[c])
    return df
