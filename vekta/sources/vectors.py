"""Vector and truth tables: CSV array literals in, typed DataFrames out.

A vector file holds one array literal per line (``{0.1,0.2,…}`` or
``[0.1, 0.2, …]``). Rows get positional ids 1, 2, 3… in file order unless
the source carries ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False),
                              T.StructField("v", T.ArrayType(T.FloatType(), False))])
TRUTH_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False),
                             T.StructField("indices", T.ArrayType(T.LongType()))])


def parse_array(text: Column, element: str) -> Column:
    """Array literal text -> array<element>. Braces become brackets and the
    text is lower-cased (``NULL`` -> ``null``) so one bad token does not null
    the whole array."""
    return F.from_json(F.lower(F.translate(F.trim(text), "{}", "[]")), f"array<{element}>")


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    # One quoted field per line; a ',' inside the literal must not split it.
    return (spark.read.option("header", "false").option("quote", '"').option("sep", "\u0001")
            .schema("s string").csv(path))


def with_positional_id(df: DataFrame, start: int = 1, col: str = "id") -> DataFrame:
    """Ids start, start+1, … in file order. The scanned rows are written once
    with their split (file, offset) and place; each split's row count, summed
    over the splits before it, is its offset. Nothing is sorted but one row
    per split, and no vector is shuffled unless the splits are too many to broadcast."""
    from ..plans.staging import staged
    rows = staged(df.withColumn("_f", F.col("_metadata.file_path"))
                  .withColumn("_b", F.col("_metadata.file_block_start"))
                  .withColumn("_r", F.monotonically_increasing_id()), "numbered")
    splits = rows.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_f", "_b")) - F.col("_n")
    out = rows.join(splits.withColumn("_off", before).drop("_n"), ["_f", "_b"])
    return (out.withColumn(col, F.col("_off") + F.col("_r") - F.col("_first") + F.lit(start))
            .drop("_f", "_b", "_r", "_first", "_off"))


def load_vectors(spark: SparkSession, path: str, start_id: int = 1) -> DataFrame:
    """(id, v array<float>) from a CSV file/folder of array literals."""
    raw = _read_lines(spark, path)
    parsed = raw.select(parse_array(F.col("s"), "float").alias("v"))
    return with_positional_id(parsed, start_id).select("id", "v")


def load_truth(spark: SparkSession, path: str, start_id: int = 1) -> DataFrame:
    """(id, indices array<bigint>) — neighbour ids nearest first."""
    raw = _read_lines(spark, path)
    parsed = raw.select(parse_array(F.col("s"), "bigint").alias("indices"))
    return with_positional_id(parsed, start_id).select("id", "indices")


def vector_problem(v: Column, dim: int) -> Column:
    """NULL when the vector is usable, else the reason."""
    has_null = F.exists(v, lambda x: x.isNull())
    norm0 = F.aggregate(v, F.lit(0.0).cast("double"),
                        lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(x.cast("double"), F.lit(0.0))) == 0
    return (F.when(v.isNull(), F.lit("null vector"))
            .when(F.size(v) != dim, F.lit("wrong dimension"))
            .when(has_null, F.lit("null element"))
            .when(norm0, F.lit("zero vector")))


def validate_vectors(df: DataFrame, dim: int, vec: str = "v", mode: str = "split"):
    """Cast to array<float> and check the dimension.

    mode='split' -> (good, rejected) with a ``problem`` column on rejects;
    mode='raise' -> good rows, failing the job on the first bad row;
    mode='tag'   -> all rows with ``problem`` (NULL = good).
    Zero vectors are kept by 'split'/'raise' (their distance is NaN), but tagged.
    """
    v = F.col(vec).cast("array<float>")
    tagged = df.withColumn(vec, v).withColumn("problem", vector_problem(F.col(vec), dim))
    if mode == "tag":
        return tagged
    hard = F.col("problem").isNotNull() & (F.col("problem") != "zero vector")
    if mode == "raise":
        # The check sits in a filter so the optimizer cannot prune it away.
        ok = F.when(hard, F.raise_error(F.concat(F.lit("invalid vector: "), F.col("problem")))) \
            .otherwise(F.lit(True))
        return tagged.where(ok).drop("problem")
    return tagged.where(~hard).drop("problem"), tagged.where(hard)


def ensure_table(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Create-if-missing load: write ``df`` to ``path`` unless a table with at
    least one row is already there; returns the table at ``path``. The row
    check reads one row (never a full count)."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # an unreadable table is an error, never a reason to overwrite it
    if fs.exists(where) and any(not st.getPath().getName().startswith(("_", ".")) for st in fs.listStatus(where)):
        existing = spark.read.format(fmt).load(path)
        if not existing.limit(1).isEmpty():
            return existing
    df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)
