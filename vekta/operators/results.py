"""Results store: a long table of measurements keyed by
(metric_type, extension, index_params, dataset, n, k), with upsert,
point/batch lookup, distinct parameter sets, pivots and comparisons.

Plain Parquet has no MERGE; the upsert is a DataFrame rewrite
(old ⋉̸ new ∪ new, keeping first ``id``/``created_at``) written as a new
version directory (see ``vekta.sources.catalog.ResultsStore``).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["metric_type", "extension", "index_params", "dataset", "n", "k"]
VALUE_COLS = ["extension", "index_params", "dataset", "n", "k", "metric_type",
              "metric_value", "out", "err"]

RESULTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("extension", T.StringType()),
    T.StructField("index_params", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("k", T.LongType()),
    T.StructField("out", T.StringType()),
    T.StructField("err", T.StringType()),
    T.StructField("metric_type", T.StringType()),
    T.StructField("metric_value", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
])

# Metric names used by the reference's results table.
METRIC_SELECT_LATENCY = "select latency (ms)"
METRIC_SELECT_LATENCY_STDDEV = "select latency (stddev ms)"
METRIC_SELECT_TPS = "select tps"
METRIC_RECALL_AFTER_INSERT = "recall (after insert)"
METRIC_RECALL_AFTER_CREATE = "recall (after create)"
METRIC_BUFFER_SHARED_HIT_COUNT = "buffer shared hits"
METRIC_BUFFER_SHARED_HIT_COUNT_STDDEV = "buffer shared hits (stddev)"
METRIC_BUFFER_READ_COUNT = "buffer disk reads"
METRIC_BUFFER_READ_COUNT_STDDEV = "buffer disk reads (stddev)"
METRIC_SELECT_BULK_LATENCY = "select bulk latency (ms)"
METRIC_SELECT_BULK_LATENCY_STDDEV = "select bulk latency (stddev ms)"
METRIC_SELECT_BULK_TPS = "select bulk tps"
METRIC_BUFFER_BULK_SHARED_HIT_COUNT = "bulk buffer shared hits"
METRIC_BUFFER_BULK_SHARED_HIT_COUNT_STDDEV = "bulk buffer shared hits (stddev)"
METRIC_BUFFER_BULK_READ_COUNT = "bulk buffer disk reads"
METRIC_BUFFER_BULK_READ_COUNT_STDDEV = "bulk buffer disk reads (stddev)"
METRIC_INSERT_LATENCY = "insert latency (ms)"
METRIC_INSERT_LATENCY_STDDEV = "insert latency (stddev ms)"
METRIC_INSERT_TPS = "insert tps"
METRIC_INSERT_BULK_LATENCY = "insert bulk latency (ms)"
METRIC_INSERT_BULK_LATENCY_STDDEV = "insert bulk latency (stddev ms)"
METRIC_INSERT_BULK_TPS = "insert bulk tps"
METRIC_DISK_USAGE = "disk usage (bytes)"
METRIC_DISK_USAGE_STDDEV = "disk usage (stddev bytes)"
METRIC_CREATE_LATENCY = "create latency (ms)"
METRIC_CREATE_LATENCY_STDDEV = "create latency (stddev ms)"

# Metric direction sets of the reference.
METRICS_THAT_SHOULD_DECREASE = [
    METRIC_SELECT_LATENCY, METRIC_SELECT_BULK_LATENCY, METRIC_INSERT_LATENCY,
    METRIC_INSERT_BULK_LATENCY, METRIC_DISK_USAGE, METRIC_CREATE_LATENCY,
]
METRICS_THAT_SHOULD_INCREASE = [
    METRIC_SELECT_TPS, METRIC_SELECT_BULK_TPS, METRIC_INSERT_TPS, METRIC_INSERT_BULK_TPS,
    METRIC_RECALL_AFTER_CREATE, METRIC_RECALL_AFTER_INSERT,
]


# The metrics of each report, in its column order.
REPORT_METRICS = {
    "build": [METRIC_CREATE_LATENCY, METRIC_CREATE_LATENCY_STDDEV, METRIC_DISK_USAGE, METRIC_DISK_USAGE_STDDEV],
    "insert": [METRIC_INSERT_TPS, METRIC_INSERT_LATENCY, METRIC_INSERT_LATENCY_STDDEV],
    "insert bulk": [METRIC_INSERT_BULK_TPS, METRIC_INSERT_BULK_LATENCY, METRIC_INSERT_BULK_LATENCY_STDDEV],
}


def conform(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Fill missing optional columns (k=0, out/err NULL, created_at=now)."""
    now = F.current_timestamp() if now is None else now
    cols = set(df.columns)
    out = []
    for f in RESULTS_SCHEMA.fields:
        if f.name in cols:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "k":
            out.append(F.lit(0).cast("long").alias("k"))
        elif f.name == "created_at":
            out.append(now.cast("timestamp").alias("created_at"))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def dedupe_last(batch: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order_col`` (last write
    wins). Without an order a key must not repeat; the job fails if one does.

    ``row_number() = 1`` plans as WindowGroupLimit, so even a key holding a
    third of the batch is reduced map-side before the shuffle."""
    if order_col is None:
        rest = [c for c in batch.columns if c not in KEY]
        one = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
        unique = F.when(F.col("_n") > 1, F.raise_error(F.lit("a result key repeats: order_col has to say which row is the last")).cast("boolean")).otherwise(F.lit(True))
        return one.where(unique).select(*[F.col(c) if c in KEY else F.col(f"_row.{c}").alias(c) for c in batch.columns])
    w = Window.partitionBy(*KEY).orderBy(F.col(order_col).desc_nulls_last())
    return batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _key_text() -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY])


def results_table(batch: DataFrame, order_col: str | None = None,
                  now: Column | None = None) -> DataFrame:
    """A fresh results table from a batch: deduplicated by key, ids 1..n in
    key order."""
    from .knn import with_positions
    b = conform(dedupe_last(batch, order_col).withColumn("id", F.lit(0).cast("long")), now)
    return (with_positions(b.withColumn("_key", _key_text()), "_key")
            .withColumn("id", F.col("pos") + 1).drop("pos", "_key")
            .select(*[f.name for f in RESULTS_SCHEMA.fields]))


def upsert_results(old: DataFrame, new: DataFrame, order_col: str | None = None,
                   now: Column | None = None) -> DataFrame:
    """INSERT … ON CONFLICT (key) DO UPDATE: every value column comes from the
    new row; ``id`` and ``created_at`` keep their first value; brand-new keys
    get ids after the current maximum, in key order."""
    from .knn import with_positions
    o = conform(old) if "created_at" not in old.columns or "id" not in old.columns else old
    nb = dedupe_last(new, order_col)
    nb = conform(nb.withColumn("id", F.lit(0).cast("long")), now)
    keep_old = o.join(nb.select(*KEY), KEY, "left_anti")
    firsts = o.select(*KEY, F.col("id").alias("_old_id"), F.col("created_at").alias("_old_ts"))
    merged = nb.join(firsts, KEY, "left")
    fresh = merged.where(F.col("_old_id").isNull()).select(*KEY)
    # current maximum id as a scalar subquery (the plan stays lazy, no join)
    max_id = o.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_max")).scalar()
    fresh_ids = (with_positions(fresh.withColumn("_key", _key_text()), "_key")
                 .select(*KEY, (max_id + F.col("pos") + 1).alias("_new_id")))
    upd = (merged.join(fresh_ids, KEY, "left")
           .withColumn("id", F.coalesce("_old_id", "_new_id"))
           .withColumn("created_at", F.coalesce("_old_ts", "created_at"))
           .select(*[f.name for f in RESULTS_SCHEMA.fields]))
    return keep_old.select(*[f.name for f in RESULTS_SCHEMA.fields]).unionByName(upd)


def lookup_result(results: DataFrame, keys: DataFrame) -> DataFrame:
    """Batch point lookup: for every key row, its metric_value or 0.0 when
    absent (k NULL means 0)."""
    kk = keys.withColumn("k", F.coalesce(F.col("k").cast("long"), F.lit(0).cast("long")))
    r = results.select(*KEY, "metric_value")
    return (kk.join(r, KEY, "left").groupBy(*KEY)
            .agg(F.coalesce(F.max("metric_value"), F.lit(0.0)).alias("metric_value")))


def _metric_filter(metric_type: str | Sequence[str]) -> Column:
    if isinstance(metric_type, str):
        return F.col("metric_type") == metric_type
    return F.col("metric_type").isin(list(metric_type))


def distinct_params(results: DataFrame, metric_type: str | Sequence[str], extension: str,
                    dataset: str, n: int | None = None) -> DataFrame:
    cond = _metric_filter(metric_type) & (F.col("extension") == extension) & (F.col("dataset") == dataset)
    if n is not None:
        cond &= F.col("n") == n
    return results.where(cond).select("index_params").distinct()


def _series_keys(n, k, merge_k: bool) -> list[str]:
    """x axis: n when n is not fixed, else k. With neither fixed, rows of
    different K at the same n stay apart (grouped by n and k) unless
    ``merge_k`` asks for one MAX per n across all K."""
    if n is None and k is None and not merge_k:
        return ["n", "k"]
    return ["n"] if n is None else ["k"]


def _columns_per_metric(rows: DataFrame, keys: Sequence[str], metric_types: Sequence[str]) -> DataFrame:
    """One row per key, one column per metric: its MAX. A metric may be named like a key but for case ("N" beside "n"). A
    session that ignores case can neither read such columns by name nor write them, so that table is written under plain
    names and read back in a session of its own that tells them apart."""
    keys, metrics = list(keys), list(metric_types)
    names = [*keys, *metrics]
    if len({c.lower() for c in names}) == len(names):
        return rows.groupBy(*keys).pivot("metric_type", metrics).agg(F.max("metric_value"))
    from ..session import scratch_path
    path = scratch_path(rows.sparkSession, "series")
    plain = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("metric_type") == m, F.col("metric_value"))).alias(f"_m{i}")
                                      for i, m in enumerate(metrics)])
    plain.write.parquet(path)
    apart = rows.sparkSession.newSession()
    apart.conf.set("spark.sql.caseSensitive", "true")
    return apart.read.schema(plain.schema).parquet(path).toDF(*names)


def metric_series(results: DataFrame, metric_type: str | Sequence[str], extension: str,
                  index_params: str, dataset: str, n: int | None = None,
                  k: int | None = None, merge_k: bool = False) -> DataFrame:
    """One metric: every matching row (x, metric_value). Several: one column
    per metric, MAX per x (see ``_series_keys`` for the x axis)."""
    xs = _series_keys(n, k, merge_k)
    cond = (_metric_filter(metric_type) & (F.col("extension") == extension)
            & (F.col("index_params") == index_params) & (F.col("dataset") == dataset))
    if n is not None:
        cond &= F.col("n") == n
    if k is not None:
        cond &= F.col("k") == k
    r = results.where(cond)
    if isinstance(metric_type, str):
        return r.select(*xs, "metric_value").orderBy(*xs)
    return _columns_per_metric(r, xs, metric_type).orderBy(*xs)


def chart_series(results: DataFrame, configs: DataFrame, metric_types: Sequence[str], dataset: str,
                 x: str = "n", fixed: dict | None = None) -> DataFrame:
    """Series for a list of configurations (extension, index_params): the
    configuration table is joined to the results (broadcast when small is
    AQE's call), then one grouped pivot per (configuration, x)."""
    cond = _metric_filter(metric_types) & (F.col("dataset") == dataset)
    for c, v in (fixed or {}).items():
        cond &= F.col(c) == v
    sel = results.where(cond).join(configs.select("extension", "index_params"),
                                   ["extension", "index_params"])
    return (sel.groupBy("extension", "index_params", x)
            .pivot("metric_type", list(metric_types)).agg(F.max("metric_value")))


def report(results: DataFrame, kind: str, dataset: str) -> DataFrame:
    """The build, insert or bulk insert report of a dataset: one row per
    (extension, index_params, n) with the kind's metrics as columns."""
    metrics = REPORT_METRICS[kind]
    return (results.where(_metric_filter(metrics) & (F.col("dataset") == dataset))
            .groupBy("extension", "index_params", "n").pivot("metric_type", metrics).agg(F.max("metric_value")))


def metric_series_all(results: DataFrame, metric_types: Sequence[str], extension: str,
                      dataset: str, n: int | None = None, merge_k: bool = False) -> DataFrame:
    """All parameter sets at once: (index_params, x, metric columns...) —
    one grouped pivot instead of a query per parameter set."""
    xs = _series_keys(n, None, merge_k)
    cond = _metric_filter(metric_types) & (F.col("extension") == extension) & (F.col("dataset") == dataset)
    if n is not None:
        cond &= F.col("n") == n
    return _columns_per_metric(results.where(cond), ["index_params", *xs], metric_types)


def metric_scatter(results: DataFrame, metric_x: str, metric_y: str, extension: str,
                   dataset: str, n: int, k: int) -> DataFrame:
    """Two metrics per parameter set at fixed (n, k): (index_params, x, y)."""
    cond = (_metric_filter([metric_x, metric_y]) & (F.col("extension") == extension)
            & (F.col("dataset") == dataset) & (F.col("n") == n) & (F.col("k") == k))
    return (results.where(cond).groupBy("index_params")
            .pivot("metric_type", [metric_x, metric_y]).agg(F.max("metric_value")))


def compare_results(old: DataFrame, new: DataFrame,
                    decrease: Iterable[str] = METRICS_THAT_SHOULD_DECREASE,
                    increase: Iterable[str] = METRICS_THAT_SHOULD_INCREASE,
                    tol: float = 0.0) -> DataFrame:
    """Per key present in both: old/new values, signed relative change and a
    verdict: 'better'/'worse' by the metric's direction, 'same' within tol,
    NULL for metrics without a direction or a zero/NULL old value."""
    dec, inc = list(decrease), list(increase)
    o = old.select(*KEY, F.col("metric_value").alias("old_value"))
    nw = new.select(*KEY, F.col("metric_value").alias("new_value"))
    j = o.join(nw, KEY)
    rel = F.when((F.col("old_value").isNull()) | (F.col("old_value") == 0), F.lit(None).cast("double")) \
        .otherwise((F.col("new_value") - F.col("old_value")) / F.abs(F.col("old_value")))
    sign = (F.when(F.col("metric_type").isin(dec), F.lit(-1.0))
            .when(F.col("metric_type").isin(inc), F.lit(1.0)))
    verdict = (F.when(sign.isNull() | rel.isNull(), F.lit(None).cast("string"))
               .when(F.abs(rel) <= tol, F.lit("same"))
               .when(rel * sign > 0, F.lit("better")).otherwise(F.lit("worse")))
    return j.withColumn("rel_change", rel).withColumn("verdict", verdict)
