import datetime as dt
import os

from pyspark.sql import functions as F

from vekta.operators import ingest, ivf
from vekta.session import scratch_path
from vekta.sources import fixtures as fx
from vekta.streaming import ingest as sing
from vekta.streaming import progress as prog


def test_stream_ingest_equals_batch_and_restart_adds_nothing(spark, sf):
    b = fx.base_vectors(spark, sf, with_label=True)
    plan = ingest.plan_ingest(b)
    seed = ingest.ingest_seed_labels(b, plan)
    app = ingest.appended_rows(b, plan)
    src = scratch_path(spark, "src")
    app.select("id", "v").write.parquet(f"{src}/part1")
    schema = spark.read.parquet(f"{src}/part1").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    sing.ingest_stream(seed, stream, out, ck).awaitTermination()
    got = sing.read_ingested(spark, out)
    batch = ingest.ingest_append(seed, app).cells.where(F.col("id") >= plan.start)
    assert sorted((r["id"], r["cell"]) for r in got.collect()) == \
        sorted((r["id"], r["cell"]) for r in batch.select("id", "cell").collect())
    # restart from the same checkpoint: no new files -> no new rows
    sing.ingest_stream(seed, spark.readStream.schema(schema).option("recursiveFileLookup", "true")
                       .parquet(src), out, ck).awaitTermination()
    assert sing.read_ingested(spark, out).count() == got.count()


def test_late_rows_beyond_watermark_are_dropped(spark):
    src = scratch_path(spark, "ev")
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    first = [(t0 + dt.timedelta(seconds=i), "run", 10.0) for i in range(0, 3600, 60)]
    spark.createDataFrame(first, "ts timestamp, event_type string, value double") \
        .coalesce(1).write.parquet(f"{src}/a")
    schema = spark.read.parquet(f"{src}/a").schema
    out, ck = scratch_path(spark, "pout"), scratch_path(spark, "pck")

    def run():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true") \
            .option("maxFilesPerTrigger", 1).parquet(src)
        prog.start_progress(s, out, ck, "5 minutes", ["event_type"], watermark="10 minutes") \
            .awaitTermination()
    run()
    late = [(t0 + dt.timedelta(seconds=30), "run", 99.0),           # far behind watermark: dropped
            (t0 + dt.timedelta(minutes=59, seconds=30), "run", 20.0)]  # inside watermark: kept
    spark.createDataFrame(late, "ts timestamp, event_type string, value double") \
        .coalesce(1).write.parquet(f"{src}/b")
    run()
    r = {row["window_start"]: row for row in prog.read_progress(spark, out, ["event_type"]).collect()}
    assert r[t0]["requests"] == 5 and r[t0]["latency_average"] == 10.0
    last = t0 + dt.timedelta(minutes=55)
    assert r[last]["requests"] == 6


def test_stream_drops_duplicate_ids_within_watermark(spark, sf):
    b = fx.base_vectors(spark, sf, with_label=True)
    plan = ingest.plan_ingest(b)
    seed = ingest.ingest_seed_labels(b, plan)
    rows = b.where("id >= 100 AND id < 130").select("id", "v").collect()
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    data = [(r["id"], r["v"], t0 + dt.timedelta(seconds=i)) for i, r in enumerate(rows)]
    data += [(r["id"], r["v"], t0 + dt.timedelta(seconds=40 + i)) for i, r in enumerate(rows[:10])]  # replays
    src = scratch_path(spark, "dup")
    spark.createDataFrame(data, "id long, v array<float>, ts timestamp").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    out = sing.assign_stream(seed, stream, event_time="ts", dedupe_within="10 minutes")
    got_path = scratch_path(spark, "dup-out")
    q = (out.writeStream.foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{got_path}/batch={i}"))
         .option("checkpointLocation", scratch_path(spark, "dup-ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(got_path)
    assert got.count() == 30 and got.select("id").distinct().count() == 30
    assert got.where("cell IS NULL").count() == 0


def test_search_dispatch(spark, sf):
    from vekta.operators.search import search
    b = fx.base_vectors(spark, sf, with_label=True)
    idx = ivf.ivf_from_labels(b, "label")
    exact = sorted((r["query_id"], r["id"]) for r in search(b, 3, base=b).collect())
    full = sorted((r["query_id"], r["id"]) for r in search(b, 3, index=idx, probes=10).collect())
    assert exact == full


def test_source_stream_reads_a_table_that_is_a_folder(spark, sf):
    b = fx.table(spark, sf, "embeddings").limit(40)
    top = scratch_path(spark, "tables")
    b.repartition(2).write.parquet(f"{top}/embeddings.parquet")
    b.limit(5).write.parquet(f"{top}/other.parquet")
    out = scratch_path(spark, "copied")
    stream = prog.source_stream(spark, top, "embeddings", b.schema)
    (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "ck"))
     .format("parquet").start(out).awaitTermination())
    assert sorted(r[0] for r in spark.read.parquet(out).select("vec_id").collect()) == sorted(r[0] for r in b.select("vec_id").collect())
