"""Streaming bookkeeping, run to completion over landed files of the event table."""

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import tables as t
from ..streaming import sweep_stream as ss
from .catalog import query


def _landed(spark, sf, files: int = 4) -> str:
    """The sweep log as a folder of files, the way a crawler lands it."""
    path = shared_folder(spark, "landed")
    (t.v_sweep(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
     .repartitionByRange(files, "station_no").write.mode("overwrite").parquet(path))
    return path


def _drain(spark, stream, mode: str, name: str):
    """Run a stream over everything landed and hand back its table of results."""
    out, ckpt = shared_folder(spark, name), shared_folder(spark, "streams")

    def write(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", ckpt).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("b")


#: The events of the test tables lie within so many days.
_SPAN = "40 days"


@query("b05_stream_status_counts", "SELECT job_id, status, count(*) AS n FROM (SELECT DISTINCT job_id, station_no, status FROM v_sweep) GROUP BY 1, 2", "v_sweep")
def b05(spark, sf):
    src = ss.sweep_source(spark, _landed(spark, sf), 2)
    rows = _drain(spark, ss.stream_status_counts(src, _SPAN), "update", "counts")
    return rows.groupBy("job_id", "status").agg(F.max_by("n", "batch").alias("n"))


@query("b06_stream_empty_run", """
SELECT job_id, min(station_no) AS stop_station FROM (
  SELECT job_id, station_no, pos - coalesce(max(CASE WHEN status <> 'NO_EXISTE' THEN pos END) OVER (PARTITION BY job_id ORDER BY pos), 0) AS run
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY station_no) AS pos FROM v_sweep)) WHERE run >= 4 GROUP BY job_id""", "v_sweep")
def b06(spark, sf):
    out, ckpt = shared_folder(spark, "runs"), shared_folder(spark, "streams")
    ss.stream_empty_run(ss.sweep_source(spark, _landed(spark, sf), 2), out, ckpt, 4).awaitTermination()
    return ss.stop_points(ss.read_runs(spark, out), 4)


@query("b07_stream_upsert", "SELECT job_id, station_no, status FROM v_sweep", "v_sweep")
def b07(spark, sf):
    out, ckpt = shared_folder(spark, "upsert"), shared_folder(spark, "streams")
    ss.stream_upsert(ss.sweep_source(spark, _landed(spark, sf), 2), out, ckpt).awaitTermination()
    return ss.read_upserted(spark, out).select("job_id", "station_no", "status")


@query("b08_stream_throughput", """
SELECT job_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n FROM v_sweep
GROUP BY 1, 2""", "v_sweep")
def b08s(spark, sf):
    src = ss.sweep_source(spark, _landed(spark, sf))
    rows = _drain(spark, ss.stream_throughput(src, "1 hour", _SPAN), "update", "rate")
    return rows.groupBy("job_id", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket")).agg(
        F.max_by("n", "batch").alias("n"))


@query("b08_stream_late_rows", """
SELECT job_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n FROM v_sweep
GROUP BY 1, 2""", "v_sweep")
def b08l(spark, sf):
    """Counts of the hours that were in time and of those that came late, together all of them."""
    out, ckpt = shared_folder(spark, "rate"), shared_folder(spark, "streams")
    ss.stream_throughput_with_late(ss.sweep_source(spark, _landed(spark, sf), 1), out, ckpt, "1 hour", "1 day").awaitTermination()
    late = ss.read_late(spark, out).groupBy("job_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    both = ss.read_throughput(spark, out, "1 day").select("job_id", "bucket", "n").union(late.select("job_id", "w.start", "n"))
    return both.groupBy("job_id", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket")).agg(F.sum("n").alias("n"))
