"""Live sweep bookkeeping with Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import latest_per_key
from ..session import cut_lineage

SWEEP_SCHEMA = "job_id STRING, station_no BIGINT, status STRING, ts TIMESTAMP"
STORED_SCHEMA = f"{SWEEP_SCHEMA}, bucket INT"
RUN_SCHEMA = "job_id STRING, chunk BIGINT, rows BIGINT, lead BIGINT, trail BIGINT, hits BIGINT, stop_pos ARRAY<BIGINT>, bucket INT"
#: Station numbers of a chunk, and buckets that chunks are dealt to.
CHUNK, BUCKETS = 1000, 16


def sweep_source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Landed result files as a stream."""
    reader = spark.readStream.schema(SWEEP_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_status_counts(src: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Status counters per job (update mode); a station's status that is sent again counts once.

    The keys seen are state of the stream until the watermark has passed them by ``late``, so what is sent again later
    than that is left out as a late row.
    """
    once = src.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "station_no", "status"])
    return once.groupBy("job_id", "status").agg(F.count("*").alias("n"))


def stream_throughput(src: DataFrame, bucket: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Results per time bucket, written once the watermark has passed it (append mode)."""
    return src.withWatermark("ts", late).groupBy("job_id", F.window("ts", bucket).alias("w")).agg(
        F.count("*").alias("n")).select("job_id", F.col("w.start").alias("bucket"), "n")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# ---- throughput with a table of late rows -------------------------------------------------------


def stream_throughput_with_late(src: DataFrame, path: str, checkpoint: str, bucket: str = "1 minute", late: str = "10 minutes") -> StreamingQuery:
    """Start counting results per time bucket; rows of buckets that are closed already go to a table of their own.

    The watermark of a batch is the newest time of all batches before it, less ``late``, as Spark's own; a bucket is
    closed once it ends at the watermark or before. Every batch writes its counts, its late rows and its newest time
    under its number with overwrite, so a batch that runs again replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = _marks(spark, path).where(F.col("batch_id") < batch_id).agg((F.max("newest") - F.expr(f"INTERVAL {late}")).alias("mark"))
        closed = F.coalesce(F.col("w.end") <= F.col("mark"), F.lit(False))
        # One row, the mark, beside every row of the batch.
        rows = cut_lineage(batch.withColumn("w", F.window("ts", bucket)).withColumn("mark", mark.scalar()).withColumn("closed", closed))
        on_time = rows.where(~F.col("closed")).groupBy("job_id", F.col("w.start").alias("bucket"), F.col("w.end").alias("bucket_end")).agg(F.count("*").alias("n"))
        on_time.write.mode("overwrite").parquet(f"{path}/counts/batch_id={batch_id}")
        rows.where("closed").drop("w", "mark", "closed").write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        rows.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")

    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _marks(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/marks", "newest TIMESTAMP, batch_id BIGINT")


def read_throughput(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """job_id, bucket, n and ``closed`` (the watermark has passed the bucket, its count is final)."""
    counts = _stored(spark, f"{path}/counts", "job_id STRING, bucket TIMESTAMP, bucket_end TIMESTAMP, n BIGINT, batch_id BIGINT")
    mark = _marks(spark, path).agg((F.max("newest") - F.expr(f"INTERVAL {late}")).alias("mark")).scalar()
    return counts.groupBy("job_id", "bucket", "bucket_end").agg(F.sum("n").alias("n")).select(
        "job_id", "bucket", "n", F.coalesce(F.col("bucket_end") <= mark, F.lit(False)).alias("closed"))


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came after their bucket was closed."""
    return _stored(spark, f"{path}/late", f"{SWEEP_SCHEMA}, batch_id BIGINT").drop("batch_id")


# ---- newest result per station, and runs of stations that were not found ------------------------


def _bucket(buckets: int) -> Column:
    """Chunks of a job are spread over the buckets, so one job with all rows is spread as well."""
    return F.pmod(F.xxhash64("job_id", F.floor(F.col("station_no") / CHUNK)), F.lit(buckets)).cast("int")


def _replace(df: DataFrame, path: str) -> None:
    """Overwrite the buckets that ``df`` holds, and no other."""
    df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _merge(batch: DataFrame, path: str, buckets: int) -> DataFrame:
    """Fold a batch into the table at ``path``; returns the buckets it touched, with all their rows.

    A station keeps its newest row, whatever the order in which rows arrive, so a batch that runs again or is sent
    again changes nothing.
    """
    spark = batch.sparkSession
    new = batch.withColumn("bucket", _bucket(buckets))
    # At most ``buckets`` numbers.
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    old = _stored(spark, path, STORED_SCHEMA).where(F.col("bucket").isin(touched))
    both = latest_per_key(old.unionByName(new), ["job_id", "station_no"], "ts", "status")
    merged = cut_lineage(both.select(*[c.split()[0] for c in STORED_SCHEMA.split(", ")]))
    if touched:
        _replace(merged, path)
    return merged


def stream_upsert(src: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Start the upsert of sweep results into the table at ``path``: one row per job and station, in buckets.

    A batch rewrites the buckets it touches; a read is one scan of the table, however many batches there were.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        _merge(batch, path, buckets)

    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, STORED_SCHEMA).drop("bucket")


def run_summaries(stations: DataFrame, n: int) -> DataFrame:
    """One row per (job, chunk): stations, not-found runs at both ends, and the stations at which a run of ``n`` ends.

    ``stop_pos``: the first n stations of the run at the start, then the first station at which a run of n ends within
    the chunk, or -1.
    """
    order = Window.partitionBy("job_id", "chunk", "bucket").orderBy("station_no")
    found = F.col("status") != "NO_EXISTE"
    rows = (
        stations.withColumn("chunk", F.floor(F.col("station_no") / CHUNK)).withColumn("pos", F.row_number().over(order).cast("long"))
        .withColumn("hit", F.max(F.when(found, F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    inner = F.min(F.when(F.col("hit").isNotNull() & (F.col("pos") - F.col("hit") >= n), F.col("station_no")))
    # A chunk's stations are bounded by its width.
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("hit").isNull() & (F.col("pos") <= n), F.struct("pos", "station_no")))), lambda x: x["station_no"])
    return rows.groupBy("job_id", "chunk", "bucket").agg(
        F.count("*").alias("rows"), F.count_if(F.col("hit").isNull()).alias("lead"),
        (F.count("*") - F.coalesce(F.max("hit"), F.lit(0))).alias("trail"), F.count_if(found).alias("hits"),
        F.concat(first, F.array(F.coalesce(inner, F.lit(-1)))).alias("stop_pos"),
    ).select("job_id", "chunk", "rows", "lead", "trail", "hits", "stop_pos", "bucket")


def stream_empty_run(src: DataFrame, path: str, checkpoint: str, n: int = 200, buckets: int = BUCKETS) -> StreamingQuery:
    """Start keeping the newest result per station and the summaries of not-found runs, both in buckets.

    A batch touches the buckets of its own stations: their rows are merged and their chunks summarised anew. No state
    is held in memory; the two tables are the state, and they survive a restart as the checkpoint does.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        merged = _merge(batch, f"{path}/stations", buckets)
        summaries = cut_lineage(run_summaries(merged, n))
        if not summaries.isEmpty():
            _replace(summaries, f"{path}/runs")

    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/runs", RUN_SCHEMA).drop("bucket")


def stop_points(summaries: DataFrame, n: int = 200) -> DataFrame:
    """First station of each job where ``n`` not-found results follow one another, from one row per chunk."""
    before = Window.partitionBy("job_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = summaries.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn(
        "last_hit", F.when(F.col("hits") > 0, F.col("start") + F.col("rows") - F.col("trail")))
    run_in = F.col("start") - F.coalesce(F.max("last_hit").over(before), F.lit(0))
    need = F.lit(n) - F.col("run_in")
    crossing = F.when((F.col("lead") >= need) & (need >= 1), F.get("stop_pos", (need - 1).cast("int")))
    inner = F.element_at("stop_pos", -1)
    return placed.withColumn("run_in", run_in).withColumn(
        "stop", F.coalesce(crossing, F.when(inner >= 0, inner))).where("stop IS NOT NULL").groupBy("job_id").agg(
        F.min("stop").alias("stop_station"))
