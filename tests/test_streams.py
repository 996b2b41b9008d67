"""Streams give what the batch gives, also after a restart, with files sent again and with late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import canonical
from tallyaudit.operators import sweep
from tallyaudit.sources import tables as t
from tallyaudit.streaming import sweep_stream as ss

from .conftest import SF


@pytest.mark.parametrize("name", ["b05_stream_status_counts", "b06_stream_empty_run", "b07_stream_upsert", "b08_stream_throughput", "b08_stream_late_rows"])
def test_stream_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert canonical(got).equals(canonical(duck.execute(entry.oracle_sql()[name]).df()))


def land(df, path, files):
    df.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(files, "station_no").write.mode("append").parquet(path)


@pytest.mark.parametrize("n", [1, 2, 3, 200])
def test_stop_point_equals_batch(spark, tmp_path, n):
    """In three runs from one checkpoint: half of the stations, the other half, and all of them sent again."""
    all_ = t.v_sweep(spark, SF)
    # A run of 300 from station 5000 on, over a chunk border and in several files, after a gap in the numbers.
    more = spark.range(5800, 6100).select(F.lit("job_1").alias("job_id"), F.col("id").alias("station_no"), F.lit("NO_EXISTE").alias("status"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"))
    all_ = all_.withColumn("ts", F.col("ts").cast("timestamp")).unionByName(more)
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for part in (all_.where("station_no % 2 = 0"), all_.where("station_no % 2 = 1"), all_):
        land(part, src, 3)
        ss.stream_empty_run(ss.sweep_source(spark, src, 1), out, ckpt, n, buckets=3).awaitTermination()
    want = sweep.empty_run_stop(all_, n).collect()
    assert ss.stop_points(ss.read_runs(spark, out), n).collect() == want
    assert len(want) == 1


def test_counts_of_files_sent_twice(spark, tmp_path):
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    rows = t.v_sweep(spark, SF)
    seen = {}

    def write(batch, _):
        seen.update({(r["job_id"], r["status"]): r["n"] for r in batch.collect()})

    for _ in range(2):
        land(rows, src, 2)
        stream = ss.stream_status_counts(ss.sweep_source(spark, src, 1), "40 days")
        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    assert seen == {(r["job_id"], r["status"]): r["n"] for r in rows.groupBy("job_id", "status").agg(F.count("*").alias("n")).collect()}


def stamped(spark, rows):
    return spark.createDataFrame([("j", i, s, dt.datetime(2024, 1, 1, h, m)) for i, s, h, m in rows], ss.SWEEP_SCHEMA)


def test_late_rows_are_kept_apart(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    batches = [[(1, "A", 10, 5), (2, "A", 10, 50)], [(3, "A", 10, 55), (4, "A", 9, 59), (5, "A", 12, 30)], [(6, "A", 10, 59), (7, "A", 12, 1), (8, "A", 11, 59)]]
    for rows in batches:
        stamped(spark, rows).coalesce(1).write.mode("append").parquet(src)
        ss.stream_throughput_with_late(ss.sweep_source(spark, src, 1), out, ckpt, "1 hour", "20 minutes").awaitTermination()
    counts = {(r["bucket"].hour, r["n"], r["closed"]) for r in ss.read_throughput(spark, out, "20 minutes").collect()}
    # Watermarks: none, 10:30, 12:10.
    assert counts == {(10, 3, True), (12, 2, False)}
    assert {r["station_no"] for r in ss.read_late(spark, out).collect()} == {4, 6, 8}


def test_upserts_read_one_table(spark, tmp_path):
    """After 20 batches a read is one scan of one row per station; a batch that runs again changes nothing."""
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    want = {}
    for b in range(20):
        rows = [(s, f"S{b}", 1 + b % 20, s % 60) for s in range(b, b + 2500, 100)]
        want.update({s: x for s, x, *_ in rows})
        stamped(spark, rows).coalesce(1).write.mode("append").parquet(src)
    ss.stream_upsert(ss.sweep_source(spark, src, 1), out, ckpt, buckets=4).awaitTermination()
    table = ss.read_upserted(spark, out)
    assert {r["station_no"]: r["status"] for r in table.collect()} == want and table.count() == len(want)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    ss._merge(stamped(spark, [(0, "S0", 1, 0), (100, "S0", 1, 40)]), out, 4)  # an old batch once more
    assert {r["station_no"]: r["status"] for r in ss.read_upserted(spark, out).collect()} == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    out = tmp_path / "out"
    ss._merge(stamped(spark, [(s, "A", 1, 0) for s in range(0, 20000, 500)]), str(out), 8)
    before = {p: p.stat().st_mtime_ns for p in out.glob("bucket=*/*.parquet")}
    ss._merge(stamped(spark, [(7, "B", 2, 0)]), str(out), 8)
    after = {p: p.stat().st_mtime_ns for p in out.glob("bucket=*/*.parquet")}
    assert len({p.parent for p in before}) > 3 and len({p.parent.name for p in before.keys() ^ after.keys()}) == 1
