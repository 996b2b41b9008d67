"""Batch bookkeeping of station sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import status_label

# State codes behind each status, in order of precedence.
JEE_CODES = ["PARA_ENVIO_AL_JEE", "ENVIADO_AL_JEE", "JEE"]
ERROR_CODES = ["CON_ERROR", "ERROR_EN_ACTA", "CON_ERROR_AR"]
OBSERVED_CODES = ["OBSERVADA", "IMPUGNADA", "OBSERVADO"]
FOUND = ["EXISTE_CON_PDF", "EXISTE_SIN_PDF", "PARA_JEE", "CON_ERROR_ACTA"]


def state_code(*candidates: Column) -> Column:
    """First non-empty state text as an upper-case code."""
    first = F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))
    return F.replace(F.upper(first), F.lit(" "), F.lit("_"))


def station_status(sheets: DataFrame, stations: DataFrame | None = None,
                   codes: tuple[str, ...] = ("state_code", "state", "state_text")) -> DataFrame:
    """Consolidated status per station; stations of the optional list without sheets are not found."""
    code = state_code(*[F.col(c) for c in codes if c in sheets.columns])

    def any_of(values: list[str]) -> Column:
        return F.max(F.col("_c").isin(values))

    per = sheets.withColumn("_c", code).groupBy("station").agg(
        any_of(JEE_CODES).alias("jee"), any_of(ERROR_CODES).alias("err"), any_of(OBSERVED_CODES).alias("obs"),
        F.max(F.coalesce("file_url", F.lit("")) != "").alias("pdf"), F.count("*").alias("n_sheets"))
    if stations is not None:
        per = stations.select("station").join(per, "station", "left")
    status = (F.when(F.col("n_sheets").isNull(), "NO_EXISTE").when(F.col("jee"), "PARA_JEE")
              .when(F.col("err"), "CON_ERROR_ACTA").when(F.col("obs"), "OBSERVADA")
              .when(F.col("pdf"), "EXISTE_CON_PDF").otherwise("EXISTE_SIN_PDF"))
    return per.select("station", F.coalesce("n_sheets", F.lit(0)).alias("n_sheets"), status.alias("status"),
                      status_label(status).alias("label"))


def empty_runs(results: DataFrame, chunk: int = 4096) -> DataFrame:
    """Length of the current run of not-found stations at every station, in station order.

    A job may hold every row, so the run is built in two steps: inside chunks of ``chunk`` station
    numbers, and over one summary row per chunk that carries positions across chunk borders.
    """
    empty = F.col("status") == "NO_EXISTE"
    r = results.select("job_id", "station_no", "status", F.floor(F.col("station_no") / chunk).alias("chunk"))
    inside = Window.partitionBy("job_id", "chunk").orderBy("station_no")
    rows = r.withColumn("rn", F.row_number().over(inside)).withColumn(
        "hit", F.max(F.when(~empty, F.col("rn"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    summary = rows.groupBy("job_id", "chunk").agg(F.count("*").alias("n"), F.max("hit").alias("last_hit"))
    before = Window.partitionBy("job_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "last_before", F.coalesce(F.max(F.col("start") + F.col("last_hit")).over(before), F.lit(0))
    ).select("job_id", "chunk", "start", "last_before")
    pos = F.col("start") + F.col("rn")
    last = F.coalesce(F.col("start") + F.col("hit"), F.col("last_before"))
    return rows.join(carry, ["job_id", "chunk"]).select("job_id", "station_no", (pos - last).alias("run"))


def empty_run_stop(results: DataFrame, n: int = 200, chunk: int = 4096) -> DataFrame:
    """First station of each job at which ``n`` not-found results follow one another."""
    return empty_runs(results, chunk).where(F.col("run") >= n).groupBy("job_id").agg(
        F.min("station_no").alias("stop_station"))


def remaining(spark: SparkSession, first: int, last: int, done: DataFrame) -> DataFrame:
    """Stations of a range without a result yet."""
    todo = spark.range(first, last + 1).withColumnRenamed("id", "station_no")
    return todo.join(done.select("station_no"), "station_no", "left_anti").select(
        "station_no", F.when(F.length(F.col("station_no").cast("string")) <= 6, F.lpad(
            F.col("station_no").cast("string"), 6, "0")).otherwise(F.col("station_no").cast("string"))
        .alias("station"))


def job_counters(results: DataFrame) -> DataFrame:
    """Status counters per job."""
    return results.groupBy("job_id").agg(
        F.count("*").alias("done"), F.count_if(F.col("status").isin(FOUND)).alias("found"),
        F.count_if(F.col("status") == "PARA_JEE").alias("jee"))


def job_list(active: DataFrame, stored: DataFrame) -> DataFrame:
    """Active jobs, then stored ones not active any more, with the share of stations found."""
    both = active.withColumn("live", F.lit(True)).unionByName(
        stored.join(active.select("job_id"), "job_id", "left_anti").withColumn("live", F.lit(False)))
    return both.withColumn("found_pct", F.when(
        F.col("done") > 0, F.round(F.col("found") * 100.0 / F.col("done"), 1)).otherwise(0.0))


def throughput(results: DataFrame, bucket: str = "1 minute") -> DataFrame:
    """Results per job and time bucket."""
    return results.groupBy("job_id", F.window("ts", bucket).alias("w")).agg(F.count("*").alias("n")).select(
        "job_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "n")


def pipeline_report(sheets: DataFrame, readers: DataFrame, statuses: DataFrame, arithmetic: DataFrame) -> DataFrame:
    """Per station: sheets, documents, readers, comparison results and arithmetic consistency."""
    read = readers.select("sheet_id").distinct().withColumn("has_reader", F.lit(True))
    j = (sheets.select("sheet_id", "station", "pdf_path").join(read, "sheet_id", "left")
         .join(statuses.select("sheet_id", "status", "n_discrepancies"), "sheet_id", "left")
         .join(arithmetic.select("sheet_id", "consistent"), "sheet_id", "left"))
    return j.groupBy("station").agg(
        F.count("*").alias("n_sheets"), F.count_if(F.coalesce("pdf_path", F.lit("")) != "").alias("n_pdf"),
        F.count_if("has_reader").alias("n_reader"), F.count_if(F.col("status") == "alerta").alias("n_alert"),
        F.coalesce(F.sum("n_discrepancies"), F.lit(0)).alias("n_discrepancies"),
        F.count_if("consistent").alias("n_consistent"))


def station_overview(station: str, sheets: DataFrame, timeline: DataFrame, scores: DataFrame) -> DataFrame:
    """Status, dated events and model result of one station, from all its sheets; the filter reaches every scan."""
    mine = sheets.where(F.col("station") == station)
    status = station_status(mine)
    first = mine.groupBy("station").agg(F.min_by("sheet_id", F.struct("contest_id", "sheet_id")).alias("sheet_id"))
    model = first.join(scores.select("sheet_id", "is_anomaly", "score"), "sheet_id", "left").drop("sheet_id")
    events = timeline.join(mine.select("sheet_id", "station"), "sheet_id")
    return events.join(status, "station").join(model, "station").orderBy("date", "sheet_id", "event")
