"""Dashboard counters and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_row(spark, **values: Column) -> DataFrame:
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()])


def _scalar(df: DataFrame, agg: Column) -> Column:
    return df.agg(agg).scalar()


def dashboard_stats(stations: DataFrame, sheets: DataFrame, readers: DataFrame, reports: DataFrame,
                    compares: DataFrame, sweep: DataFrame, scores: DataFrame) -> DataFrame:
    """Ten counters; every table is aggregated on its own, nothing is joined."""
    n = F.count("*")
    return _one_row(
        sheets.sparkSession,
        total_stations=_scalar(stations, n), total_sheets=_scalar(sheets, n),
        with_pdf=_scalar(sheets, F.count("pdf_path")),
        with_reader=_scalar(readers, F.count_distinct("sheet_id")),
        with_report=_scalar(reports, F.count_distinct("sheet_id")),
        flagged_reports=_scalar(reports, F.count_if("has_anomaly")),
        alert_comparisons=_scalar(compares, F.count_if(F.col("status") == "alerta")),
        swept_stations=_scalar(sweep, F.count_distinct("station_no")),
        jee_stations=_scalar(sweep, F.count_if(F.col("status") == "PARA_JEE")),
        model_anomalies=_scalar(scores, F.count_if("is_anomaly")))


def list_stats(sheets: DataFrame, readers: DataFrame, reports: DataFrame, compares: DataFrame) -> DataFrame:
    """Seven counters above the sheet list; report counters count reports, not sheets."""
    return _one_row(
        sheets.sparkSession,
        total_sheets=_scalar(sheets, F.count("*")),
        with_pdf=_scalar(sheets, F.count_if(F.coalesce("pdf_path", F.lit("")) != "")),
        with_reader=_scalar(readers, F.count_distinct("sheet_id")),
        flagged_reports=_scalar(reports, F.count_if("has_anomaly")),
        alert_reports=_scalar(compares, F.count_if(F.col("status") == "alerta")),
        digital_results=_scalar(readers, F.count_if(~F.col("scanned"))),
        scanned_results=_scalar(readers, F.count_if("scanned")))


def document_kinds(sheets: DataFrame, readers: DataFrame) -> DataFrame:
    without = sheets.join(readers.select("sheet_id"), "sheet_id", "left_anti")
    return _one_row(
        sheets.sparkSession, digital=_scalar(readers, F.count_if(~F.col("scanned"))),
        scanned=_scalar(readers, F.count_if("scanned")), without_reader=_scalar(without, F.count("*")))


def anomalies_by_contest(sheets: DataFrame, reports: DataFrame, top: int = 10, latest: bool = False) -> DataFrame:
    """Reports and flagged reports per contest. Reports are counted per sheet before the join, so a
    re-analysed sheet fans out in the numbers but not in the rows moved."""
    if latest:
        per = reports.groupBy("sheet_id").agg(
            F.lit(1).cast("long").alias("n"),
            F.max_by("has_anomaly", F.struct("ts", "report_id")).cast("long").alias("f"))
    else:
        per = reports.groupBy("sheet_id").agg(F.count("*").alias("n"), F.count_if("has_anomaly").alias("f"))
    name = F.coalesce("contest", F.concat(F.lit("Elección "), F.col("contest_id").cast("string")))
    return sheets.join(per, "sheet_id", "left").groupBy("contest_id", name.alias("contest")).agg(
        F.sum(F.coalesce("n", F.lit(1))).alias("total"), F.sum(F.coalesce("f", F.lit(0))).alias("flagged"),
    ).orderBy(F.col("total").desc(), "contest_id").limit(top)


def discrepancy_split(compares: DataFrame) -> DataFrame:
    alert = F.coalesce(F.col("status") == "alerta", F.lit(False))
    return compares.agg(F.count_if(alert).alias("alert"), F.count_if(~alert).alias("ok"))


def top_discrepant_stations(compares: DataFrame, top: int = 10, key: str = "station") -> DataFrame:
    return compares.where("status = 'alerta'").groupBy(key).agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), key).limit(top)


def sweep_stats(results: DataFrame) -> DataFrame:
    """Result count per status next to the number of distinct stations swept."""
    stations = results.agg(F.count_distinct("station_no")).scalar()
    return results.groupBy("status").agg(F.count("*").alias("n")).withColumn("stations", stations)


def latest_jobs(jobs: DataFrame, n: int = 5) -> DataFrame:
    return jobs.orderBy(F.col("started_at").desc_nulls_last(), "job_id").limit(n)


def score_stats(scores: DataFrame) -> DataFrame:
    """``scores`` carries is_anomaly, score and confidence."""
    positive = F.col("is_anomaly")
    n, hits = F.count("*"), F.count_if(positive)
    return scores.agg(
        n.alias("total"), hits.alias("anomalies"),
        F.round(hits * 100.0 / F.greatest(F.lit(1), n), 1).alias("pct"),
        *[F.count_if(positive & (F.col("confidence") == c)).alias(c) for c in ("alta", "media", "baja")],
        F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.round(F.avg("score"), 4).alias("score_mean"))


def anomalies_by_date(scores: DataFrame) -> DataFrame:
    return scores.where("is_anomaly").groupBy(
        F.date_format("analysed_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).where("day IS NOT NULL")


def score_histogram(scores: DataFrame, bins: int = 20, close_last: bool = True) -> DataFrame:
    """Equal-width bins between the extremes; empty bins are kept.

    With ``close_last=False`` the bins are half-open and the maximum falls into none of them.
    """
    s = scores.where("score IS NOT NULL")
    ends = s.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"))).scalar()
    width = F.when(F.col("e.hi") > F.col("e.lo"), (F.col("e.hi") - F.col("e.lo")) / bins).otherwise(1.0)
    binned = s.select("score", ends.alias("e")).select(
        F.floor((F.col("score") - F.col("e.lo")) / width).cast("int").alias("b"))
    if close_last:
        binned = binned.select(F.least("b", F.lit(bins - 1)).alias("b"))
    counts = binned.groupBy("b").agg(F.count("*").alias("n"))
    grid = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("b"), ends.alias("e"))
    return grid.join(counts, "b", "left").select(
        F.col("b").alias("bin"), F.round(F.col("e.lo") + F.col("b") * width, 6).alias("from_score"),
        F.round(F.col("e.lo") + (F.col("b") + 1) * width, 6).alias("to_score"),
        F.coalesce("n", F.lit(0)).alias("n"))


def sheets_by_contest(sheets: DataFrame) -> DataFrame:
    return sheets.groupBy(F.coalesce(F.nullif(F.col("contest"), F.lit("")), F.lit("Desconocida"))
                          .alias("contest")).agg(F.count("*").alias("n"))


def discrepancies_by_party(discrepancies: DataFrame, keywords: list[str], top: int = 15) -> DataFrame:
    """Discrepancies per chart keyword; the longest keyword a name contains wins. ``party`` per row."""
    name = F.upper("party")
    hit = F.lit(None).cast("string")
    for k in sorted(keywords, key=len):
        hit = F.when(name.contains(k.upper()), k).otherwise(hit)
    return discrepancies.select(hit.alias("keyword")).where("keyword IS NOT NULL").groupBy("keyword").agg(
        F.count("*").alias("n")).orderBy(F.col("n").desc(), "keyword").limit(top)


def daily_bitmaps(log: DataFrame, key: str, day: Column) -> DataFrame:
    """(day, bucket, bits): which values of a whole-number ``key`` a day holds, as bitmaps of 32,768 values each.

    A day is written once; any span of days merges by a bitwise or, exactly, without going back to the log.
    """
    rows = log.where(F.col(key).isNotNull() & day.isNotNull())
    return rows.groupBy(day.alias("day"), F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def merged_distinct(bitmaps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by`` and ``n``: the distinct values of the days in ``bitmaps``, merged; one row if ``by`` is empty."""
    by = by or []
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
