"""Processing-time reports over one row of state times per sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import DAY_STARTS, local_hour, local_text, voting_day
from ..functions.values import fixed1

# Bounds of the timing rules.
TOO_FAST_MIN = 1.5
TOO_SLOW_HOURS = 72
ODD_HOURS = (1, 5)


def reference_day(days: tuple[int, ...] = DAY_STARTS) -> Column:
    """Voting day of the first available of scanned, typed, counted."""
    return voting_day(F.coalesce("scanned_ms", "typed_ms", "counted_ms"), days)


def _has_any() -> Column:
    return F.coalesce("scanned_ms", "typed_ms", "counted_ms", "observed_ms", "sent_jee_ms").isNotNull()


def minutes() -> Column:
    return (F.col("counted_ms") - F.col("scanned_ms")) / F.lit(60000.0)


def day_distribution(times: DataFrame, days: tuple[int, ...] = DAY_STARTS) -> DataFrame:
    """Sheets with a log and sheets per voting day, in one pass."""
    d = reference_day(days)
    return times.where(_has_any()).agg(
        F.count("*").alias("with_log"), F.count_if(d == 12).alias("day_12"),
        F.count_if(d == 13).alias("day_13"), F.count_if(d == 0).alias("other_day"))


def contest_day(times: DataFrame, sheets: DataFrame, days: tuple[int, ...] = DAY_STARTS) -> DataFrame:
    d = reference_day(days)
    return times.where(_has_any()).join(sheets.select("sheet_id", "contest"), "sheet_id").groupBy("contest").agg(
        F.count_if(d == 12).alias("day_12"), F.count_if(d == 13).alias("day_13"),
        F.count_if(d == 0).alias("other_day"))


def hour_histogram(times: DataFrame, days: tuple[int, ...] = DAY_STARTS) -> DataFrame:
    """24 rows: scanned, counted, and scanned per voting day; hours without sheets stay at 0."""
    d = reference_day(days)
    events = times.select(F.inline(F.array(
        F.struct(local_hour(F.col("scanned_ms")).alias("hour"), F.lit("s").alias("what"), d.alias("day")),
        F.struct(local_hour(F.col("counted_ms")).alias("hour"), F.lit("c").alias("what"), d.alias("day")),
    ))).where("hour >= 0")
    counts = events.groupBy("hour").agg(
        F.count_if(F.col("what") == "s").alias("scanned"), F.count_if(F.col("what") == "c").alias("counted"),
        F.count_if((F.col("what") == "s") & (F.col("day") == 12)).alias("scanned_12"),
        F.count_if((F.col("what") == "s") & (F.col("day") == 13)).alias("scanned_13"))
    hours = times.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counts, "hour", "left").fillna(0)


def cumulative_hours(histogram: DataFrame) -> DataFrame:
    """Running totals over the 24 hours."""
    from pyspark.sql import Window

    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("scanned_12_total", F.sum("scanned_12").over(w)).withColumn(
        "scanned_13_total", F.sum("scanned_13").over(w))


def processing_speed(times: DataFrame, days: tuple[int, ...] = DAY_STARTS) -> DataFrame:
    """Minutes from scanned to counted, rounded to one decimal."""
    return times.where(F.col("scanned_ms").isNotNull() & F.col("counted_ms").isNotNull()).select(
        "sheet_id", F.round(minutes(), 1).alias("minutes"), reference_day(days).alias("day"))


def speed_stats(speed: DataFrame) -> DataFrame:
    return speed.agg(
        F.round(F.avg("minutes"), 1).alias("mean_min"), F.round(F.median("minutes"), 1).alias("median_min"),
        F.round(F.min("minutes"), 1).alias("min_min"), F.round(F.max("minutes"), 1).alias("max_min"))


def speed_histogram(speed: DataFrame, width: int = 10) -> DataFrame:
    bucket = (F.floor(F.col("minutes") / width) * width).cast("long")
    return speed.groupBy(bucket.alias("from_min")).agg(F.count("*").alias("n")).select(
        "from_min", (F.col("from_min") + width).alias("to_min"), "n")


def timing_anomalies(times: DataFrame, sheets: DataFrame) -> DataFrame:
    """Too fast (high), too slow (medium), odd hour (low): one row per finding."""
    m, hour = minutes(), local_hour(F.col("scanned_ms"))
    slow = m > TOO_SLOW_HOURS * 60

    def finding(category: str, reason: Column, severity: str, detail: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), reason.alias("reason"),
                        F.lit(severity).alias("severity"), detail.alias("detail"))

    span = F.concat_ws(" → ", local_text(F.col("scanned_ms")), local_text(F.col("counted_ms")))
    rules = F.array_compact(F.array(
        F.when(m < TOO_FAST_MIN, finding("timeline", F.concat(
            F.lit("Procesamiento extremadamente rápido ("), fixed1(m), F.lit(" min)")), "alta", span))
        .when(slow, finding("timeline", F.concat(
            F.lit("Proceso inusualmente largo ("), fixed1(m / 60), F.lit(" horas)")), "media", span)),
        F.when(hour.between(*ODD_HOURS), finding("horario", F.concat(
            F.lit("Digitalización en horario inusual ("), hour.cast("string"), F.lit(":00 AM hora Perú)")),
            "baja", local_text(F.col("scanned_ms")))),
    ))
    found = times.select("sheet_id", F.inline(rules))
    return found.join(sheets.select("sheet_id", "station", "contest_id", "contest"), "sheet_id")


def day_sheets(times: DataFrame, sheets: DataFrame, day: int, days: tuple[int, ...] = DAY_STARTS) -> DataFrame:
    """Sheets of one voting day with readable local times."""
    return times.where(reference_day(days) == day).join(
        sheets.select("sheet_id", "station", "contest"), "sheet_id").select(
        "sheet_id", "station", "contest", local_text(F.col("scanned_ms")).alias("scanned"),
        local_text(F.col("typed_ms")).alias("typed"), local_text(F.col("counted_ms")).alias("counted"))
