"""Turnout per sheet, turnout rules and reconciliation with the official snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import fixed1, fixed2

# Electors a station may hold, tolerated gap to the official attendance.
STATION_CAPACITY = 300
GAP_PCT = 5.0


def raw_pct() -> Column:
    return F.when(F.col("eligible") > 0, F.col("emitted") * 100.0 / F.col("eligible"))


def turnout(sheets: DataFrame, top: int | None = None) -> DataFrame:
    """Turnout of every sheet with electors, or the ``top`` highest."""
    out = sheets.where(F.col("emitted").isNotNull() & (F.coalesce("eligible", F.lit(0)) > 0)).select(
        "sheet_id", "station", "contest", "emitted", "eligible", F.round(raw_pct(), 3).alias("pct"),
        F.round(F.when(F.col("declared_pct") != 0, F.col("declared_pct")), 3).alias("declared_pct"))
    return out if top is None else out.orderBy(F.col("pct").desc(), "sheet_id").limit(top)


def _finding(category: str, reason: Column, severity: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), reason.alias("reason"), severity.alias("severity"))


def turnout_rules(sheets: DataFrame, capacity: int = STATION_CAPACITY) -> DataFrame:
    """Impossible or inconsistent turnout: one row per broken rule, no shuffle."""
    e, n, pct = F.col("emitted"), F.coalesce("eligible", F.lit(0)), raw_pct()
    gap = F.abs(pct - F.col("declared_pct"))
    high, medium = F.lit("alta"), F.lit("media")
    text = F.concat
    rules = F.array_compact(F.array(
        F.when((n != 0) & (e > n), _finding("votos_excedentes", text(
            F.lit("Votos emitidos ("), e.cast("string"), F.lit(") > electores hábiles ("),
            n.cast("string"), F.lit(")")), high)),
        F.when(e > capacity, _finding("sobre_capacidad", text(
            F.lit("Votos ("), e.cast("string"), F.lit(f") superan máximo de {capacity} por mesa")),
            F.when(e > capacity * 1.1, high).otherwise(medium))),
        F.when(pct > 100, _finding("participacion_imposible", text(
            F.lit("Participación "), fixed1(pct), F.lit("% > 100%")), high)),
        F.when(gap > 1.0, _finding("pct_inconsistente", text(
            F.lit("% participación declarado ("), fixed1(F.col("declared_pct")),
            F.lit("%) ≠ calculado ("), fixed1(pct), F.lit("%)")),
            F.when(gap > 5, high).otherwise(medium))),
    ))
    return sheets.where(e.isNotNull()).select("sheet_id", "station", "contest", F.inline(rules))


def turnout_outliers(sheets: DataFrame, z_min: float = 2.5, z_high: float = 4.0, min_n: int = 10) -> DataFrame:
    """Sheets whose turnout is far from the national mean (statistics are one scalar row)."""
    base = sheets.where(F.col("emitted").isNotNull() & (F.coalesce("eligible", F.lit(0)) > 0))
    stats = base.agg(F.struct(
        F.count("*").alias("n"), F.avg(raw_pct()).alias("mean"), F.stddev_samp(raw_pct()).alias("std"))).scalar()
    rows = base.select("sheet_id", "station", "contest", F.round(raw_pct(), 3).alias("pct"), stats.alias("s"))
    z = F.abs(F.col("pct") - F.col("s.mean")) / F.col("s.std")
    hits = rows.where((F.col("s.n") >= min_n) & (F.col("s.std") > 0.01)).withColumn("z", z).where(
        F.col("z") > z_min)
    side = F.when(F.col("pct") > F.col("s.mean"), "alta").otherwise("baja")
    return hits.select(
        "sheet_id", "station", "contest", F.lit("outlier_estadistico").alias("category"),
        F.concat(F.lit("Participación "), fixed1(F.col("pct")), F.lit("% muy "), side, F.lit(" (media="),
                 fixed1(F.col("s.mean")), F.lit("%, z="), fixed2(F.col("z")), F.lit("σ)")).alias("reason"),
        F.when(F.col("z") > z_high, "alta").otherwise("media").alias("severity"))


def turnout_anomalies(sheets: DataFrame, ordered: bool = True) -> DataFrame:
    """All turnout findings, high severity first."""
    out = turnout_rules(sheets).unionByName(turnout_outliers(sheets))
    if not ordered:
        return out
    return out.orderBy((F.col("severity") == "alta").desc(), "sheet_id", "category")


def turnout_histogram(sheets: DataFrame, width: int = 5) -> DataFrame:
    bucket = (F.floor(raw_pct() / width) * width).cast("long")
    base = sheets.where(F.col("emitted").isNotNull() & (F.coalesce("eligible", F.lit(0)) > 0))
    return base.groupBy(bucket.alias("from_pct")).agg(F.count("*").alias("n")).select(
        "from_pct", (F.col("from_pct") + width).alias("to_pct"), "n")


def turnout_reconcile(sheets: DataFrame, official: DataFrame, gap_pct: float = GAP_PCT) -> DataFrame:
    """National sums against the official attendance, coverage and pending electors (one row)."""
    local = sheets.where(F.col("emitted").isNotNull()).agg(F.struct(
        F.count("*").alias("n_sheets"), F.sum("emitted").alias("emitted"),
        F.sum(F.coalesce("eligible", F.lit(0))).alias("eligible"),
        F.round(F.avg(raw_pct()), 2).alias("mean_pct"), F.round(F.stddev_samp(raw_pct()), 2).alias("std_pct"))).scalar()
    o = official.withColumn("l", local)
    gap = F.when(F.col("present") > 0, F.col("l.emitted") - F.col("present"))
    pct = F.round(gap * 100.0 / F.col("present"), 3)
    return o.select(
        "l.n_sheets", F.col("l.emitted").alias("sum_emitted"), F.col("l.eligible").alias("sum_eligible"),
        "l.mean_pct", "l.std_pct", "electors", "present", "absent", "pending", "pending_pct",
        gap.alias("gap_votes"), pct.alias("gap_pct"),
        (F.abs(F.coalesce(pct, F.lit(0.0))) > gap_pct).alias("gap_alert"),
        F.when((F.col("electors") > 0) & (F.col("l.eligible") > 0),
               F.round(F.col("l.eligible") * 100.0 / F.col("electors"), 2)).alias("coverage_pct"))
