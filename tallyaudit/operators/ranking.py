"""Suspicion ranking, executive summary and event timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import DAY_STARTS, local_hour
from ..functions.values import fixed1
from .timing import ODD_HOURS, TOO_FAST_MIN, _has_any, minutes, reference_day


def suspicion_signals(sheets: DataFrame, lines: DataFrame, times: DataFrame) -> DataFrame:
    """Every signal of every sheet with its points."""
    sums = lines.groupBy("sheet_id").agg(F.sum("votes").alias("sum_all"))
    j = sheets.join(sums, "sheet_id", "left").join(times, "sheet_id", "left")
    m, hour = minutes(), local_hour(F.col("scanned_ms"))
    emitted, eligible = F.coalesce("emitted", F.lit(0)), F.coalesce("eligible", F.lit(0))
    gap = F.abs(F.col("sum_all") - emitted)
    pct = F.try_divide(emitted * 100.0, eligible)

    def signal(kind: str, text: Column, points: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("reason"), points.cast("long").alias("points"))

    found = F.array_compact(F.array(
        F.when(m < TOO_FAST_MIN, signal("speed", F.concat(
            F.lit("Proceso ultrarrápido ("), fixed1(m), F.lit(" min)")), F.lit(50)))
        .when(m < 5, signal("speed", F.concat(
            F.lit("Proceso muy rápido ("), fixed1(m), F.lit(" min)")), F.lit(20))),
        F.when(hour.between(*ODD_HOURS), signal("hour", F.concat(
            F.lit("Digitalización a las "), F.lpad(hour.cast("string"), 2, "0"),
            F.lit(":xx AM (hora Perú)")), F.lit(15))),
        F.when((emitted != 0) & (gap > 0), signal("sum", F.concat(
            F.lit("Suma de votos no coincide (Δ="), gap.cast("string"), F.lit(")")), 30 + gap)),
        F.when((eligible != 0) & (emitted != 0) & (pct > 98), signal("turnout", F.concat(
            F.lit("Participación sospechosamente alta ("), fixed1(pct), F.lit("%)")), F.lit(25)))
        .when((eligible != 0) & (emitted != 0) & (pct > 95), signal("turnout", F.concat(
            F.lit("Participación muy alta ("), fixed1(pct), F.lit("%)")), F.lit(10))),
    ))
    return j.select("sheet_id", "station", "contest", F.inline(found))


def suspicion_ranking(signals: DataFrame, n: int | None = 50) -> DataFrame:
    """Points per (station, contest). Signals are counted per kind before they are listed, so the
    list of a group never exceeds the four kinds however many sheets share the key."""
    per_kind = signals.groupBy("station", "contest", "kind").agg(
        F.sum("points").alias("points"), F.count("*").alias("n"))
    ranked = per_kind.groupBy("station", "contest").agg(
        F.sum("points").alias("score"), F.sum("n").alias("n_signals"),
        F.array_join(F.array_sort(F.collect_list(
            F.concat(F.col("kind"), F.lit("x"), F.col("n").cast("string")))), ",").alias("signals"))
    return ranked if n is None else ranked.orderBy(F.col("score").desc(), "station", "contest").limit(n)


def suspicion_reasons(signals: DataFrame, n: int | None = 50) -> DataFrame:
    """Score and signals (kind, reason, points) of each sheet; a sheet has at most one signal of each kind."""
    ranked = signals.groupBy("sheet_id", "station", "contest").agg(
        F.sum("points").alias("score"),
        F.array_sort(F.collect_list(F.struct("kind", "reason", "points"))).alias("signals"))
    return ranked if n is None else ranked.orderBy(F.col("score").desc(), "sheet_id").limit(n)


def audit_summary(sheets: DataFrame, lines: DataFrame, times: DataFrame,
                  days: tuple[int, ...] = DAY_STARTS) -> DataFrame:
    """Seven counters of the executive summary in one pass over the joined sheets."""
    sums = lines.groupBy("sheet_id").agg(F.sum("votes").alias("sum_all"))
    j = sheets.join(sums, "sheet_id", "left").join(times, "sheet_id", "left")
    d = reference_day(days)
    emitted = F.coalesce("emitted", F.lit(0))
    return j.agg(
        F.count("*").alias("sheets"), F.count_if(_has_any()).alias("with_log"),
        F.count_if(_has_any() & (d == 12)).alias("day_12"), F.count_if(_has_any() & (d == 13)).alias("day_13"),
        F.count_if(_has_any() & (d == 0)).alias("unknown_day"),
        F.count_if((emitted != 0) & (F.col("sum_all") != emitted)).alias("sum_mismatches"),
        F.count_if(minutes() < TOO_FAST_MIN).alias("fast_sheets"))


# Candidate date fields of each event, first present one wins.
EVENT_FIELDS = {
    "digitalizacion": ["fechaDigitalizacion", "fechaDigitacion", "fecha_digitalizacion"],
    "escrutinio": ["fechaEscrutinio", "fecha_escrutinio"],
    "envio_jee": ["fechaEnvioJEE", "fecha_envio_jee"],
    "observacion": ["fechaObservacion"],
    "resolucion": ["fechaResolucion"],
}


def event_timeline(events: DataFrame, key: str = "sheet_id") -> DataFrame:
    """Dated events of each sheet plus its current state, in order of date and event within the sheet; no shuffle.

    Date columns are text; those of ``EVENT_FIELDS`` that the input lacks are skipped.
    """
    def first_of(fields: list[str]) -> Column | None:
        present = [f for f in fields if f in events.columns]
        if not present:
            return None
        pairs = [F.when(F.coalesce(F.col(f), F.lit("")) != "", F.struct(
            F.lit(f).alias("field"), F.col(f).alias("date"))) for f in present]
        return F.coalesce(*pairs)

    def row(event: str, field: Column, date: Column) -> Column:
        return F.struct(date.alias("date"), F.lit(event).alias("event"), field.alias("field"),
                        F.col("state").alias("description"))

    structs = []
    for event, fields in EVENT_FIELDS.items():
        hit = first_of(fields)
        if hit is not None:
            structs.append(F.when(hit.isNotNull(), row(event, hit["field"], hit["date"])))
    updated = F.coalesce(F.col("fechaUltimaActualizacion"), F.lit("")) if (
        "fechaUltimaActualizacion" in events.columns) else F.lit("")
    structs.append(F.when(F.coalesce("state", F.lit("")) != "",
                          row("estado_actual", F.lit(None).cast("string"), updated)))
    return events.select(key, F.inline(F.array_sort(F.array_compact(F.array(*structs))))).select(
        key, "event", "field", "date", "description")
