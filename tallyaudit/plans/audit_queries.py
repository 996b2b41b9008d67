"""Audit rules: sums, parties, timing, turnout, ranking."""

from pyspark.sql import functions as F

from ..operators import parties, ranking, sums, timing, turnout
from ..sources import official, sheets, tables as t
from .catalog import query


def _times(spark, sf):
    return sheets.state_times(t.v_timeline(spark, sf))


def _official_turnout(spark, sf):
    """Official attendance as published: 3 % above the local emitted votes."""
    snap = t.v_sheet(spark, sf).agg(F.to_json(F.struct(
        (F.sum("eligible") * 2).alias("totalElectoresHabiles"),
        F.floor(F.sum("emitted") * 1.1).cast("long").alias("totalAsistentes"),
        F.floor(F.sum("emitted") * 0.2).cast("long").alias("totalAusentes"),
        F.lit(55.5).alias("porcentajeAsistentes"))).alias("totals_json"))
    return official.official_turnout(snap)


_MISMATCH = """
SELECT s.sheet_id, s.station, s.contest_id, s.contest, s.emitted, v.sum_all, v.sum_all - s.emitted AS diff_emitted,
  s.valid, v.sum_valid, v.sum_valid - s.valid AS diff_valid, v.nulls, v.blanks, v.challenged, s.eligible, s.declared_pct,
  round(s.emitted * 100.0 / nullif(s.eligible, 0), 3) AS computed_pct,
  CASE WHEN abs(v.sum_all - s.emitted) > 1 THEN 'alta' ELSE 'baja' END AS severity
FROM v_sheet s JOIN v_sums v USING (sheet_id)
WHERE v.sum_all <> s.emitted OR v.sum_valid <> s.valid"""


@query("a09_vote_sum_mismatches", _MISMATCH, "v_sheet v_sums")
def a09(spark, sf):
    return sums.vote_sum_mismatches(t.v_sheet(spark, sf), t.v_line(spark, sf))


@query("a10_mismatch_by_contest", f"SELECT contest, count(*) AS n FROM ({_MISMATCH}) GROUP BY contest", "v_sheet v_sums")
def a10(spark, sf):
    return sums.mismatch_by_contest(sums.vote_sum_mismatches(t.v_sheet(spark, sf), t.v_line(spark, sf), ordered=False))


@query("c05_check_arithmetic", """
SELECT s.sheet_id, s.station, s.contest_id, v.sum_valid AS sum_parties, s.valid, s.emitted, v.nulls, v.blanks,
  v.sum_valid - s.valid AS diff_valid, v.sum_all - s.emitted AS diff_emitted,
  NOT (abs(v.sum_valid - s.valid) > 1 OR abs(v.sum_all - s.emitted) > 1) AS consistent,
  (abs(v.sum_valid - s.valid) > 1)::INT + (abs(v.sum_all - s.emitted) > 1)::INT AS n_alerts
FROM v_sheet s JOIN v_sums v USING (sheet_id)""", "v_sheet v_sums")
def c05(spark, sf):
    return sums.check_arithmetic(t.v_sheet(spark, sf), t.v_line(spark, sf))


@query("c10_local_vs_official", """
SELECT o.contest_id, o.code, o.name, o.votes AS votes_official, coalesce(l.votes, 0) AS votes_local, coalesce(l.n, 0) AS n_lines,
  o.votes - coalesce(l.votes, 0) AS diff, CASE WHEN o.votes > 0 THEN round((o.votes - coalesce(l.votes, 0)) * 100.0 / o.votes, 2) ELSE 0.0 END AS diff_pct,
  o.pct AS pct_official, abs(CASE WHEN o.votes > 0 THEN round((o.votes - coalesce(l.votes, 0)) * 100.0 / o.votes, 2) ELSE 0.0 END) > 15 AS flagged
FROM v_official o LEFT JOIN (SELECT contest_id, CAST(code AS VARCHAR) AS code, CAST(sum(votes) AS BIGINT) AS votes, count(*) AS n
  FROM v_linec WHERE kind = 'party' GROUP BY 1, 2) l USING (contest_id, code)""", "v_official v_linec")
def c10(spark, sf):
    return parties.local_vs_official(t.v_line_contest(spark, sf), official.official_totals(t.v_official(spark, sf)))


@query("a01_day_distribution", """
SELECT count(*) AS with_log, count(*) FILTER (day = 12) AS day_12, count(*) FILTER (day = 13) AS day_13,
  count(*) FILTER (day = 0) AS other_day FROM v_time_facts""", "v_time_facts")
def a01(spark, sf):
    return timing.day_distribution(_times(spark, sf), t.TEST_DAYS)


@query("a02_contest_day", """
SELECT contest, count(*) FILTER (day = 12) AS day_12, count(*) FILTER (day = 13) AS day_13,
  count(*) FILTER (day = 0) AS other_day FROM v_time_facts JOIN v_sheet USING (sheet_id) GROUP BY contest""", "v_time_facts v_sheet")
def a02(spark, sf):
    return timing.contest_day(_times(spark, sf), t.v_sheet(spark, sf), t.TEST_DAYS)


_HOURS = """
SELECT CAST(h AS INT) AS hour, (SELECT count(*) FROM v_time_facts WHERE scanned_hour = h) AS scanned,
  (SELECT count(*) FROM v_time_facts WHERE counted_hour = h) AS counted,
  (SELECT count(*) FROM v_time_facts WHERE scanned_hour = h AND day = 12) AS scanned_12,
  (SELECT count(*) FROM v_time_facts WHERE scanned_hour = h AND day = 13) AS scanned_13
FROM (SELECT unnest(range(24)) AS h)"""


@query("a03_hour_histogram", _HOURS, "v_time_facts")
def a03(spark, sf):
    return timing.hour_histogram(_times(spark, sf), t.TEST_DAYS)


@query("a03_cumulative_hours", f"""
SELECT *, CAST(sum(scanned_12) OVER (ORDER BY hour) AS BIGINT) AS scanned_12_total,
  CAST(sum(scanned_13) OVER (ORDER BY hour) AS BIGINT) AS scanned_13_total FROM ({_HOURS})""", "v_time_facts")
def a03c(spark, sf):
    return timing.cumulative_hours(timing.hour_histogram(_times(spark, sf), t.TEST_DAYS))


_SPEED = "SELECT sheet_id, round(m, 1) AS minutes, CAST(day AS INT) AS day FROM v_time_facts WHERE m IS NOT NULL"


@query("a04_processing_speed", _SPEED, "v_time_facts")
def a04(spark, sf):
    return timing.processing_speed(_times(spark, sf), t.TEST_DAYS)


@query("a05_speed_stats", f"""
SELECT round(avg(minutes), 1) AS mean_min, round(median(minutes), 1) AS median_min, round(min(minutes), 1) AS min_min,
  round(max(minutes), 1) AS max_min FROM ({_SPEED})""", "v_time_facts")
def a05(spark, sf):
    return timing.speed_stats(timing.processing_speed(_times(spark, sf)))


@query("a06_speed_histogram", f"""
SELECT CAST(floor(minutes / 10) * 10 AS BIGINT) AS from_min, CAST(floor(minutes / 10) * 10 + 10 AS BIGINT) AS to_min,
  count(*) AS n FROM ({_SPEED}) GROUP BY 1, 2""", "v_time_facts")
def a06(spark, sf):
    return timing.speed_histogram(timing.processing_speed(_times(spark, sf)))


@query("a07_timing_anomalies", """
SELECT sheet_id, s.station, s.contest_id, s.contest, category, reason, severity, detail FROM (
  SELECT sheet_id, 'timeline' AS category, 'Procesamiento extremadamente rápido (' || printf('%.1f', round(m, 1)) || ' min)' AS reason,
    'alta' AS severity, scanned_text || ' → ' || counted_text AS detail FROM v_time_facts WHERE m < 1.5
  UNION ALL SELECT sheet_id, 'timeline', 'Proceso inusualmente largo (' || printf('%.1f', round(m / 60, 1)) || ' horas)', 'media',
    scanned_text || ' → ' || counted_text FROM v_time_facts WHERE m > 72 * 60
  UNION ALL SELECT sheet_id, 'horario', 'Digitalización en horario inusual (' || CAST(scanned_hour AS VARCHAR) || ':00 AM hora Perú)', 'baja', scanned_text
    FROM v_time_facts WHERE scanned_hour BETWEEN 1 AND 5) JOIN v_sheet s USING (sheet_id)""", "v_time_facts v_sheet")
def a07(spark, sf):
    return timing.timing_anomalies(_times(spark, sf), t.v_sheet(spark, sf))


@query("a08_day_sheets", """
SELECT sheet_id, s.station, s.contest, scanned_text AS scanned, typed_text AS typed, counted_text AS counted
FROM v_time_facts JOIN v_sheet s USING (sheet_id) WHERE day = 12""", "v_time_facts v_sheet")
def a08(spark, sf):
    return timing.day_sheets(_times(spark, sf), t.v_sheet(spark, sf), 12, t.TEST_DAYS)


@query("a11_party_totals", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY contest_id ORDER BY votes DESC, code) AS INT) AS rank FROM (
  SELECT contest_id, code, max(name) AS name, CAST(sum(votes) AS BIGINT) AS votes, count(*) AS n_lines
  FROM v_linec WHERE kind = 'party' GROUP BY contest_id, code)) WHERE rank <= 15""", "v_linec")
def a11(spark, sf):
    return parties.party_totals(t.v_line_contest(spark, sf), 15)


# The driver's sheets have few lines each, so their shares spread widely; the default 2.5 finds none.
Z_MIN = 1.8

_OUTLIERS = """
SELECT sheet_id, station, contest_id, contest, name, code, votes, round(share, 2) AS share, round(mean, 2) AS mean,
  round(std, 2) AS std, round(abs(share - mean) / std, 2) AS z_score,
  CASE WHEN share > mean THEN 'Porcentaje muy por encima de la media' ELSE 'Porcentaje muy por debajo de la media' END AS reason,
  CASE WHEN abs(share - mean) / std > 4 THEN 'alta' ELSE 'media' END AS severity
FROM (SELECT s.sheet_id, s.station, s.contest_id, s.contest, l.code, l.name, l.votes, l.votes * 100.0 / s.valid AS share,
    avg(l.votes * 100.0 / s.valid) OVER w AS mean, stddev_samp(l.votes * 100.0 / s.valid) OVER w AS std, count(*) OVER w AS n
  FROM v_sheet s JOIN v_line l USING (sheet_id) WHERE l.kind = 'party' AND s.valid <> 0
  WINDOW w AS (PARTITION BY s.contest_id, l.code))
WHERE n >= 3 AND std >= 0.01 AND abs(share - mean) / std >= 1.8"""


@query("a12_party_outliers", f"{_OUTLIERS} ORDER BY z_score DESC, sheet_id, code LIMIT 200", "v_sheet v_line")
def a12(spark, sf):
    return parties.party_outliers(t.v_sheet(spark, sf), t.v_line(spark, sf), z_min=Z_MIN, limit=200)


@query("a12_party_outliers_all", _OUTLIERS, "v_sheet v_line")
def a12all(spark, sf):
    return parties.party_outliers(t.v_sheet(spark, sf), t.v_line(spark, sf), z_min=Z_MIN)


@query("a13_outliers_by_party", f"SELECT name, count(*) AS n FROM ({_OUTLIERS}) GROUP BY name ORDER BY n DESC, name LIMIT 12", "v_sheet v_line")
def a13(spark, sf):
    return parties.outliers_by_party(parties.party_outliers(t.v_sheet(spark, sf), t.v_line(spark, sf), z_min=Z_MIN))


_SIGNALS = """
SELECT sheet_id, station, contest, kind, reason, CAST(points AS BIGINT) AS points FROM (
  SELECT s.*, 'speed' AS kind, CASE WHEN m < 1.5 THEN 'Proceso ultrarrápido (' ELSE 'Proceso muy rápido (' END || printf('%.1f', round(m, 1)) || ' min)' AS reason,
    CASE WHEN m < 1.5 THEN 50 ELSE 20 END AS points FROM v_sheet s JOIN v_time_facts f USING (sheet_id) WHERE m < 5
  UNION ALL SELECT s.*, 'hour', 'Digitalización a las ' || lpad(CAST(scanned_hour AS VARCHAR), 2, '0') || ':xx AM (hora Perú)', 15
    FROM v_sheet s JOIN v_time_facts f USING (sheet_id) WHERE scanned_hour BETWEEN 1 AND 5
  UNION ALL SELECT s.*, 'sum', 'Suma de votos no coincide (Δ=' || CAST(abs(v.sum_all - emitted) AS VARCHAR) || ')', 30 + abs(v.sum_all - emitted)
    FROM v_sheet s JOIN v_sums v USING (sheet_id) WHERE emitted <> 0 AND v.sum_all <> emitted
  UNION ALL SELECT s.*, 'turnout', CASE WHEN emitted * 100.0 / eligible > 98 THEN 'Participación sospechosamente alta (' ELSE 'Participación muy alta (' END
      || printf('%.1f', round(emitted * 100.0 / eligible, 1)) || '%)', CASE WHEN emitted * 100.0 / eligible > 98 THEN 25 ELSE 10 END
    FROM v_sheet s WHERE eligible <> 0 AND emitted <> 0 AND emitted * 100.0 / eligible > 95)"""


def _signals(spark, sf):
    return ranking.suspicion_signals(t.v_sheet(spark, sf), t.v_line(spark, sf), _times(spark, sf))


@query("a14_suspicion_signals", _SIGNALS, "v_sheet v_sums v_time_facts")
def a14s(spark, sf):
    return _signals(spark, sf)


@query("a14_suspicion_ranking", f"""
SELECT station, contest, CAST(sum(points) AS BIGINT) AS score, CAST(sum(n) AS BIGINT) AS n_signals,
  string_agg(kind || 'x' || CAST(n AS VARCHAR), ',' ORDER BY kind) AS signals FROM (
  SELECT station, contest, kind, sum(points) AS points, count(*) AS n FROM ({_SIGNALS}) GROUP BY 1, 2, 3) GROUP BY 1, 2
ORDER BY score DESC, station, contest LIMIT 50""", "v_sheet v_sums v_time_facts")
def a14(spark, sf):
    return ranking.suspicion_ranking(_signals(spark, sf))


@query("a14_suspicion_reasons", f"""
SELECT sheet_id, station, contest, CAST(sum(points) AS BIGINT) AS score,
  string_agg(reason || ' +' || CAST(points AS VARCHAR), '; ' ORDER BY kind) AS signals FROM ({_SIGNALS}) GROUP BY 1, 2, 3""", "v_sheet v_sums v_time_facts")
def a14r(spark, sf):
    return ranking.suspicion_reasons(_signals(spark, sf), None).withColumn("signals", F.array_join(F.transform(
        "signals", lambda s: F.concat(s["reason"], F.lit(" +"), s["points"].cast("string"))), "; "))


@query("a15_audit_summary", """
SELECT count(*) AS sheets, count(f.sheet_id) AS with_log, count(*) FILTER (f.day = 12) AS day_12, count(*) FILTER (f.day = 13) AS day_13,
  count(*) FILTER (f.day = 0) AS unknown_day, count(*) FILTER (emitted <> 0 AND v.sum_all <> emitted) AS sum_mismatches,
  count(*) FILTER (m < 1.5) AS fast_sheets
FROM v_sheet s JOIN v_sums v USING (sheet_id) LEFT JOIN v_time_facts f USING (sheet_id)""", "v_sheet v_sums v_time_facts")
def a15(spark, sf):
    return ranking.audit_summary(t.v_sheet(spark, sf), t.v_line(spark, sf), _times(spark, sf), t.TEST_DAYS)


_TURNOUT = """
SELECT sheet_id, station, contest, emitted, eligible, round(emitted * 100.0 / eligible, 3) AS pct,
  round(CASE WHEN declared_pct <> 0 THEN declared_pct END, 3) AS declared_pct FROM v_sheet WHERE eligible > 0"""


@query("a16_turnout", _TURNOUT, "v_sheet")
def a16(spark, sf):
    return turnout.turnout(t.v_sheet(spark, sf))


@query("a16_turnout_top", f"{_TURNOUT} ORDER BY pct DESC, sheet_id LIMIT 100", "v_sheet")
def a16top(spark, sf):
    return turnout.turnout(t.v_sheet(spark, sf), 100)


_RULES = """
SELECT sheet_id, station, contest, 'votos_excedentes' AS category, 'Votos emitidos (' || CAST(emitted AS VARCHAR) || ') > electores hábiles (' || CAST(eligible AS VARCHAR) || ')' AS reason, 'alta' AS severity
  FROM v_sheet WHERE eligible <> 0 AND emitted > eligible
UNION ALL SELECT sheet_id, station, contest, 'sobre_capacidad', 'Votos (' || CAST(emitted AS VARCHAR) || ') superan máximo de 300 por mesa', CASE WHEN emitted > 330 THEN 'alta' ELSE 'media' END
  FROM v_sheet WHERE emitted > 300
UNION ALL SELECT sheet_id, station, contest, 'participacion_imposible', 'Participación ' || printf('%.1f', round(emitted * 100.0 / eligible, 1)) || '% > 100%', 'alta'
  FROM v_sheet WHERE eligible > 0 AND emitted * 100.0 / eligible > 100
UNION ALL SELECT sheet_id, station, contest, 'pct_inconsistente', '% participación declarado (' || printf('%.1f', round(declared_pct, 1)) || '%) ≠ calculado (' || printf('%.1f', round(emitted * 100.0 / eligible, 1)) || '%)',
    CASE WHEN abs(emitted * 100.0 / eligible - declared_pct) > 5 THEN 'alta' ELSE 'media' END
  FROM v_sheet WHERE eligible > 0 AND abs(emitted * 100.0 / eligible - declared_pct) > 1.0"""


@query("a17_turnout_rules", _RULES, "v_sheet")
def a17(spark, sf):
    return turnout.turnout_rules(t.v_sheet(spark, sf))


_ZSCORES = """
SELECT sheet_id, station, contest, 'outlier_estadistico' AS category, 'Participación ' || printf('%.1f', round(pct, 1)) || '% muy '
  || CASE WHEN pct > mean THEN 'alta' ELSE 'baja' END || ' (media=' || printf('%.1f', round(mean, 1)) || '%, z=' || printf('%.2f', round(abs(pct - mean) / std, 2)) || 'σ)' AS reason,
  CASE WHEN abs(pct - mean) / std > 4 THEN 'alta' ELSE 'media' END AS severity
FROM (SELECT *, round(emitted * 100.0 / eligible, 3) AS pct, avg(emitted * 100.0 / eligible) OVER () AS mean,
        stddev_samp(emitted * 100.0 / eligible) OVER () AS std, count(*) OVER () AS n FROM v_sheet WHERE eligible > 0)
WHERE n >= 10 AND std > 0.01 AND abs(pct - mean) / std > 2.5"""


@query("a18_turnout_outliers", _ZSCORES, "v_sheet")
def a18(spark, sf):
    return turnout.turnout_outliers(t.v_sheet(spark, sf))


@query("a19_turnout_reconcile", """
SELECT n_sheets, sum_emitted, sum_eligible, mean_pct, std_pct, electors, present, absent, greatest(0, electors - present - absent) AS pending,
  coalesce(round((electors - present - absent) * 100.0 / nullif(electors, 0), 3), 0.0) AS pending_pct, sum_emitted - present AS gap_votes,
  round((sum_emitted - present) * 100.0 / present, 3) AS gap_pct, abs(round((sum_emitted - present) * 100.0 / present, 3)) > 5 AS gap_alert,
  round(sum_eligible * 100.0 / electors, 2) AS coverage_pct
FROM (SELECT count(*) AS n_sheets, CAST(sum(emitted) AS BIGINT) AS sum_emitted, CAST(sum(eligible) AS BIGINT) AS sum_eligible,
  round(avg(emitted * 100.0 / eligible), 2) AS mean_pct, round(stddev_samp(emitted * 100.0 / eligible), 2) AS std_pct,
  CAST(sum(eligible) * 2 AS BIGINT) AS electors, CAST(floor(sum(emitted) * 1.1) AS BIGINT) AS present,
  CAST(floor(sum(emitted) * 0.2) AS BIGINT) AS absent FROM v_sheet)""", "v_sheet")
def a19(spark, sf):
    return turnout.turnout_reconcile(t.v_sheet(spark, sf), _official_turnout(spark, sf))


@query("a20_turnout_histogram", """
SELECT CAST(floor(emitted * 100.0 / eligible / 5) * 5 AS BIGINT) AS from_pct, CAST(floor(emitted * 100.0 / eligible / 5) * 5 + 5 AS BIGINT) AS to_pct,
  count(*) AS n FROM v_sheet WHERE eligible > 0 GROUP BY 1, 2""", "v_sheet")
def a20(spark, sf):
    return turnout.turnout_histogram(t.v_sheet(spark, sf))


@query("a21_turnout_anomalies", f"{_RULES} UNION ALL {_ZSCORES}", "v_sheet")
def a21(spark, sf):
    return turnout.turnout_anomalies(t.v_sheet(spark, sf))


@query("a22_event_timeline", """
SELECT * FROM (
  SELECT o_orderkey AS sheet_id, 'digitalizacion' AS event, CASE WHEN o_orderkey % 3 = 0 THEN 'fechaDigitacion' ELSE 'fechaDigitalizacion' END AS field,
    strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS description FROM orders
  UNION ALL SELECT o_orderkey, 'observacion', 'fechaObservacion', strftime(o_orderdate, '%Y-%m'), o_orderstatus FROM orders WHERE o_orderpriority LIKE '1%'
  UNION ALL SELECT o_orderkey, 'estado_actual', NULL, '', o_orderstatus FROM orders)""")
def a22(spark, sf):
    events = t.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS sheet_id", "o_orderstatus AS state",
        "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS fechaDigitalizacion",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS fechaDigitacion",
        "CASE WHEN o_orderpriority LIKE '1%' THEN date_format(o_orderdate, 'yyyy-MM') END AS fechaObservacion")
    return ranking.event_timeline(events)
