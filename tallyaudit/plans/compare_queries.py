"""Source comparison, digit cells."""

from pyspark.sql import functions as F

from ..operators import cells, compare
from ..sources import tables as t
from .catalog import query

_OFF = """off AS (SELECT sheet_id, code, upper(replace(name, 'ó', 'o')) AS party, votes FROM v_line WHERE kind = 'party'),
rd AS (SELECT sheet_id, pos AS code, name AS reader_name, votes AS reader_votes FROM v_reader),
rd2 AS (SELECT sheet_id, pos AS code, name AS google_name, votes AS google FROM v_reader2)"""

_TOTALS = """tot AS (
  SELECT sheet_id, 'Electores Hábiles' AS field, s.eligible AS official, x.electors AS r1, y.electors AS r2 FROM v_sheet s LEFT JOIN v_extract x USING (sheet_id) LEFT JOIN v_extract2 y USING (sheet_id)
  UNION ALL SELECT sheet_id, 'Total Votantes', s.emitted, x.voters, y.voters FROM v_sheet s LEFT JOIN v_extract x USING (sheet_id) LEFT JOIN v_extract2 y USING (sheet_id)
  UNION ALL SELECT sheet_id, 'Votos Válidos', s.valid, x.valid, y.valid FROM v_sheet s LEFT JOIN v_extract x USING (sheet_id) LEFT JOIN v_extract2 y USING (sheet_id))"""

_VIEWS = "v_line v_reader v_reader2 v_sheet v_extract v_extract2"


def _x2(spark, sf):
    return t.v_extract(spark, sf, 41, 47)


@query("c01_compare_totals", f"""WITH {_TOTALS}
SELECT sheet_id, field, official, r1 AS reader, abs(official - r1) AS abs_diff, official = r1 AS equal FROM tot WHERE official IS NOT NULL AND r1 IS NOT NULL""", _VIEWS)
def c01(spark, sf):
    return compare.compare_totals(t.v_sheet(spark, sf), t.v_extract(spark, sf))


@query("c02_compare_parties", f"""WITH {_OFF}
SELECT sheet_id, party, reader_name, votes, reader_votes, votes - reader_votes AS diff, votes = reader_votes AS equal FROM off LEFT JOIN rd USING (sheet_id, code)""", _VIEWS)
def c02(spark, sf):
    return compare.compare_parties(t.v_line(spark, sf), t.v_reader(spark, sf))


def _shuffled(spark, sf):
    """Reader lines a third of which carry a foreign party's name."""
    return t.v_reader(spark, sf).withColumn("name", F.expr(
        "CASE WHEN (sheet_id + pos) % 3 = 0 THEN concat('PARTIDO LOCAL ', sheet_id % 50) ELSE name END"))


@query("c03_unmatched", f"""WITH {_OFF}, odd AS (
  SELECT sheet_id, code, CASE WHEN (sheet_id + code) % 3 = 0 THEN NULL ELSE reader_name END AS hit, reader_votes,
    'PARTIDO LOCAL ' || CAST(sheet_id % 50 AS VARCHAR) AS odd_name FROM rd)
SELECT sheet_id, 'official' AS source, party AS name, votes FROM off LEFT JOIN odd USING (sheet_id, code) WHERE hit IS NULL
UNION ALL SELECT sheet_id, 'reader', odd_name, arg_max(reader_votes, code) FROM odd WHERE hit IS NULL GROUP BY sheet_id, odd_name""", _VIEWS)
def c03(spark, sf):
    return compare.unmatched(t.v_line(spark, sf), _shuffled(spark, sf))


_ALERTS = f"""{_OFF}, {_TOTALS}, alerts AS (
  SELECT sheet_id, field, 'alerta' AS level, official, r1 AS reader FROM tot WHERE official <> r1
  UNION ALL SELECT sheet_id, 'Votos ' || party, CASE WHEN abs(votes - reader_votes) > 5 THEN 'alerta' ELSE 'info' END, votes, reader_votes
    FROM off JOIN rd USING (sheet_id, code) WHERE votes <> reader_votes)"""


@query("c04_compare_alerts", f"WITH {_ALERTS} SELECT * FROM alerts", _VIEWS)
def c04a(spark, sf):
    return compare.compare_alerts(t.v_sheet(spark, sf), t.v_line(spark, sf), t.v_extract(spark, sf), t.v_reader(spark, sf))


_STATUS = f"""WITH {_ALERTS}
SELECT s.sheet_id, s.station, s.contest_id, coalesce(o.so, 0) AS sum_official, coalesce(r.sr, 0) AS sum_reader,
  abs(coalesce(o.so, 0) - coalesce(r.sr, 0)) AS abs_diff, coalesce(a.n, 0) AS n_discrepancies, CASE WHEN a.n IS NULL THEN 'ok' WHEN a.bad THEN 'alerta' ELSE 'info' END AS status
FROM v_sheet s LEFT JOIN (SELECT sheet_id, CAST(sum(votes) AS BIGINT) AS so FROM off GROUP BY 1) o USING (sheet_id)
LEFT JOIN (SELECT sheet_id, CAST(sum(reader_votes) AS BIGINT) AS sr FROM rd GROUP BY 1) r USING (sheet_id)
LEFT JOIN (SELECT sheet_id, count(*) AS n, bool_or(level = 'alerta') AS bad FROM alerts GROUP BY 1) a USING (sheet_id)"""


@query("c04_compare_status", _STATUS, _VIEWS)
def c04(spark, sf):
    return compare.compare_status(t.v_sheet(spark, sf), t.v_line(spark, sf), t.v_extract(spark, sf), t.v_reader(spark, sf))


_CONSENSUS = f"""{_OFF}, {_TOTALS}, both_rows AS (
  SELECT sheet_id, 'total' AS section, field, official, r1 AS local, r2 AS google FROM tot WHERE official IS NOT NULL
  UNION ALL SELECT sheet_id, 'party', party, votes, reader_votes, google FROM off LEFT JOIN rd USING (sheet_id, code) LEFT JOIN rd2 USING (sheet_id, code)),
cons AS (SELECT *, coalesce(official = local, FALSE) AS same_local, coalesce(official = google, FALSE) AS same_google,
  coalesce(official = local, FALSE) OR coalesce(official = google, FALSE) AS agree,
  NOT (coalesce(official = local, FALSE) OR coalesce(official = google, FALSE)) AND NOT (section = 'party' AND local IS NULL AND google IS NULL) AS alert FROM both_rows)"""


def _consensus(spark, sf):
    return compare.compare_consensus(t.v_sheet(spark, sf), t.v_line(spark, sf), t.v_extract(spark, sf), _x2(spark, sf),
                                     t.v_reader(spark, sf), t.v_reader2(spark, sf))


@query("c06_compare_consensus", f"WITH {_CONSENSUS} SELECT * FROM cons", _VIEWS)
def c06(spark, sf):
    return _consensus(spark, sf)


_CONSENSUS_STATUS = f"""WITH {_CONSENSUS}
SELECT sheet_id, count(*) FILTER (NOT agree) AS n_discrepancies, count(*) FILTER (alert) AS n_alerts,
  CASE WHEN count(*) FILTER (NOT agree) > 0 THEN 'alerta' ELSE 'ok' END AS status FROM cons GROUP BY sheet_id"""


@query("c06_consensus_status", _CONSENSUS_STATUS, _VIEWS)
def c06s(spark, sf):
    return compare.consensus_status(_consensus(spark, sf))


@query("c06_only_reader", f"""WITH {_OFF}
SELECT DISTINCT sheet_id, 'PARTIDO LOCAL ' || CAST(sheet_id % 50 AS VARCHAR) AS reader_name FROM rd WHERE (sheet_id + code) % 3 = 0""", _VIEWS)
def c06o(spark, sf):
    return compare.consensus_only_reader(t.v_line(spark, sf), _shuffled(spark, sf), t.v_reader2(spark, sf))


@query("c07_comparison_table", f"""WITH {_CONSENSUS}, wide AS (
  SELECT sheet_id, section, field, official, local, google FROM both_rows
  UNION ALL SELECT sheet_id, 'total', CASE kind WHEN 'null' THEN 'Votos Nulos' ELSE 'Votos en Blanco' END, votes, NULL, NULL FROM v_line WHERE kind IN ('null', 'blank')),
flagged AS (SELECT *, coalesce(official = local, FALSE) AS a, coalesce(official = google, FALSE) AS b FROM wide)
SELECT sheet_id, section, field, official, local, google,
  CASE WHEN local IS NULL AND google IS NULL THEN '⚠' WHEN a AND b THEN '✓ ambos' WHEN a THEN '✓ local' WHEN b THEN '✓ google'
    ELSE concat_ws(' ', CASE WHEN local IS NOT NULL THEN 'L:' || CASE WHEN official > local THEN '+' ELSE '' END || CAST(official - local AS VARCHAR) END,
                        CASE WHEN google IS NOT NULL THEN 'G:' || CASE WHEN official > google THEN '+' ELSE '' END || CAST(official - google AS VARCHAR) END) END AS state,
  count(*) FILTER (section = 'party' AND NOT (a OR b)) OVER (PARTITION BY sheet_id) AS n_no_consensus
FROM flagged""", _VIEWS)
def c07(spark, sf):
    return compare.comparison_table(t.v_sheet(spark, sf), t.v_line(spark, sf), t.v_extract(spark, sf), _x2(spark, sf),
                                    t.v_reader(spark, sf), t.v_reader2(spark, sf))


@query("c08_comparison_table_simple", f"""WITH {_OFF}, odd AS (
  SELECT sheet_id, code, CASE WHEN (sheet_id + code) % 3 = 0 THEN NULL ELSE reader_votes END AS v, reader_votes,
    'PARTIDO LOCAL ' || CAST(sheet_id % 50 AS VARCHAR) AS odd_name FROM rd)
SELECT *, CASE WHEN official IS NULL OR reader IS NULL THEN '⚠' WHEN official = reader THEN '✓'
  ELSE CASE WHEN official > reader THEN '+' ELSE '' END || CAST(official - reader AS VARCHAR) END AS state FROM (
  SELECT sheet_id, party AS field, votes AS official, v AS reader FROM off LEFT JOIN odd USING (sheet_id, code)
  UNION ALL SELECT sheet_id, odd_name, NULL, arg_max(reader_votes, code) FROM odd WHERE v IS NULL GROUP BY sheet_id, odd_name)""", _VIEWS)
def c08(spark, sf):
    return compare.comparison_table_simple(t.v_line(spark, sf), _shuffled(spark, sf))


for _mode, _sql in (("simple", _STATUS), ("hibrido", _CONSENSUS_STATUS)):
    @query(f"c09_compare_{_mode}", _sql, _VIEWS)
    def c09(spark, sf, mode=_mode):
        return compare.compare(mode, t.v_sheet(spark, sf), t.v_line(spark, sf), [t.v_extract(spark, sf), _x2(spark, sf)],
                               [t.v_reader(spark, sf), t.v_reader2(spark, sf)])


# ---- digit cells --------------------------------------------------------------------------------

_TEMPLATES = """cand AS (
  SELECT sheet_id, row_idx, 'unit' AS kind, CAST(d2 AS VARCHAR) AS pattern FROM v_cells_wide WHERE d0 IS NULL AND d1 IS NULL AND d2 IS NOT NULL AND ink > 145
  UNION ALL SELECT sheet_id, row_idx, 'col0', CAST(d0 AS VARCHAR) FROM v_cells_wide WHERE d0 IS NOT NULL AND c0 >= 0.85
  UNION ALL SELECT sheet_id, row_idx, 'col1', CAST(d1 AS VARCHAR) FROM v_cells_wide WHERE d1 IS NOT NULL
  UNION ALL SELECT sheet_id, row_idx, 'col2', CAST(d2 AS VARCHAR) FROM v_cells_wide WHERE d2 IS NOT NULL
  UNION ALL SELECT sheet_id, row_idx, 'triple', concat_ws('-', d0, d1, d2) FROM v_cells_wide WHERE d0 IS NOT NULL AND d1 IS NOT NULL AND d2 IS NOT NULL AND ink > 120
  UNION ALL SELECT sheet_id, row_idx, 'd01', concat_ws('-', d0, d1) FROM v_cells_wide WHERE d0 IS NOT NULL AND d1 IS NOT NULL AND d2 IS NULL AND ink > 120
  UNION ALL SELECT sheet_id, row_idx, 'd12', concat_ws('-', d1, d2) FROM v_cells_wide WHERE d0 IS NULL AND d1 IS NOT NULL AND d2 IS NOT NULL AND ink > 120),
tpl AS (SELECT sheet_id, kind, pattern, n FROM (
    SELECT sheet_id, kind, pattern, count(*) AS n, min(row_idx) AS f FROM cand GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY sheet_id, kind ORDER BY count(*) DESC, min(row_idx)) = 1)
  JOIN (SELECT sheet_id, count(*) AS rows FROM v_cells_wide GROUP BY 1) USING (sheet_id)
  WHERE CASE WHEN kind = 'unit' THEN n >= 3 WHEN kind LIKE 'col%' THEN n >= rows * 0.7 ELSE n >= 4 END)"""


def _wide(spark, sf):
    return cells.wide_cells(t.v_cells(spark, sf))


for _name, _fn, _cond in (("d01_printed_units", cells.printed_units, "kind = 'unit'"),
                          ("d02_printed_columns", cells.printed_columns, "kind LIKE 'col%'"),
                          ("d03_printed_groups", cells.printed_groups, "kind IN ('triple', 'd01', 'd12')")):
    @query(_name, f"WITH {_TEMPLATES} SELECT * FROM tpl WHERE {_cond}", "v_cells_wide")
    def d0x(spark, sf, fn=_fn):
        return fn(_wide(spark, sf))


_APPLIED = f"""{_TEMPLATES}, flat AS (SELECT w.*, u.pattern AS tu, a.pattern AS ta, b.pattern AS tb, c.pattern AS tc, x.pattern AS tx, y.pattern AS ty, z.pattern AS tz
  FROM v_cells_wide w LEFT JOIN tpl u ON u.sheet_id = w.sheet_id AND u.kind = 'unit' LEFT JOIN tpl a ON a.sheet_id = w.sheet_id AND a.kind = 'col0'
  LEFT JOIN tpl b ON b.sheet_id = w.sheet_id AND b.kind = 'col1' LEFT JOIN tpl c ON c.sheet_id = w.sheet_id AND c.kind = 'col2'
  LEFT JOIN tpl x ON x.sheet_id = w.sheet_id AND x.kind = 'triple' LEFT JOIN tpl y ON y.sheet_id = w.sheet_id AND y.kind = 'd01'
  LEFT JOIN tpl z ON z.sheet_id = w.sheet_id AND z.kind = 'd12'),
ra AS (SELECT *, d0 IS NULL AND d1 IS NULL AND d2 IS NOT NULL AND coalesce(CAST(d2 AS VARCHAR) = tu, FALSE) AS h FROM flat),
r0 AS (SELECT * EXCLUDE (h, d2), CASE WHEN h THEN NULL ELSE d2 END AS d2, CASE WHEN h THEN 'tpl_D2' ELSE '' END AS note FROM ra),
g0 AS (SELECT * EXCLUDE (d0, note), CASE WHEN coalesce(CAST(d0 AS VARCHAR) = ta, FALSE) THEN NULL ELSE d0 END AS d0, CASE WHEN coalesce(CAST(d0 AS VARCHAR) = ta, FALSE) THEN 'tpl_col0' ELSE note END AS note FROM r0),
g1 AS (SELECT * EXCLUDE (d1, note), CASE WHEN coalesce(CAST(d1 AS VARCHAR) = tb, FALSE) THEN NULL ELSE d1 END AS d1,
  CASE WHEN coalesce(CAST(d1 AS VARCHAR) = tb, FALSE) THEN CASE WHEN note <> '' THEN note || '+tpl_col1' ELSE 'tpl_col1' END ELSE note END AS note FROM g0),
g2 AS (SELECT * EXCLUDE (d2, note), CASE WHEN coalesce(CAST(d2 AS VARCHAR) = tc, FALSE) THEN NULL ELSE d2 END AS d2,
  CASE WHEN coalesce(CAST(d2 AS VARCHAR) = tc, FALSE) THEN CASE WHEN note <> '' THEN note || '+tpl_col2' ELSE 'tpl_col2' END ELSE note END AS note FROM g1),
rb AS (SELECT * EXCLUDE (d1, note), CASE WHEN d0 IS NULL AND d2 IS NULL AND d1 IS NOT NULL AND ink > 145 THEN NULL ELSE d1 END AS d1,
  CASE WHEN d0 IS NULL AND d2 IS NULL AND d1 IS NOT NULL AND ink > 145 THEN 'iso_D1' ELSE note END AS note FROM g2),
rd AS (SELECT *, d0 IS NOT NULL AND d1 IS NOT NULL AND d2 IS NOT NULL AND coalesce(concat_ws('-', d0, d1, d2) = tx, FALSE) AND ink > 120 AS h FROM rb),
rd2 AS (SELECT * EXCLUDE (h, d0, d1, d2, note), CASE WHEN h THEN NULL ELSE d0 END AS d0, CASE WHEN h THEN NULL ELSE d1 END AS d1, CASE WHEN h THEN NULL ELSE d2 END AS d2,
  CASE WHEN h THEN 'tpl_triple' ELSE note END AS note FROM rd),
re AS (SELECT *, d0 IS NOT NULL AND d1 IS NOT NULL AND d2 IS NULL AND coalesce(concat_ws('-', d0, d1) = ty, FALSE) AND ink > 120 AS h FROM rd2),
re2 AS (SELECT * EXCLUDE (h, d0, d1, note), CASE WHEN h THEN NULL ELSE d0 END AS d0, CASE WHEN h THEN NULL ELSE d1 END AS d1, CASE WHEN h THEN 'tpl_D01' ELSE note END AS note FROM re),
rf AS (SELECT *, d0 IS NULL AND d1 IS NOT NULL AND d2 IS NOT NULL AND coalesce(concat_ws('-', d1, d2) = tz, FALSE) AND ink > 120 AS h FROM re2),
applied AS (SELECT sheet_id, row_idx, TRY_CAST(nullif(concat_ws('', d0, CASE WHEN h THEN NULL ELSE d1 END, CASE WHEN h THEN NULL ELSE d2 END), '') AS INT) AS value,
  CASE WHEN h THEN 'tpl_D12' ELSE note END AS note FROM rf)"""


@query("d04_apply_templates", f"WITH {_APPLIED} SELECT * FROM applied", "v_cells_wide")
def d04(spark, sf):
    return cells.apply_templates(_wide(spark, sf))


@query("d05_drop_dominant", f"""WITH {_APPLIED}, top AS (
  SELECT sheet_id, value, n, sum(n) OVER (PARTITION BY sheet_id) AS total, row_number() OVER (PARTITION BY sheet_id ORDER BY n DESC, f) AS k FROM (
    SELECT sheet_id, value, count(*) AS n, min(row_idx) AS f FROM applied WHERE value > 0 GROUP BY 1, 2))
SELECT a.sheet_id, a.row_idx, CASE WHEN t.value IS NULL OR a.value IS NULL OR a.value <> t.value THEN a.value END AS value,
  CASE WHEN a.value = t.value THEN CASE WHEN note <> '' THEN note || ' ' ELSE '' END || 'sanity_dup' ELSE note END AS note
FROM applied a LEFT JOIN (SELECT * FROM top WHERE k = 1 AND total >= 6 AND n >= total * 0.5) t USING (sheet_id)""", "v_cells_wide")
def d05(spark, sf):
    return cells.drop_dominant(cells.apply_templates(_wide(spark, sf)))


@query("d06_compose_plain", """
SELECT sheet_id, row_idx, TRY_CAST(nullif(concat_ws('', d0, d1, d2), '') AS INT) AS value FROM v_cells_wide""", "v_cells_wide")
def d06(spark, sf):
    return cells.compose_plain(_wide(spark, sf))
