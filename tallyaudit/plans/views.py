"""The input tables of ``sources.tables`` once more, as SQL views for the comparison engine."""

from ..sources.dims import BALLOT, CONTESTS

_BALLOT_ROWS = ", ".join(f"({r}, '{n or 'CANDIDATO LIBRE'}', {'TRUE' if n else 'FALSE'})" for r, n in BALLOT)
_CONTEST_ROWS = ", ".join(f"({i}, '{n}')" for i, n in CONTESTS)


def _reader(a: int, b: int, c: int) -> str:
    return f"""SELECT sheet_id, code AS pos, upper(replace(concat(name, ' FRENTE'), 'ó', 'o')) AS name,
      votes + CASE WHEN (sheet_id*7+code) % {a} = 0 THEN 6 WHEN (sheet_id*7+code) % {b} = 0 THEN 2 ELSE 0 END AS votes
    FROM v_line WHERE kind = 'party' AND (sheet_id*7+code) % {c} <> 0"""


def _extract(a: int, b: int) -> str:
    return f"""SELECT sheet_id,
      CASE WHEN sheet_id % {a} = 0 THEN NULL WHEN sheet_id % {b} = 0 THEN eligible + 5 ELSE eligible END AS electors,
      CASE WHEN sheet_id % {a + 12} = 0 THEN NULL WHEN sheet_id % {b - 8} = 0 THEN emitted + 1 ELSE emitted END AS voters,
      CASE WHEN sheet_id % {a + 16} = 0 THEN NULL WHEN sheet_id % {b + 16} = 0 THEN valid - 1 ELSE valid END AS valid
    FROM v_sheet"""


# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "ballot": ([], f"SELECT * FROM (VALUES {_BALLOT_ROWS}) AS t(row, name, real)"),
    "contests": ([], f"SELECT * FROM (VALUES {_CONTEST_ROWS}) AS t(contest_id, contest_label)"),
    "v_line": ([], """
      SELECT sheet_id, code, max(kind) AS kind, max(name) AS name, CAST(sum(votes) AS BIGINT) AS votes FROM (
        SELECT l_orderkey AS sheet_id, CAST(l_quantity AS INT) AS votes,
          CASE l_linenumber WHEN 5 THEN 'challenged' WHEN 6 THEN 'blank' WHEN 7 THEN 'null' ELSE 'party' END AS kind,
          CASE l_linenumber WHEN 5 THEN 90 WHEN 6 THEN 80 WHEN 7 THEN 81 ELSE CAST(l_suppkey % 25 AS INT) + 1 END AS code,
          CASE l_linenumber WHEN 5 THEN 'VOTOS IMPUGNADOS' WHEN 6 THEN 'VOTOS EN BLANCO' WHEN 7 THEN 'VOTOS NULOS'
               ELSE concat('Agrupación NATION_', CAST(l_suppkey % 25 AS VARCHAR)) END AS name
        FROM lineitem) q GROUP BY sheet_id, code"""),
    "v_sheet": (["v_line"], """
      SELECT z.*, round(100.0 * emitted / nullif(eligible, 0), 1)
        + CASE WHEN sheet_id % 40 = 0 THEN 2.5 WHEN sheet_id % 41 = 0 THEN 7 ELSE 0 END AS declared_pct FROM (
      SELECT o.o_orderkey AS sheet_id, lpad(CAST(o.o_custkey AS VARCHAR), 6, '0') AS station,
        CASE substr(o.o_orderpriority,1,1) WHEN '1' THEN 10 WHEN '2' THEN 12 WHEN '3' THEN 13 WHEN '4' THEN 14 ELSE 15 END AS contest_id,
        o.o_orderpriority AS contest, o.o_orderstatus AS state, o.o_orderdate AS captured_at,
        CAST(t.s_all + CASE o.o_orderkey % 50 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS emitted,
        CAST(t.s_party + CASE WHEN o.o_orderkey % 70 = 0 THEN 2 ELSE 0 END AS BIGINT) AS valid,
        CAST(CASE WHEN o.o_orderkey % 60 = 0 THEN t.s_all - 1 ELSE t.s_all + 10 + o.o_orderkey % 90 END AS BIGINT) AS eligible
      FROM orders o JOIN (SELECT sheet_id, sum(votes) AS s_all, sum(CASE WHEN kind='party' THEN votes ELSE 0 END) AS s_party
                          FROM v_line GROUP BY sheet_id) t ON t.sheet_id = o.o_orderkey) z"""),
    "v_linec": (["v_line", "v_sheet"],
                "SELECT l.*, s.station, s.contest_id, s.contest FROM v_line l JOIN v_sheet s USING (sheet_id)"),
    "v_sums": (["v_line"], """
      SELECT sheet_id, CAST(sum(votes) AS BIGINT) AS sum_all,
        CAST(sum(CASE WHEN kind='party' THEN votes ELSE 0 END) AS BIGINT) AS sum_valid,
        CAST(sum(CASE WHEN kind='null' THEN votes ELSE 0 END) AS BIGINT) AS nulls,
        CAST(sum(CASE WHEN kind='blank' THEN votes ELSE 0 END) AS BIGINT) AS blanks,
        CAST(sum(CASE WHEN kind='challenged' THEN votes ELSE 0 END) AS BIGINT) AS challenged
      FROM v_line GROUP BY sheet_id"""),
    "v_reader": (["v_line"], _reader(97, 89, 83)),
    "v_reader2": (["v_line"], _reader(101, 79, 73)),
    "v_extract": (["v_sheet"], _extract(31, 37)),
    "v_extract2": (["v_sheet"], _extract(41, 47)),
    "v_timeline": ([], """
      SELECT user_id AS sheet_id, event_id AS pos, epoch_us(ts) // 1000 AS ts_ms,
        CASE event_type WHEN 'view' THEN 'T' WHEN 'click' THEN 'D' WHEN 'purchase' THEN 'C' WHEN 'error' THEN 'O' ELSE 'J' END AS state_code
      FROM events"""),
    "v_times": (["v_timeline"], """
      SELECT sheet_id, arg_max(ts_ms, pos) FILTER (state_code='T') AS scanned_ms,
        arg_max(ts_ms, pos) FILTER (state_code='D') AS typed_ms, arg_max(ts_ms, pos) FILTER (state_code='C') AS counted_ms,
        arg_max(ts_ms, pos) FILTER (state_code='O') AS observed_ms, arg_max(ts_ms, pos) FILTER (state_code='J') AS sent_jee_ms
      FROM v_timeline GROUP BY sheet_id"""),
    "v_time_facts": (["v_times"], """
      SELECT t.*, CASE WHEN r IS NULL THEN 0 WHEN r // 1000 >= 1706486400 AND r // 1000 < 1706572800 THEN 12
          WHEN r // 1000 >= 1706572800 AND r // 1000 < 1706659200 THEN 13 ELSE 0 END AS day,
        (counted_ms - scanned_ms) / 60000.0 AS m,
        CAST(((scanned_ms // 1000 - 18000) % 86400) // 3600 AS INT) AS scanned_hour,
        CAST(((counted_ms // 1000 - 18000) % 86400) // 3600 AS INT) AS counted_hour,
        strftime(make_timestamp((scanned_ms // 1000 - 18000) * 1000000), '%d/%m/%Y %H:%M:%S') AS scanned_text,
        strftime(make_timestamp((typed_ms // 1000 - 18000) * 1000000), '%d/%m/%Y %H:%M:%S') AS typed_text,
        strftime(make_timestamp((counted_ms // 1000 - 18000) * 1000000), '%d/%m/%Y %H:%M:%S') AS counted_text
      FROM (SELECT *, coalesce(scanned_ms, typed_ms, counted_ms) AS r FROM v_times) t"""),
    "v_sweep": ([], """
      SELECT 'job_1' AS job_id, event_id AS station_no,
        CASE event_type WHEN 'view' THEN 'EXISTE_CON_PDF' WHEN 'click' THEN 'EXISTE_SIN_PDF' WHEN 'purchase' THEN 'PARA_JEE'
             WHEN 'error' THEN 'NO_EXISTE' ELSE 'OBSERVADA' END AS status, ts FROM events"""),
    "v_result_log": ([], """
      SELECT event_id AS result_id, event_id - event_id % 3 AS sheet_id, event_type IN ('view','click') AS scanned,
        CASE event_type WHEN 'view' THEN 'tesseract_ocr' WHEN 'click' THEN 'google_enterprise_ocr'
           WHEN 'purchase' THEN NULL WHEN 'error' THEN 'pymupdf_texto' ELSE 'Google' END AS method,
        props AS extract, ts FROM events"""),
    "v_report_log": ([], """
      SELECT event_id AS report_id, event_id - event_id % 4 AS sheet_id, CAST(floor(value) AS INT) % 4 AS n_alerts,
        CAST(floor(value) AS INT) % 4 > 0 AS has_anomaly, ts FROM events"""),
    "v_compare_log": ([], """
      SELECT event_id AS compare_id, event_id - event_id % 5 AS sheet_id,
        CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'info' WHEN 'purchase' THEN NULL ELSE 'alerta' END AS status,
        CAST(floor(value) AS INT) % 7 AS n_discrepancies, ts FROM events"""),
    "v_score": ([], """
      SELECT event_id AS sheet_id, value > 150 AS is_anomaly, s AS score, ts AS analysed_at,
        CASE WHEN abs(s) > 0.5 THEN 'alta' WHEN abs(s) > 0.2 THEN 'media' ELSE 'baja' END AS confidence
      FROM (SELECT *, round((100 - value) / 100, 4) AS s FROM events)"""),
    "v_list_sheet": (["v_sheet"], """
      SELECT *, CASE sheet_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('/p/', CAST(sheet_id AS VARCHAR)) END AS pdf_path,
        CASE WHEN sheet_id % 11 = 0 THEN NULL ELSE strftime(captured_at, '%Y-%m-%d %H:%M:%S') END AS captured_text FROM v_sheet"""),
    "v_listing": (["v_list_sheet", "v_result_log", "v_report_log", "v_compare_log", "v_score"], """
      SELECT s.*, r.scanned, r.method, r.extract, rl.extract AS extract_local, rg.extract AS extract_google,
        r.sheet_id IS NOT NULL AS has_reader, p.has_anomaly AS report_flag, p.n_alerts, p.sheet_id IS NOT NULL AS has_report,
        c.status AS compare_status, c.n_discrepancies, s.sheet_id IN (SELECT sheet_id FROM v_compare_log WHERE status='alerta') AS any_alert,
        m.is_anomaly AS score_flag, m.score, m.confidence
      FROM v_list_sheet s
      LEFT JOIN (SELECT * FROM v_result_log QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY ts DESC, result_id DESC) = 1) r USING (sheet_id)
      LEFT JOIN (SELECT * FROM v_result_log WHERE method IS NULL OR NOT method ILIKE 'google%'
                 QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY ts DESC, result_id DESC) = 1) rl USING (sheet_id)
      LEFT JOIN (SELECT * FROM v_result_log WHERE method ILIKE 'google%'
                 QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY ts DESC, result_id DESC) = 1) rg USING (sheet_id)
      LEFT JOIN (SELECT * FROM v_report_log QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY ts DESC, report_id DESC) = 1) p USING (sheet_id)
      LEFT JOIN (SELECT * FROM v_compare_log QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY ts DESC, compare_id DESC) = 1) c USING (sheet_id)
      LEFT JOIN v_score m USING (sheet_id)"""),
    "v_official": (["v_linec"], """
      SELECT contest_id, CAST(code AS VARCHAR) AS code, max(name) AS name,
        CAST(floor(CASE WHEN code % 5 = 0 THEN sum(votes) * 1.2 ELSE sum(votes) END) AS BIGINT) AS votes, CAST(code AS DOUBLE) AS pct
      FROM v_linec WHERE code < 80 GROUP BY contest_id, code"""),
    "v_report": ([], """
      SELECT d.doc_id, coalesce(toxic, 0) = 1 AS is_anomaly, coalesce(quality, 0) - n_chars / 1000.0 AS score,
        CASE WHEN abs(coalesce(quality, 0) - n_chars / 1000.0) > 0.5 THEN 'alta'
             WHEN abs(coalesce(quality, 0) - n_chars / 1000.0) > 0.2 THEN 'media' ELSE 'baja' END AS confidence
      FROM documents d LEFT JOIN labels l USING (doc_id)"""),
    "v_pixels": ([], """
      SELECT vec_id AS doc_id, 1 AS page, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
        least(255, greatest(0, CAST(floor((CAST(v AS DOUBLE) + 0.5) * 255) AS INT))) AS gray
      FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)"""),
    "v_cells_wide": (["v_line"], """
      SELECT form AS sheet_id, CAST(row_idx AS INT) AS row_idx,
        CASE WHEN form % 4 = 1 AND row_idx % 3 = 0 THEN 2 WHEN form % 4 = 2 AND row_idx % 5 = 0 THEN NULL
             WHEN form % 4 = 3 AND row_idx % 5 < 3 THEN NULL WHEN form % 4 = 0 THEN 1
             WHEN value >= 100 THEN CAST(value // 100 % 10 AS INT) END AS d0,
        CASE WHEN form % 4 = 1 AND row_idx % 3 = 0 THEN 2 WHEN form % 4 = 2 AND row_idx % 5 = 0 THEN NULL
             WHEN form % 4 = 3 AND row_idx % 5 < 3 THEN NULL WHEN value >= 10 THEN CAST(value // 10 % 10 AS INT) END AS d1,
        CASE WHEN form % 4 = 1 AND row_idx % 3 = 0 THEN 2 WHEN form % 4 = 2 AND row_idx % 5 = 0 THEN 7
             WHEN form % 4 = 3 AND row_idx % 5 < 3 THEN 9 ELSE CAST(value % 10 AS INT) END AS d2,
        CASE WHEN form % 4 = 0 THEN 0.95 ELSE 0.9 END AS c0,
        CASE WHEN form % 4 = 1 AND row_idx % 3 = 0 THEN 130 WHEN form % 4 = 2 AND row_idx % 5 = 0 THEN 150 ELSE 100 END AS ink
      FROM (SELECT o.o_custkey AS form, CASE l.code WHEN 80 THEN 25 WHEN 81 THEN 26 WHEN 90 THEN 27 ELSE l.code - 1 END AS row_idx,
              sum(l.votes) AS value FROM v_line l JOIN orders o ON o.o_orderkey = l.sheet_id GROUP BY 1, 2)"""),
    "v_objects": ([], """
      SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber <= 2 THEN 'image'
        WHEN l_linenumber = 3 AND l_returnflag = 'A' THEN 'font' ELSE 'other' END AS kind,
        l_partkey % 1500 AS width, l_suppkey * 10 AS height FROM lineitem"""),
    "v_images": ([], """
      SELECT l_orderkey AS doc_id, l_linenumber AS page,
        CASE WHEN l_returnflag = 'N' AND l_quantity < 10 THEN NULL ELSE 500 + l_partkey % 3000 END AS width_px,
        700 + l_suppkey % 3000 AS height_px, 595.0::DOUBLE AS page_w_pt, 842.0::DOUBLE AS page_h_pt,
        CASE l_returnflag WHEN 'A' THEN 'JPEG' WHEN 'N' THEN 'Flate/ZIP' ELSE 'CCITT' END AS compression,
        l_linestatus AS color_space FROM lineitem"""),
    "v_spans": ([], r"""
      SELECT doc_id, pos // 10 AS page, line AS text, CASE WHEN (doc_id + pos) % 7 = 0 THEN 16777215 ELSE 0 END AS color,
        CASE WHEN (doc_id + pos) % 11 = 0 THEN 0.4 ELSE 10 END AS size, CASE WHEN pos % 3 = 0 THEN lang ELSE source END AS font,
        trim(line, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS stripped
      FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
              unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"""),
    "v_facts": ([], """
      SELECT *, (pages_single = total_pages AND total_pages > 0) AS single, producer_category = 'generacion' AS generated FROM (
      SELECT o_orderkey AS doc_id,
        CASE o_orderkey % 6 WHEN 0 THEN 'iText 7' WHEN 1 THEN 'HP LaserJet' WHEN 2 THEN 'Adobe Acrobat' WHEN 3 THEN 'Tool' WHEN 4 THEN NULL ELSE 'Canon' END AS producer,
        CASE o_orderkey % 6 WHEN 0 THEN 'generacion' WHEN 1 THEN 'scanner' WHEN 2 THEN 'acrobat' WHEN 3 THEN 'otro' WHEN 4 THEN 'desconocido' ELSE 'scanner' END AS producer_category,
        o_orderkey % 5 = 0 AS has_text, o_orderkey % 7 < 2 AS has_fonts, o_orderkey % 11 = 0 AS has_vectors,
        o_orderkey % 13 < 3 AS has_hidden_text, o_orderkey % 17 < 4 AS has_signature, o_custkey % 4 AS update_count,
        o_custkey % 4 > 0 AS has_updates, o_custkey % 4 + 1 AS eof_count, CAST(o_orderkey % 101 AS INT) AS scan_score,
        CAST(o_custkey % 97 AS INT) AS artificial_score, round(o_totalprice / 100000, 2) AS noise_level,
        CAST(o_orderkey % 900 AS INT) AS dpi_avg, o_orderkey % 3 AS comp, CAST(o_orderkey % 3 AS INT) AS pages_single,
        CAST(o_custkey % 3 AS INT) AS total_pages, o_orderkey % 19 < 9 AS xmp_present, o_orderkey % 23 < 9 AS metadata_stream,
        CASE WHEN o_orderkey % 29 < 9 THEN 'D:20240101' END AS creation_date,
        CASE WHEN o_orderkey % 31 < 9 THEN 'D:20240102' ELSE 'D:20240101' END AS mod_date,
        o_orderkey % 37 = 0 AS has_javascript, o_orderkey % 41 = 0 AS has_attachments, o_orderkey % 4 = 0 AS has_gaps,
        CAST(o_custkey % 120 AS INT) AS yellow_pixels FROM orders)"""),
    "v_class_scores": (["v_facts"], """
      SELECT *, CASE WHEN has_updates THEN 30 ELSE 0 END + CASE WHEN has_hidden_text AND (has_text OR has_fonts) THEN 20 ELSE 0 END
          + CASE WHEN score_b >= 30 AND (has_text OR has_fonts OR has_vectors) THEN 25 ELSE 0 END AS score_c FROM (
      SELECT *, 40*has_text::INT + 30*has_fonts::INT + 20*has_vectors::INT + 15*generated::INT + 10*(has_signature AND NOT has_updates)::INT AS score_a,
        30*(single AND NOT has_text)::INT + 25*(has_hidden_text AND NOT has_text)::INT + 30*(producer_category='scanner')::INT
          + 20*(scan_score >= 40)::INT + 15*(dpi_avg BETWEEN 150 AND 400)::INT + 10*(comp < 2)::INT AS score_b,
        20*single::INT + 10*(single AND NOT has_text AND NOT has_hidden_text)::INT + 30*generated::INT + 20*(generated AND single)::INT
          + 25*(artificial_score >= 40)::INT + 15*(noise_level < 1.5 AND pages_single > 0)::INT
          + 5*(NOT metadata_stream AND NOT xmp_present)::INT AS score_d FROM v_facts)"""),
    "v_class": (["v_class_scores"], """
      SELECT *, CASE WHEN base IN ('B','D') AND score_c >= top * 0.8 THEN 'C' ELSE base END AS classification,
        CASE WHEN top >= 60 AND top - second >= 20 THEN 'alto' WHEN top >= 35 OR top - second >= 10 THEN 'medio' ELSE 'bajo' END AS confidence,
        generated::INT + (generated AND single)::INT + (artificial_score >= 40)::INT
          + ((noise_level < 1.5 AND pages_single > 0) OR (generated AND noise_level > 0))::INT
          + (NOT metadata_stream AND NOT xmp_present)::INT + has_updates::INT
          + (score_b >= 30 AND (has_text OR has_fonts OR has_vectors))::INT + (NOT has_signature)::INT
          + (dpi_avg <> 0 AND (dpi_avg < 72 OR dpi_avg > 1200))::INT
          + (creation_date IS NOT NULL AND mod_date <> creation_date)::INT AS n_risk FROM (
      SELECT *, CASE WHEN top < 25 THEN 'E' WHEN score_a = top THEN 'A' WHEN score_b = top THEN 'B' WHEN score_c = top THEN 'C' ELSE 'D' END AS base,
        list_sort([score_a, score_b, score_c, score_d], 'DESC')[2] AS second
      FROM (SELECT *, greatest(score_a, score_b, score_c, score_d) AS top FROM v_class_scores))"""),
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named views (and what they need) as leading CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        order.append(name)

    for n in names:
        visit(n)
    if not order:
        return sql
    own = sql.lstrip()
    link = ",\n" + own[4:].lstrip() if own.startswith("WITH ") else "\n" + sql
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + link
