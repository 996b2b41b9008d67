"""The audit's input tables derived from the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_utc

# Voting days for the driver's event log (epoch seconds of 2024-01-29, -30, -31): the last entry of a
# code wins, so the state times of its sheets lie at the end of the log.
TEST_DAYS = (1706486400, 1706572800, 1706659200)

#: Vote lines that one task groups, about, where they are dealt out by sheet.
LINES_OF_A_PART = 150_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def v_line(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """Vote lines, one row per (sheet, code); codes of 80 and above are the special rows.

    Only numbers are aggregated, so the aggregate stays hash-based; the name follows from the code. ``dealt`` deals the
    lines out by sheet into parts of a bounded number of lines first: narrow rows take many times their shuffled size in
    a task's hash tables, and whatever groups or joins by sheet later finds its rows in one part.
    """
    special = {5: (90, "VOTOS IMPUGNADOS"), 6: (80, "VOTOS EN BLANCO"), 7: (81, "VOTOS NULOS")}
    code = "CAST(l_suppkey % 25 AS INT) + 1"
    name = "concat('Agrupación NATION_', code - 1)"
    for number, (special_code, special_name) in special.items():
        code = f"CASE WHEN l_linenumber = {number} THEN {special_code} ELSE {code} END"
        name = f"CASE WHEN code = {special_code} THEN '{special_name}' ELSE {name} END"
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey AS sheet_id", f"{code} AS code", "CAST(l_quantity AS INT) AS votes")
    if dealt:
        lines = lines.repartition(max(1, -(-lines.count() // LINES_OF_A_PART)), "sheet_id")
    return (
        lines
        .groupBy("sheet_id", "code").agg(F.sum("votes").alias("votes"))
        .selectExpr("sheet_id", "code", f"{name} AS name", "votes")
    )


def _envelope(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS sheet_id", "lpad(CAST(o_custkey AS STRING), 6, '0') AS station",
        """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 10 WHEN '2' THEN 12 WHEN '3' THEN 13
           WHEN '4' THEN 14 ELSE 15 END AS contest_id""",
        "o_orderpriority AS contest", "o_orderstatus AS state", "o_orderdate AS captured_at")


def v_sheet(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """Sheets with declared totals and deterministic faults; ``dealt`` as for the lines."""
    totals = v_line(spark, sf, dealt).groupBy("sheet_id").agg(
        F.sum("votes").alias("s_all"),
        F.sum(F.when(F.col("code") < 80, F.col("votes")).otherwise(0)).alias("s_party"))
    sheets = _envelope(spark, sf).join(totals, "sheet_id").selectExpr(
        "sheet_id", "station", "contest_id", "contest", "state", "captured_at",
        "s_all + CASE sheet_id % 50 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS emitted",
        "s_party + CASE WHEN sheet_id % 70 = 0 THEN 2 ELSE 0 END AS valid",
        "CASE WHEN sheet_id % 60 = 0 THEN s_all - 1 ELSE s_all + 10 + sheet_id % 90 END AS eligible")
    return sheets.selectExpr("*", """
        round(try_divide(100.0D * emitted, CAST(eligible AS DOUBLE)), 1)
        + CASE WHEN sheet_id % 40 = 0 THEN 2.5D WHEN sheet_id % 41 = 0 THEN 7D ELSE 0D END AS declared_pct""")


def v_line_contest(spark: SparkSession, sf: str) -> DataFrame:
    """Vote lines that carry their station and contest, as parsed sheets do."""
    return v_line(spark, sf).join(
        _envelope(spark, sf).select("sheet_id", "station", "contest_id", "contest"), "sheet_id")


def v_reader(spark: SparkSession, sf: str, moduli: tuple[int, int, int] = (97, 89, 83)) -> DataFrame:
    """Reader lines of the same sheets with misreads and gaps; position = printed row."""
    big, small, gone = moduli
    return v_line(spark, sf).where("code < 80").selectExpr(
        "sheet_id", "code AS pos", "upper(replace(concat(name, ' FRENTE'), 'ó', 'o')) AS name",
        f"""votes + CASE WHEN (sheet_id * 7 + code) % {big} = 0 THEN 6
            WHEN (sheet_id * 7 + code) % {small} = 0 THEN 2 ELSE 0 END AS votes""",
        f"(sheet_id * 7 + code) % {gone} AS _gone",
    ).where("_gone <> 0").drop("_gone")


def v_reader2(spark: SparkSession, sf: str) -> DataFrame:
    return v_reader(spark, sf, (101, 79, 73))


def v_extract(spark: SparkSession, sf: str, a: int = 31, b: int = 37) -> DataFrame:
    """Totals a reader found on each sheet, with missing and wrong values."""
    return v_sheet(spark, sf).selectExpr(
        "sheet_id",
        f"CASE WHEN sheet_id % {a} = 0 THEN NULL WHEN sheet_id % {b} = 0 THEN eligible + 5 ELSE eligible END AS electors",
        f"CASE WHEN sheet_id % {a + 12} = 0 THEN NULL WHEN sheet_id % {b - 8} = 0 THEN emitted + 1 ELSE emitted END AS voters",
        f"CASE WHEN sheet_id % {a + 16} = 0 THEN NULL WHEN sheet_id % {b + 16} = 0 THEN valid - 1 ELSE valid END AS valid",
    )


def v_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """State log: one sheet per user."""
    return table(spark, sf, "events").selectExpr(
        "user_id AS sheet_id", "event_id AS pos", "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms",
        """CASE event_type WHEN 'view' THEN 'T' WHEN 'click' THEN 'D' WHEN 'purchase' THEN 'C'
           WHEN 'error' THEN 'O' ELSE 'J' END AS state_code""")


def v_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Sweep results in station order."""
    return table(spark, sf, "events").selectExpr(
        "'job_1' AS job_id", "event_id AS station_no",
        """CASE event_type WHEN 'view' THEN 'EXISTE_CON_PDF' WHEN 'click' THEN 'EXISTE_SIN_PDF'
           WHEN 'purchase' THEN 'PARA_JEE' WHEN 'error' THEN 'NO_EXISTE' ELSE 'OBSERVADA' END AS status""",
        "ts")


def v_result_log(spark: SparkSession, sf: str) -> DataFrame:
    """Reader results, append-only: several per sheet."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS result_id", "event_id - event_id % 3 AS sheet_id",
        "event_type IN ('view', 'click') AS scanned",
        """CASE event_type WHEN 'view' THEN 'tesseract_ocr' WHEN 'click' THEN 'google_enterprise_ocr'
           WHEN 'purchase' THEN NULL WHEN 'error' THEN 'pymupdf_texto' ELSE 'Google' END AS method""",
        "props AS extract", "ts")


def v_report_log(spark: SparkSession, sf: str) -> DataFrame:
    """Document reports, append-only, with 0 to 3 alert-level alerts each."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS report_id", "event_id - event_id % 4 AS sheet_id",
        """transform(sequence(0, CAST(floor(value) AS INT) % 4),
                     i -> named_struct('nivel', CASE WHEN i = 0 THEN 'info' ELSE 'alerta' END,
                                       'mensaje', concat('m', i))) AS alerts""", "ts")


def v_compare_log(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison results, append-only."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS compare_id", "event_id - event_id % 5 AS sheet_id",
        """CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'info' WHEN 'purchase' THEN NULL
           ELSE 'alerta' END AS status""",
        "CAST(floor(value) AS INT) % 7 AS n_discrepancies", "ts")


def v_score(spark: SparkSession, sf: str) -> DataFrame:
    """Model scores, one per sheet."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS sheet_id", "value > 150 AS is_anomaly", "round((100 - value) / 100, 4) AS score",
        "ts AS analysed_at")


def v_official(spark: SparkSession, sf: str) -> DataFrame:
    """Official snapshot per contest: inflated party totals as one JSON list (at most one item per code)."""
    totals = v_line_contest(spark, sf).where("code < 80").groupBy("contest_id", "code").agg(
        F.max("name").alias("name"), F.sum("votes").alias("votes"))
    items = totals.selectExpr("contest_id", """named_struct(
        'codigoAgrupacionPolitica', CAST(code AS STRING), 'nombreAgrupacionPolitica', name,
        'totalVotosValidos', CAST(floor(CASE WHEN code % 5 = 0 THEN votes * 1.2D ELSE votes END) AS BIGINT),
        'porcentajeVotosValidos', CAST(code AS DOUBLE)) AS item""")
    return items.groupBy("contest_id").agg(F.to_json(F.collect_list("item")).alias("participants_json"))


def v_raw_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Published envelopes with nested documents; some empty, broken or in the other spelling."""
    lines = v_line(spark, sf).selectExpr("sheet_id", """
        CASE WHEN sheet_id % 2 = 0
        THEN named_struct('adCodigo', CAST(code AS STRING), 'adDescripcion', name,
                          'adVotos', CASE WHEN (sheet_id + code) % 53 = 0 THEN NULL ELSE votes END,
                          'descripcion', CAST(NULL AS STRING), 'nvotos', CAST(NULL AS BIGINT))
        ELSE named_struct('adCodigo', CAST(code AS STRING), 'adDescripcion', CAST(NULL AS STRING),
                          'adVotos', CAST(NULL AS BIGINT), 'descripcion', name, 'nvotos', votes)
        END AS item""", "code").groupBy("sheet_id").agg(
            F.expr("transform(array_sort(collect_list(struct(code, item))), x -> x.item)").alias("detalle"))
    sheets = v_sheet(spark, sf).join(lines, "sheet_id")
    return sheets.selectExpr(
        "sheet_id", "station", "contest_id", "contest", "state", """
        CASE WHEN sheet_id % 97 = 0 THEN '{}' WHEN sheet_id % 89 = 0 THEN '{"detalle": [' WHEN sheet_id % 83 = 0 THEN ''
        WHEN sheet_id % 79 = 0 THEN NULL
        ELSE to_json(named_struct(
            'totalElectoresHabiles', eligible, 'totalVotosEmitidos', emitted, 'totalVotosValidos', valid,
            'porcentajeParticipacionCiudadana', declared_pct, 'detalle', detalle,
            'lineaTiempo', array(
                named_struct('codigoEstadoActa', 'T', 'fechaRegistro', unix_millis(CAST(captured_at AS TIMESTAMP))),
                named_struct('codigoEstadoActa', 'C', 'fechaRegistro',
                             unix_millis(CAST(captured_at AS TIMESTAMP)) + (sheet_id % 100) * 60000)),
            'archivos', array(named_struct('id', concat('f', sheet_id), 'tipo', CAST(sheet_id % 3 AS INT)),
                              named_struct('id', concat('g', sheet_id), 'tipo', CAST((sheet_id + 1) % 3 AS INT)))))
        END AS api_json""")


def v_file(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of raw bytes."""
    return table(spark, sf, "documents").selectExpr(
        "concat('/actas/', lpad(CAST(doc_id AS STRING), 6, '0'), '/acta_', lpad(CAST(doc_id AS STRING), 6, '0'),"
        " '_e', CAST(10 + doc_id % 5 AS STRING), '.pdf') AS path",
        "CAST(concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE '%PDF-1.7\\n' END, text, repeat(concat("
        "'\\nxref\\n0 1\\ntrailer\\nstartxref ', CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE CAST(doc_id * 7 AS STRING) END,"
        " '\\n%%EOF\\n'), CAST(1 + doc_id % 3 AS INT))) AS BINARY) AS content")


def v_report(spark: SparkSession, sf: str) -> DataFrame:
    """Model scores of labelled documents."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").selectExpr(
        "doc_id", "coalesce(toxic, 0) = 1 AS is_anomaly",
        "coalesce(quality, 0) - n_chars / 1000.0D AS score")


def v_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings read as 8x8 grey rasters."""
    return table(spark, sf, "embeddings").selectExpr("vec_id AS doc_id", "posexplode(embedding) AS (i, v)").selectExpr(
        "doc_id", "1 AS page", "i div 8 AS y", "i % 8 AS x",
        "least(255, greatest(0, CAST(floor((CAST(v AS DOUBLE) + 0.5D) * 255) AS INT))) AS gray")


def v_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Digit predictions of one form per station with injected printed digits (long: one row per cell)."""
    rows = v_line(spark, sf).join(_envelope(spark, sf).selectExpr("sheet_id", "CAST(station AS BIGINT) AS form"),
                                  "sheet_id")
    rows = rows.selectExpr(
        "form", "CASE code WHEN 80 THEN 25 WHEN 81 THEN 26 WHEN 90 THEN 27 ELSE code - 1 END AS row_idx", "votes"
    ).groupBy("form", "row_idx").agg(F.sum("votes").alias("value"))
    digits = rows.selectExpr(
        "form AS sheet_id", "row_idx", """
        CASE WHEN form % 4 = 1 AND row_idx % 3 = 0 THEN array(2, 2, 2)
             WHEN form % 4 = 2 AND row_idx % 5 = 0 THEN array(NULL, NULL, 7)
             WHEN form % 4 = 3 AND row_idx % 5 < 3 THEN array(NULL, NULL, 9)
             ELSE array(CASE WHEN form % 4 = 0 THEN 1 WHEN value >= 100 THEN CAST(value div 100 % 10 AS INT) END,
                        CASE WHEN value >= 10 THEN CAST(value div 10 % 10 AS INT) END,
                        CAST(value % 10 AS INT)) END AS digits""", """
        CASE WHEN form % 4 = 1 AND row_idx % 3 = 0 THEN 130D
             WHEN form % 4 = 2 AND row_idx % 5 = 0 THEN 150D ELSE 100D END AS min_ink""",
        "CASE WHEN form % 4 = 0 THEN 0.95D ELSE 0.9D END AS conf0")
    return digits.selectExpr("sheet_id", "row_idx", "posexplode(digits) AS (pos, digit)", "min_ink", "conf0").selectExpr(
        "sheet_id", "row_idx", "pos", "digit", "CASE WHEN pos = 0 THEN conf0 ELSE 0.9D END AS conf", "min_ink")


def v_list_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets as the list shows them: with a document path and a capture time as text."""
    return v_sheet(spark, sf, dealt=True).selectExpr(
        "*", "CASE sheet_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('/p/', sheet_id) END AS pdf_path",
        """CASE WHEN sheet_id % 11 = 0 THEN NULL
           ELSE date_format(captured_at, 'yyyy-MM-dd HH:mm:ss') END AS captured_text""")


def _sheet_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets with their votes as a map code -> votes (at most 28 codes)."""
    votes = v_line(spark, sf).groupBy("sheet_id").agg(
        F.map_from_entries(F.collect_list(F.struct("code", "votes"))).alias("v"))
    return v_sheet(spark, sf).join(votes, "sheet_id")


def v_text(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets rendered as text in four layouts: line pairs, table zone, column zones, plain rows."""
    from .dims import BALLOT

    names = F.create_map(*[F.lit(x) for r, n in BALLOT for x in (r, n or "CANDIDATO LIBRE")])
    base = _sheet_votes(spark, sf).withColumn("names", names).withColumn(
        "rows", F.expr("array_sort(filter(map_keys(v), k -> k < 80))"))
    special = [(80, "VOTOS EN BLANCO"), (81, "VOTOS NULOS"), (90, "VOTOS IMPUGNADOS")]

    def totals(sep: str) -> str:
        parts = ", ".join(f"CASE WHEN map_contains_key(v, {c}) THEN concat('{n}', '{sep}', v[{c}]) END" for c, n in special)
        return f"concat_ws('\\n', {parts}, concat('TOTAL DE VOTOS EMITIDOS', '{sep}', emitted))"

    tail = "concat('FIRMA DEL PRESIDENTE D.N.I. ', lpad(CAST(sheet_id AS STRING), 8, '0'), ' HORA: 16:', lpad(CAST(sheet_id % 60 AS STRING), 2, '0'))"
    pairs = f"""concat_ws('\\n', 'ACTA ELECTORAL', concat('MESA N° ', station),
        concat('TOTAL ELECTORES HABILES: ', eligible),
        array_join(transform(rows, k -> concat(names[k], '\\n', v[k])), '\\n'), {totals(chr(92) + 'n')},
        concat('CIUDADANOS QUE VOTARON', '\\n', emitted), {tail})"""
    table_zone = f"""concat_ws('\\n', '--- ENCABEZADO ---', concat('MESA: ', station), '--- TABLA DE PARTIDOS ---',
        array_join(transform(rows, k -> concat(' ', k, ' ', names[k], ' ', v[k])), '\\n'), '--- TOTALES ---', {totals(' ')}, {tail})"""
    columns = f"""concat_ws('\\n', '--- COLUMNA PARTIDOS ---', concat('MESA: ', station),
        array_join(transform(filter(rows, k -> k % 2 = 0), k -> concat(k, ' ', names[k], ' X')), '\\n'),
        '--- COLUMNA VOTOS (DIGITOS) ---',
        array_join(transform(sequence(1, 25), k -> CASE WHEN map_contains_key(v, k) THEN concat('[', v[k], ']') ELSE '' END), '\\n'),
        '--- FIN ---', {tail})"""
    plain = f"""concat_ws('\\n', concat('MESA: ', station),
        array_join(transform(rows, k -> concat(k, ' ', names[k], ' ', v[k])), '\\n'), {totals(' ')}, {tail})"""
    return base.selectExpr("sheet_id AS doc_id", f"""CASE sheet_id % 4 WHEN 0 THEN {pairs} WHEN 1 THEN {table_zone}
        WHEN 2 THEN {columns} ELSE {plain} END AS text""")


def v_prose(spark: SparkSession, sf: str) -> DataFrame:
    """Free prose with negative ids."""
    return table(spark, sf, "documents").selectExpr("-1 - doc_id AS doc_id", "text")


def v_texts(spark: SparkSession, sf: str) -> DataFrame:
    return v_text(spark, sf).unionByName(v_prose(spark, sf))


def v_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entity lists of a document reader, one per sheet, in both party schemas."""
    sub = "array<struct<tipo:string,texto:string,conf:double>>"

    def ent(kind: str, text: str, norm: str = "CAST(NULL AS STRING)", subs: str = f"CAST(array() AS {sub})") -> str:
        return (f"named_struct('tipo', {kind}, 'texto', {text}, 'confidence', 0.9D, 'normalizado', {norm}, "
                f"'sub_entidades', {subs})")

    def subs(*pairs: tuple[str, str]) -> str:
        return "array(" + ", ".join(f"named_struct('tipo', {k}, 'texto', {v}, 'conf', 0.8D)" for k, v in pairs) + ")"

    party = f"""CASE code % 3
        WHEN 0 THEN {ent("'voto'", "''", subs=subs(("'organizacion_politica'", "name"), ("'total_votos'", "CAST(votes AS STRING)")))}
        WHEN 1 THEN {ent("'organizacion_politica'", "''", subs=subs(("'nombre'", "name"), ("'total_votos'", "replace(CAST(votes AS STRING), '1', 'l')")))}
        ELSE {ent("'organizacion_politica'", "name")} END AS e"""
    parties = v_line(spark, sf).selectExpr("sheet_id", "code", party).groupBy("sheet_id").agg(
        F.expr("transform(array_sort(collect_list(struct(code, e))), x -> x.e)").alias("ps"))
    head = ", ".join([
        ent("'mesa_de_sufragio'", "station"),
        ent("'total_electores_habiles'", "replace(CAST(eligible AS STRING), '0', 'O')"),
        ent("'electores_habiles'", "'999'"),
        ent("'total_votos_emitidos'", "'x'", "CAST(emitted AS STRING)"),
        ent("'votos_nulos'", "''"),
        ent("'miembro_mesa'", "concat('M', sheet_id)", subs=subs(("'nombre'", "'Ana'"), ("'dni'", "''"))),
        ent("'miembro_mesa'", "concat('N', sheet_id)", subs=subs(("'nombre'", "'Luis'"))),
        ent("'0.000'", "'z'")])
    return v_sheet(spark, sf).join(parties, "sheet_id").selectExpr(
        "sheet_id AS doc_id", f"to_json(concat(array({head}), ps)) AS entities_json")


def v_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded document facts, one row per order."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS doc_id",
        """CASE o_orderkey % 6 WHEN 0 THEN 'iText 7' WHEN 1 THEN 'HP LaserJet' WHEN 2 THEN 'Adobe Acrobat'
           WHEN 3 THEN 'Tool' WHEN 4 THEN NULL ELSE 'Canon' END AS producer""",
        """CASE o_orderkey % 6 WHEN 0 THEN 'generacion' WHEN 1 THEN 'scanner' WHEN 2 THEN 'acrobat'
           WHEN 3 THEN 'otro' WHEN 4 THEN 'desconocido' ELSE 'scanner' END AS producer_category""",
        "o_orderkey % 5 = 0 AS has_text", "o_orderkey % 7 < 2 AS has_fonts", "o_orderkey % 11 = 0 AS has_vectors",
        "o_orderkey % 13 < 3 AS has_hidden_text", "o_orderkey % 17 < 4 AS has_signature",
        "o_custkey % 4 AS update_count", "o_custkey % 4 > 0 AS has_updates", "o_custkey % 4 + 1 AS eof_count",
        "CAST(o_orderkey % 101 AS INT) AS scan_score", "CAST(o_custkey % 97 AS INT) AS artificial_score",
        "round(o_totalprice / 100000, 2) AS noise_level", "CAST(o_orderkey % 900 AS INT) AS dpi_avg",
        """CASE o_orderkey % 3 WHEN 0 THEN array('JPEG') WHEN 1 THEN array('CCITT', 'Flate/ZIP')
           ELSE array('Flate/ZIP') END AS compressions""",
        "CAST(o_orderkey % 3 AS INT) AS pages_single", "CAST(o_custkey % 3 AS INT) AS total_pages",
        "o_orderkey % 19 < 9 AS xmp_present", "o_orderkey % 23 < 9 AS metadata_stream",
        "CASE WHEN o_orderkey % 29 < 9 THEN 'D:20240101' END AS creation_date",
        "CASE WHEN o_orderkey % 31 < 9 THEN 'D:20240102' ELSE 'D:20240101' END AS mod_date",
        "o_orderkey % 37 = 0 AS has_javascript", "o_orderkey % 41 = 0 AS has_attachments",
        "CASE WHEN o_orderkey % 4 = 0 THEN array(12, 40) ELSE CAST(array() AS ARRAY<INT>) END AS histogram_gaps",
        "CAST(o_custkey % 120 AS INT) AS yellow_pixels", "'mixed' AS document_model")


def v_objects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc_id", """CASE WHEN l_linenumber <= 2 THEN 'image'
        WHEN l_linenumber = 3 AND l_returnflag = 'A' THEN 'font' ELSE 'other' END AS kind""",
        "l_partkey % 1500 AS width", "l_suppkey * 10 AS height")


def v_images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "l_linenumber AS page",
        "CASE WHEN l_returnflag = 'N' AND l_quantity < 10 THEN NULL ELSE 500 + l_partkey % 3000 END AS width_px",
        "700 + l_suppkey % 3000 AS height_px", "595.0D AS page_w_pt", "842.0D AS page_h_pt",
        "CASE l_returnflag WHEN 'A' THEN 'JPEG' WHEN 'N' THEN 'Flate/ZIP' ELSE 'CCITT' END AS compression",
        "l_linestatus AS color_space")


def v_spans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", "lang", "source", "posexplode(split(text, '\\n')) AS (pos, text)").selectExpr(
        "doc_id", "pos div 10 AS page", "text", "CASE WHEN (doc_id + pos) % 7 = 0 THEN 16777215 ELSE 0 END AS color",
        "CASE WHEN (doc_id + pos) % 11 = 0 THEN 0.4D ELSE 10D END AS size",
        "CASE WHEN pos % 3 = 0 THEN lang ELSE source END AS font")


def v_rgb(spark: SparkSession, sf: str) -> DataFrame:
    """Three colour channels from shifted embedding values."""
    def gray(i: str) -> str:
        return f"least(255, greatest(0, CAST(floor((CAST({i} AS DOUBLE) + 0.5D) * 255) AS INT)))"

    return table(spark, sf, "embeddings").selectExpr("vec_id AS doc_id", "embedding AS e", "posexplode(embedding) AS (i, v)").selectExpr(
        "doc_id", "1 AS page", "i div 8 AS y", "i % 8 AS x", f"least(255, {gray('v')} + 70) AS r",
        f"least(255, {gray('e[(i + 1) % 64]')} + 70) AS g", f"greatest(0, {gray('e[(i + 7) % 64]')} - 40) AS b")
