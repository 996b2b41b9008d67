"""Document facts and the anomaly model."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import forensics, model
from ..session import cut_lineage, shared_folder
from ..sources import tables as t
from .catalog import query
from .source_queries import _FILE

_MARK = "CAST(1 + doc_id % 3 AS INT)"


def _count(word: str) -> str:
    return f"CAST((octet_length(content) - octet_length(encode(replace(decode(content), '{word}', '')))) // {len(word)} AS INT)"


@query("x01_revision_markers", f"""
SELECT doc_id, {_count('%%EOF')} AS eof_count, {_count('startxref')} AS startxref_count, {_MARK} AS xref_count, {_MARK} AS trailer_count,
  CAST(doc_id % 3 AS INT) AS update_count, doc_id % 3 > 0 AS has_updates,
  array_to_string(list_transform(range(1 + doc_id % 3), lambda i: CASE WHEN doc_id % 5 = 0 THEN '-1' ELSE CAST(doc_id * 7 AS VARCHAR) END), ',') AS offsets,
  CASE WHEN doc_id % 3 <> 0 THEN '1.7' END AS pdf_version FROM {_FILE}""")
def x01(spark, sf):
    return forensics.revision_markers(t.v_file(spark, sf)).select(
        F.regexp_extract("path", "acta_([0-9]+)_", 1).cast("long").alias("doc_id"), "eof_count", "startxref_count", "xref_count",
        "trailer_count", "update_count", "has_updates",
        F.array_join(F.col("xref_offsets").cast("array<string>"), ",").alias("offsets"), "pdf_version")


@query("x02_document_model", """
SELECT doc_id, n_images, n_fonts, CASE WHEN n_fonts > 0 AND n_images = 0 THEN 'native' WHEN n_fonts > 0 THEN 'mixed' WHEN n_images = 1 OR (n_images > 0 AND n_large > 0) THEN 'single-image'
  WHEN n_images > 1 THEN 'multi-image' ELSE 'desconocido' END AS document_model, n_fonts > 0 AS has_vectors
FROM (SELECT doc_id, count(*) FILTER (kind = 'image') AS n_images, count(*) FILTER (kind = 'font') AS n_fonts,
  count(*) FILTER (kind = 'image' AND width * height > 500000) AS n_large FROM v_objects GROUP BY doc_id)""", "v_objects")
def x02(spark, sf):
    return forensics.document_model(t.v_objects(spark, sf))


@query("x03_image_resolution", """
WITH e AS (SELECT *, (round_even(width_px / (page_w_pt / 72.0), 0) + round_even(height_px / (page_h_pt / 72.0), 0)) / 2.0 AS dpi FROM v_images),
p AS (SELECT doc_id, page, count(width_px) AS n FROM e GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_images, count(*) AS total_pages, count(*) FILTER (n = 0) AS pages_no_image, count(*) FILTER (n = 1) AS pages_single,
  count(*) FILTER (n > 1) AS pages_multi, any_value(lo) AS dpi_min, any_value(hi) AS dpi_max, any_value(av) AS dpi_avg, any_value(c) AS compressions, any_value(s) AS color_spaces
FROM p LEFT JOIN (SELECT doc_id, CAST(round_even(min(dpi), 0) AS BIGINT) AS lo, CAST(round_even(max(dpi), 0) AS BIGINT) AS hi, CAST(round_even(sum(dpi) / count(dpi), 0) AS BIGINT) AS av,
  string_agg(DISTINCT compression, ',' ORDER BY compression) FILTER (width_px IS NOT NULL) AS c, string_agg(DISTINCT color_space, ',' ORDER BY color_space) FILTER (width_px IS NOT NULL) AS s FROM e GROUP BY 1) USING (doc_id)
GROUP BY doc_id""", "v_images")
def x03(spark, sf):
    return forensics.image_resolution(t.v_images(spark, sf)).withColumns({
        "compressions": F.array_join("compressions", ","), "color_spaces": F.array_join("color_spaces", ",")})


@query("x04_text_layer", """
WITH p AS (SELECT doc_id, page, sum(length(stripped)) AS chars, sum(CASE WHEN color = 16777215 THEN length(stripped) ELSE 0 END + CASE WHEN size < 0.5 THEN length(stripped) ELSE 0 END) AS hidden FROM v_spans GROUP BY 1, 2)
SELECT doc_id, CAST(sum(chars) AS BIGINT) AS total_chars, CAST(sum(hidden) AS BIGINT) AS hidden_chars, count(*) FILTER (chars > 10) AS pages_with_text, count(*) FILTER (chars <= 10) AS pages_without_text,
  bool_or(hidden > 10) AS has_hidden_text, any_value(fonts) AS fonts, sum(chars) > 20 AS has_text, any_value(fonts) IS NOT NULL AS has_fonts
FROM p JOIN (SELECT doc_id, string_agg(DISTINCT font, ',' ORDER BY font) AS fonts FROM v_spans WHERE font <> '' GROUP BY 1) USING (doc_id) GROUP BY doc_id""", "v_spans")
def x04(spark, sf):
    return forensics.text_layer(t.v_spans(spark, sf)).withColumn("fonts", F.array_join("fonts", ","))


@query("x05_artificial_score", """
WITH m AS (SELECT doc_id, y, x, gray FROM v_pixels),
w AS (SELECT doc_id, avg((gray > 250)::INT) AS white_ratio FROM m GROUP BY 1),
lap AS (SELECT c.doc_id, c.y, l.gray + r.gray - 2 * c.gray AS v FROM m c JOIN m l ON l.doc_id = c.doc_id AND l.y = c.y AND l.x = CASE c.x WHEN 2 THEN 5 ELSE c.x - 1 END
  JOIN m r ON r.doc_id = c.doc_id AND r.y = c.y AND r.x = CASE c.x WHEN 5 THEN 2 ELSE c.x + 1 END WHERE c.x BETWEEN 2 AND 5 AND c.y < 7),
st AS (SELECT doc_id, max(v) AS hi, min(v) AS lo, avg(v) AS mean FROM (SELECT doc_id, y, var_pop(v) AS v FROM lap GROUP BY 1, 2) GROUP BY 1),
ed AS (SELECT a.doc_id, a.y FROM m a JOIN m b ON b.doc_id = a.doc_id AND b.x = a.x AND b.y = a.y + 1 GROUP BY 1, 2 HAVING avg(abs(b.gray - a.gray)) > 30),
bd AS (SELECT doc_id, CASE WHEN count(*) > 5 THEN 1 ELSE 0 END AS bands FROM ed GROUP BY 1)
SELECT doc_id, CAST(1 AS INT) AS page, round(white_ratio, 4) AS white_ratio, round(mean, 2) AS sharpness, CAST(coalesce(bands, 0) AS BIGINT) AS bands, white_ratio > 0.85 AS perfect_white,
  mean < 50 AND white_ratio > 0.5 AS uniform_sharpness, hi > 0 AND lo < hi * 0.05 AND mean > 200 AS compression_inconsistency,
  CAST(30 * (white_ratio > 0.85)::INT + 20 * (mean < 50 AND white_ratio > 0.5)::INT + 25 * (hi > 0 AND lo < hi * 0.05 AND mean > 200)::INT AS INT) AS artificial_score
FROM w JOIN st USING (doc_id) LEFT JOIN bd USING (doc_id)""", "v_pixels")
def x05(spark, sf):
    return forensics.artificial_score(forensics.raster_rows(t.v_pixels(spark, sf)))


@query("x06_histogram_gaps", """
WITH l AS (SELECT DISTINCT doc_id, gray FROM v_pixels),
g AS (SELECT a.doc_id, a.gray + 1 AS gap FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.gray = a.gray + 2 WHERE a.gray + 1 BETWEEN 10 AND 239
  AND NOT EXISTS (SELECT 1 FROM l c WHERE c.doc_id = a.doc_id AND c.gray = a.gray + 1)),
d AS (SELECT doc_id, gray - lag(gray) OVER (PARTITION BY doc_id ORDER BY y, x) AS v FROM v_pixels)
SELECT doc_id, CAST(1 AS INT) AS page, round(stddev_pop(v), 2) AS noise, coalesce((SELECT string_agg(CAST(gap AS VARCHAR), ',' ORDER BY gap) FROM g WHERE g.doc_id = d.doc_id), '') AS gaps FROM d GROUP BY doc_id""", "v_pixels")
def x06(spark, sf):
    return forensics.histogram_gaps(t.v_pixels(spark, sf)).withColumn(
        "gaps", F.array_join(F.col("gaps").cast("array<string>"), ","))


@query("x07_scan_score", """
WITH f AS (SELECT doc_id, count(*) FILTER (y = 1 AND x BETWEEN 1 AND 6 AND gray > 200) AS n, stddev_pop(gray) FILTER (y = 1 AND x BETWEEN 1 AND 6 AND gray > 200) AS sd,
  avg(gray) FILTER (y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5) AS centre, least(avg(gray) FILTER (x = 0), avg(gray) FILTER (x = 7), avg(gray) FILTER (y = 0), avg(gray) FILTER (y = 7)) AS border,
  avg(gray) FILTER (y < 4 AND x < 4) AS q1, avg(gray) FILTER (y < 4 AND x >= 4) AS q2, avg(gray) FILTER (y >= 4 AND x < 4) AS q3, avg(gray) FILTER (y >= 4 AND x >= 4) AS q4 FROM v_pixels GROUP BY 1)
SELECT doc_id, CAST(1 AS INT) AS page, CASE WHEN n > 0 THEN round(sd, 2) ELSE 0.0 END AS noise_level, centre - border > 15 AS edge_shadow, greatest(q1, q2, q3, q4) - least(q1, q2, q3, q4) > 8 AS illumination_uneven,
  n > 0 AND coalesce(sd > 4, FALSE) AS natural_grain, round(100 - least((greatest(q1, q2, q3, q4) - least(q1, q2, q3, q4)) * 2, 100.0), 1) AS uniformity,
  CAST(25 * (n > 0 AND coalesce(sd > 4, FALSE))::INT + 20 * (centre - border > 15)::INT + 15 * (greatest(q1, q2, q3, q4) - least(q1, q2, q3, q4) > 8)::INT AS INT) AS scan_score FROM f""", "v_pixels")
def x07(spark, sf):
    return forensics.scan_score(t.v_pixels(spark, sf), min_background=0)


@query("x08_yellow_dots", """
WITH g AS (SELECT vec_id AS doc_id, i, least(255, greatest(0, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 255) AS INT))) AS r0,
  least(255, greatest(0, CAST(floor((CAST(embedding[(i + 1) % 64 + 1] AS DOUBLE) + 0.5) * 255) AS INT))) AS g0, least(255, greatest(0, CAST(floor((CAST(embedding[(i + 7) % 64 + 1] AS DOUBLE) + 0.5) * 255) AS INT))) AS b0
  FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)),
c AS (SELECT doc_id, (i // 8) // 5 AS cy, (i % 8) // 5 AS cx, count(*) AS n, sum(i % 8) AS sx, sum(i // 8) AS sy FROM g WHERE least(255, r0 + 70) > 180 AND least(255, g0 + 70) > 180 AND greatest(0, b0 - 40) < 80 GROUP BY 1, 2, 3)
SELECT doc_id, CAST(1 AS INT) AS page, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS page_dots, CAST(sx // n AS BIGINT) AS x, CAST(sy // n AS BIGINT) AS y, n FROM c QUALIFY page_dots > 10""")
def x08(spark, sf):
    return forensics.yellow_dots(t.v_rgb(spark, sf))


@query("x08_yellow_dot_clusters", """
WITH RECURSIVE g AS (SELECT vec_id AS doc_id, i, least(255, greatest(0, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 255) AS INT))) AS r0,
  least(255, greatest(0, CAST(floor((CAST(embedding[(i + 1) % 64 + 1] AS DOUBLE) + 0.5) * 255) AS INT))) AS g0, least(255, greatest(0, CAST(floor((CAST(embedding[(i + 7) % 64 + 1] AS DOUBLE) + 0.5) * 255) AS INT))) AS b0
  FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)),
p AS (SELECT doc_id, i // 8 AS y, i % 8 AS x, i FROM g WHERE least(255, r0 + 70) > 180 AND least(255, g0 + 70) > 180 AND greatest(0, b0 - 40) < 80),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS page_dots FROM p QUALIFY page_dots > 10),
reach AS (SELECT doc_id, i, i AS label FROM c UNION
  SELECT b.doc_id, b.i, r.label FROM reach r JOIN c a ON a.doc_id = r.doc_id AND a.i = r.i JOIN c b ON b.doc_id = a.doc_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
l AS (SELECT doc_id, i, min(label) AS label FROM reach GROUP BY 1, 2)
SELECT doc_id, CAST(1 AS INT) AS page, page_dots, CAST(sum(x) // count(*) AS BIGINT) AS x, CAST(sum(y) // count(*) AS BIGINT) AS y, count(*) AS n FROM c JOIN l USING (doc_id, i) GROUP BY doc_id, page_dots, label""")
def x08c(spark, sf):
    return forensics.yellow_dot_clusters(t.v_rgb(spark, sf))


_FACTS = "v_class"


@query("x09_classify_origin", """
SELECT doc_id, score_a, score_b, score_c, score_d, classification, confidence, CAST(n_risk AS INT) AS n_risk,
  CAST(has_text::INT + has_fonts::INT + has_vectors::INT + generated::INT + (has_signature AND NOT has_updates)::INT + (single AND NOT has_text)::INT
    + (has_hidden_text AND NOT has_text)::INT + (producer_category = 'scanner')::INT + (scan_score >= 40)::INT + (dpi_avg BETWEEN 150 AND 400)::INT + (comp < 2)::INT AS INT) AS n_for,
  CAST((NOT has_signature)::INT + (NOT metadata_stream)::INT + has_updates::INT + (producer_category = 'desconocido')::INT + (scan_score < 20 AND score_b > 0)::INT AS INT) AS n_against,
  CAST((NOT has_signature)::INT + has_updates::INT + 2 * (classification = 'D' OR artificial_score > 30)::INT + (classification = 'B')::INT AS INT) AS n_proof FROM v_class""", _FACTS)
def x09(spark, sf):
    return forensics.classify_origin(t.v_facts(spark, sf)).select(
        "doc_id", "score_a", "score_b", "score_c", "score_d", "classification", "confidence", F.size("risk_flags").alias("n_risk"),
        F.size("indicators_for").alias("n_for"), F.size("indicators_against").alias("n_against"), F.size("proof_needed").alias("n_proof"))


_TEXTS = "CASE classification " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in forensics.CLASS_TEXT.items()) + " END"


_ALERTS = f"""
SELECT doc_id, CAST(n AS INT) AS n_alerts, CAST(n + has_signature::INT + (yellow_pixels > 50)::INT + (classification IN ('A', 'B'))::INT AS INT) AS n_all,
  CASE WHEN n >= 3 THEN '⚠️ ANÁLISIS FORENSE: ' || CAST(n AS VARCHAR) || ' indicadores de riesgo detectados. Clasificación: Tipo ' || classification || ' — ' || {_TEXTS} || '. Confianza: ' || confidence || '.'
       WHEN n >= 1 THEN '⚠️ ANÁLISIS FORENSE: ' || CAST(n AS VARCHAR) || ' indicador(es) que requieren revisión. Clasificación: Tipo ' || classification || '. Confianza: ' || confidence || '.'
       ELSE 'ℹ️ ANÁLISIS FORENSE: Sin alertas críticas. Clasificación: Tipo ' || classification || '. Confianza: ' || confidence || '.' END AS summary
FROM (SELECT *, (NOT has_signature)::INT + has_updates::INT + has_javascript::INT + has_attachments::INT + has_gaps::INT + (classification IN ('C', 'D'))::INT AS n FROM v_class)"""


@query("x10_forensic_alerts", _ALERTS, _FACTS)
def x10(spark, sf):
    return forensics.forensic_alerts(forensics.classify_origin(t.v_facts(spark, sf))).select(
        "doc_id", "n_alerts", F.size("alerts").alias("n_all"), "summary")


_CONCLUSION = """
SELECT doc_id, CAST(n_risk AS INT) AS n_risk_flags, CASE classification
  WHEN 'A' THEN 'El documento presenta características técnicas consistentes con un PDF nativo digital. El software productor reportado es ''' || p || '''. Se detecta texto seleccionable real y fuentes embebidas. '
    || CASE WHEN has_signature THEN 'Se detecta firma digital embebida.' ELSE 'No se detecta firma digital embebida.' END
  WHEN 'B' THEN 'El documento presenta características técnicas compatibles con un PDF escaneado físicamente. Productor: ''' || p || '''. DPI estimado: ' || coalesce(CAST(nullif(dpi_avg, 0) AS VARCHAR), 'N/D') || '. '
    || CASE WHEN has_signature THEN 'Se' ELSE 'No se' END || ' detecta firma digital. No se puede determinar la autenticidad del contenido sin comparación contra el acta física original.'
  WHEN 'C' THEN 'El documento presenta indicios de ser un PDF híbrido: base escaneada con elementos añadidos digitalmente de forma posterior. Productor: ''' || p || '''. Se observan señales compatibles con edición posterior al escaneo original.'
  WHEN 'D' THEN 'El documento presenta señales compatibles con un PDF imagen artificial: una imagen insertada en un contenedor PDF por software de generación. Productor identificado: ''' || p
    || ''' (librería de generación PDF). No se detectan huellas de escaneo físico real. IMPORTANTE: esto no implica necesariamente fraude; puede ser un flujo legítimo de digitalización. Se requiere verificación adicional.'
  ELSE 'La evidencia técnica disponible no es suficiente para clasificar con certeza el origen del documento. Productor: ''' || p || '''. Se recomienda análisis adicional con herramientas especializadas.' END
  || ' Nivel de confianza: ' || confidence || '. ' || CASE WHEN n_risk = 0 THEN 'Sin indicadores de riesgo detectados' WHEN n_risk <= 2 THEN CAST(n_risk AS VARCHAR) || ' indicador(es) de riesgo que requieren revisión'
    ELSE CAST(n_risk AS VARCHAR) || ' indicadores de riesgo que requieren atención prioritaria' END || '.' AS conclusion
FROM (SELECT *, coalesce(producer, 'no identificado') AS p FROM v_class)"""


@query("x11_forensic_conclusion", _CONCLUSION, _FACTS)
def x11(spark, sf):
    return forensics.forensic_conclusion(forensics.classify_origin(t.v_facts(spark, sf))).select("doc_id", "n_risk_flags", "conclusion")


_SHOWN = "CASE comp WHEN 0 THEN 'JPEG' WHEN 1 THEN 'CCITT, Flate/ZIP' ELSE 'Flate/ZIP' END"
_LISTS = ("indicators_for", "indicators_against", "risk_flags", "proof_needed", "cannot_determine")


@query("x12_canonical_record", f"""
SELECT doc_id, producer, producer_category, creation_date, mod_date, metadata_stream, xmp_present, has_signature, has_javascript, has_attachments, has_updates, update_count, eof_count,
  has_text, has_fonts, has_vectors, has_hidden_text, 'mixed' AS document_model, {_SHOWN} AS compressions, dpi_avg, total_pages, pages_single, scan_score, artificial_score, noise_level,
  CASE WHEN has_gaps THEN '12, 40' ELSE '' END AS histogram_gaps, yellow_pixels, yellow_pixels > 50 AS yellow_detected, classification, {_TEXTS} AS classification_text, confidence,
  concat_ws(' | ', CASE WHEN has_text THEN 'Texto seleccionable real presente.' END, CASE WHEN has_fonts THEN 'Fuentes embebidas en el documento.' END,
    CASE WHEN has_vectors THEN 'Objetos vectoriales/drawings detectados.' END, CASE WHEN generated THEN 'Producer ''' || p || ''' es una librería de generación PDF.' END,
    CASE WHEN has_signature AND NOT has_updates THEN 'Firma digital presente y sin actualizaciones incrementales.' END,
    CASE WHEN single AND NOT has_text THEN 'Todas las páginas son imagen única (' || pages_single || '/' || total_pages || ') sin texto.' END,
    CASE WHEN has_hidden_text AND NOT has_text THEN 'OCR invisible superpuesto sobre imagen (escáner + OCR automático).' END,
    CASE WHEN producer_category = 'scanner' THEN 'Producer ''' || p || ''' es compatible con escáner/MFP.' END,
    CASE WHEN scan_score >= 40 THEN 'Análisis de imagen: score de escaneo real = ' || scan_score || '/100.' END,
    CASE WHEN dpi_avg BETWEEN 150 AND 400 THEN 'DPI estimado (' || dpi_avg || ') en rango típico de escáner (150–400).' END,
    CASE WHEN comp < 2 THEN 'Compresión [''' || replace({_SHOWN}, ', ', ''', ''') || '''] compatible con escáner.' END) AS indicators_for,
  concat_ws(' | ', CASE WHEN NOT has_signature THEN 'Sin firma digital embebida.' END, CASE WHEN NOT metadata_stream THEN 'Sin stream de metadatos extendido.' END,
    CASE WHEN has_updates THEN 'Actualizaciones incrementales (' || update_count || ') reducen la certeza del estado original.' END,
    CASE WHEN producer_category = 'desconocido' THEN 'Producer no identificado o ausente.' END,
    CASE WHEN scan_score < 20 AND score_b > 0 THEN 'La imagen no presenta características claras de escaneo físico real.' END) AS indicators_against,
  concat_ws(' | ', CASE WHEN generated THEN 'Producer ''' || p || ''' es una librería de generación PDF, no un escáner ni software de ofimática estándar.' END,
    CASE WHEN generated AND single THEN 'Combinación crítica: imagen única por página + producer es librería de generación PDF. Compatible con imagen insertada artificialmente en contenedor PDF.' END,
    CASE WHEN artificial_score >= 40 THEN 'Score de fabricación artificial = ' || artificial_score || '/100.' END,
    CASE WHEN noise_level < 1.5 AND pages_single > 0 THEN 'Imagen con ruido extremadamente bajo: inusual en escaneos físicos reales.'
      WHEN generated AND noise_level > 0 THEN 'Nota: el ruido detectado puede ser artefacto de compresión JPEG, no necesariamente grano de escáner físico.' END,
    CASE WHEN NOT metadata_stream AND NOT xmp_present THEN 'Sin stream de metadatos XMP (atípico para escáneres modernos).' END,
    CASE WHEN has_updates THEN 'Actualizaciones incrementales detectadas (' || update_count || '). Indica modificación posterior a la creación original.' END,
    CASE WHEN score_b >= 30 AND (has_text OR has_fonts OR has_vectors) THEN 'Base escaneada con elementos digitales superpuestos (fuentes/texto/vectores).' END,
    CASE WHEN NOT has_signature THEN 'Sin firma digital embebida (no verificable criptográficamente).' END,
    CASE WHEN dpi_avg <> 0 AND (dpi_avg < 72 OR dpi_avg > 1200) THEN 'DPI estimado (' || dpi_avg || ') fuera de rango habitual.' END,
    CASE WHEN mod_date <> creation_date THEN 'Fecha de modificación (' || mod_date || ') difiere de la creación (' || creation_date || ').' END) AS risk_flags,
  concat_ws(' | ', CASE WHEN NOT has_signature THEN 'Firma digital criptográfica verificable que certifique la integridad del documento.' END,
    CASE WHEN has_updates THEN 'Revisión de cada versión incremental del PDF para identificar qué se modificó.' END,
    CASE WHEN classification = 'D' OR artificial_score > 30 THEN 'Análisis ELA (Error Level Analysis) sobre la imagen embebida para detectar recompresión diferencial. | Verificación de la cadena de custodia digital del archivo.' END,
    CASE WHEN classification = 'B' THEN 'Análisis de puntos MIC (Machine Identification Code) con herramienta ''deda'' a 600 DPI para identificar el dispositivo físico de impresión/escaneo.' END) AS proof_needed,
  concat_ws(' | ', 'Sin firma digital criptográfica verificable, no es posible afirmar con certeza que el documento no fue alterado.',
    CASE WHEN classification <> 'A' THEN 'No se puede determinar la autenticidad del contenido visual sin comparación contra el acta física original.' END) AS cannot_determine,
  n_alerts, alert_levels, summary, conclusion, '{forensics.LEGAL_NOTICE}' AS legal_notice
FROM (SELECT *, coalesce(producer, 'None') AS p, concat_ws(' ', CASE WHEN has_signature THEN 'ok' ELSE 'alerta' END, CASE WHEN has_updates THEN 'alerta' END, CASE WHEN has_javascript THEN 'alerta' END,
    CASE WHEN has_attachments THEN 'alerta' END, CASE WHEN has_gaps THEN 'alerta' END, CASE WHEN yellow_pixels > 50 THEN 'info' END,
    CASE WHEN classification IN ('C', 'D') THEN 'alerta' WHEN classification IN ('A', 'B') THEN 'info' END) AS alert_levels FROM v_class)
JOIN ({_ALERTS}) USING (doc_id) JOIN ({_CONCLUSION}) USING (doc_id)""", _FACTS)
def x12(spark, sf):
    """The record with its lists as text; of the alerts the levels."""
    r = forensics.canonical_record(t.v_facts(spark, sf))
    return r.withColumns({c: F.array_join(c, " | ") for c in _LISTS} | {
        "compressions": F.array_join("compressions", ", "), "histogram_gaps": F.array_join(F.col("histogram_gaps").cast("array<string>"), ", "),
        "alert_levels": F.array_join(F.transform("alerts", lambda a: a["nivel"]), " ")}).drop("alerts")


# ---- anomaly model ------------------------------------------------------------------------------


def _reports(spark, sf):
    """Newest report facts per sheet: class and scores next to the alerts."""
    return t.v_report_log(spark, sf).withColumns({
        "classification": F.when(F.col("report_id") % 5 == 0, "D").otherwise("B"),
        "scan_score": (F.col("report_id") % 100).cast("int"), "artificial_score": (F.col("report_id") % 90).cast("int")})


def _features(spark, sf, compat=False):
    return model.features(t.v_sheet(spark, sf), t.v_line(spark, sf), t.v_compare_log(spark, sf), _reports(spark, sf), compat)


def _features_sql(compat: bool, show=lambda x: f"round({x}, 6)") -> str:
    return f"""
    SELECT s.sheet_id, s.station, s.contest_id, {'0.0, 0.0, 0.0, 0.0' if compat else 'v.sum_valid::DOUBLE, v.blanks::DOUBLE, v.nulls::DOUBLE, v.challenged::DOUBLE'}, s.emitted::DOUBLE AS emitted,
      {'300.0' if compat else 's.eligible::DOUBLE'} AS electors, {show('0.0' if compat else 's.emitted * 1.0 / s.eligible')} AS turnout, {show('0.0' if compat else 'v.nulls * 1.0 / s.emitted')} AS null_ratio,
      {show('0.0' if compat else 'v.blanks * 1.0 / s.emitted')} AS blank_ratio, CASE WHEN c.sheet_id IS NULL THEN 0.5 WHEN c.status = 'alerta' THEN 1.0 ELSE 0.0 END AS discrepancy,
      CASE WHEN r.report_id % 5 = 0 THEN 1.0 ELSE 0.0 END AS type_d, coalesce(r.report_id % 100, 50)::DOUBLE AS scan_score, coalesce(r.report_id % 90, 0)::DOUBLE AS artificial_score, coalesce(r.n_alerts, 0)::DOUBLE AS alerts
    FROM v_sheet s JOIN v_sums v USING (sheet_id) LEFT JOIN (SELECT * FROM v_compare_log QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY ts DESC, compare_id DESC) = 1) c USING (sheet_id)
    LEFT JOIN (SELECT * FROM v_report_log QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY ts DESC, report_id DESC) = 1) r USING (sheet_id)""".replace(
        "0.0, 0.0, 0.0, 0.0", "0.0::DOUBLE AS party_votes, 0.0::DOUBLE AS blank, 0.0::DOUBLE AS null, 0.0::DOUBLE AS challenged").replace(
        "v.sum_valid::DOUBLE, v.blanks::DOUBLE, v.nulls::DOUBLE, v.challenged::DOUBLE",
        "v.sum_valid::DOUBLE AS party_votes, v.blanks::DOUBLE AS blank, v.nulls::DOUBLE AS null, v.challenged::DOUBLE AS challenged")


_FEATURE_VIEWS = "v_sheet v_sums v_compare_log v_report_log"

for _compat in (False, True):
    @query("m01_features" + ("_compat" if _compat else ""), _features_sql(_compat), _FEATURE_VIEWS)
    def m01(spark, sf, compat=_compat):
        f = _features(spark, sf, compat)
        return f.withColumns({c: F.round(c, 6) for c in ("turnout", "null_ratio", "blank_ratio")})


def _scored(spark, sf):
    """The features are written once, for the fit's passes and for the scores."""
    f = cut_lineage(_features(spark, sf))
    return model.score(f, model.fit_one_class(f, written=True))


@query("m02_fit_one_class")
def m02(spark, sf):
    m = model.fit_one_class(_features(spark, sf))
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(m.weights)], "j INT, weight DOUBLE").withColumns({"rho": F.lit(m.rho), "gap": F.lit(m.gap)})


@query("m03_score")
def m03(spark, sf):
    return _scored(spark, sf).withColumn("explanation", F.array_join("explanation", " | "))


@query("m04_fit_summary")
def m04(spark, sf):
    return model.fit_summary(_scored(spark, sf))


@query("m05_save_load")
def m05(spark, sf):
    f = cut_lineage(_features(spark, sf))
    path = shared_folder(spark, "model")
    model.save_model(spark, model.fit_one_class(f, written=True), path)
    return model.score(f, model.load_model(spark, path)).select("sheet_id", "score", "is_anomaly")


@query("m06_bulk_report")
def m06(spark, sf):
    return model.bulk_report(_scored(spark, sf))


# A model given as numbers instead of fitted ones, so that SQL can state its scores.
_SCALE = [100.0, 10.0, 10.0, 10.0, 100.0, 100.0, 1.0, 1.0, 1.0, 1.0, 1.0, 50.0, 50.0, 2.0]
_GIVEN_VIEWS = _FEATURE_VIEWS
_GIVEN = f"""
WITH f AS ({_features_sql(False, show=lambda x: x)}), lifted AS (
  SELECT *, list_transform(range(4), lambda j: sqrt(0.5) * cos(j / 2.0 + list_sum(list_transform(range(14), lambda i: x[i + 1] * ((7 * i + 3 * j) % 11 - 5) / 10.0)))) AS l
  FROM (SELECT *, [{', '.join(f'{c if c != "null" else chr(34) + c + chr(34)} / {w}' for c, w in zip(model.FEATURES, _SCALE))}] AS x FROM f)
), judged AS (
  SELECT *, (l[1] * 0.1 + l[2] * 0.2 + l[3] * 0.3 + l[4] * 0.4 - 0.05) * 5.0 AS s FROM lifted
), given AS (
  SELECT sheet_id, station, contest_id, round(s, 6) AS score, s < 0 AS is_anomaly, round(tanh(s), 6) AS score_normalized,
    CASE WHEN abs(s) > 0.5 THEN 'alta' WHEN abs(s) > 0.2 THEN 'media' ELSE 'baja' END AS confidence,
    coalesce(nullif(concat_ws(' | ',
      CASE WHEN turnout > 0.97 THEN 'Participación muy alta (' || printf('%.1f', round(turnout * 100, 1)) || '%): inusual en elecciones peruanas.'
           WHEN turnout < 0.30 THEN 'Participación muy baja (' || printf('%.1f', round(turnout * 100, 1)) || '%): inusual.' END,
      CASE WHEN null_ratio > 0.2 THEN 'Tasa de nulos alta (' || printf('%.1f', round(null_ratio * 100, 1)) || '%): supera el 20%.' END,
      CASE WHEN type_d = 1 THEN 'Acta clasificada como PDF generado artificialmente (Tipo D). Riesgo de adulteración.' END,
      CASE WHEN artificial_score > 60 THEN 'Score artificial alto (' || printf('%.0f', artificial_score) || '/100): posible imagen fabricada.' END,
      CASE WHEN discrepancy = 1 THEN 'Discrepancia detectada entre datos de la API y el OCR del acta física.' END,
      CASE WHEN alerts >= 3 THEN 'Múltiples alertas forenses (' || printf('%.0f', alerts) || '): revisión recomendada.' END), ''),
      CASE WHEN s < 0 THEN 'Combinación estadística inusual (score=' || printf('%.3f', round(s, 3)) || '). Sin factor individual dominante.'
           ELSE 'Acta dentro de los parámetros estadísticos normales.' END) AS explanation
  FROM judged
)
"""


def _given() -> model.OneClassModel:
    return model.OneClassModel(
        mean=np.zeros(14), scale=np.array(_SCALE), directions=np.array([[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(4)] for i in range(14)]),
        offsets=np.arange(4) / 2, weights=np.array([0.1, 0.2, 0.3, 0.4]), rho=0.05, nu=0.05, n=100)


@query("m03_score_given", _GIVEN + "SELECT * FROM given", _GIVEN_VIEWS)
def m03_given(spark, sf):
    """All sheets scored by a given model."""
    return model.score(_features(spark, sf), _given()).select(
        "sheet_id", "station", "contest_id", F.round("score", 6).alias("score"), "is_anomaly", F.round("score_normalized", 6).alias("score_normalized"),
        "confidence", F.array_join("explanation", " | ").alias("explanation"))


@query("m04_fit_summary_given", _GIVEN + """
SELECT count(*) AS n_samples, count(*) FILTER (is_anomaly) AS n_anomalies, round(count(*) FILTER (is_anomaly) * 100.0 / count(*), 1) AS pct_anomalies FROM given""", _GIVEN_VIEWS)
def m04_given(spark, sf):
    return model.fit_summary(model.score(_features(spark, sf), _given()))


@query("m05_save_load_given", _GIVEN + "SELECT sheet_id, score, is_anomaly FROM given", _GIVEN_VIEWS)
def m05_given(spark, sf):
    """Scores of the given model after it was written and read back."""
    path = shared_folder(spark, "model")
    model.save_model(spark, _given(), path)
    return model.score(_features(spark, sf), model.load_model(spark, path)).select("sheet_id", F.round("score", 6).alias("score"), "is_anomaly")


@query("m06_bulk_report_given", _GIVEN + """
SELECT sheet_id, station, contest_id, score, confidence, explanation, (SELECT count(*) FROM given) AS analysed FROM given WHERE is_anomaly""", _GIVEN_VIEWS)
def m06_given(spark, sf):
    r = model.bulk_report(model.score(_features(spark, sf), _given()))
    return r.withColumn("score", F.round("score", 6))
