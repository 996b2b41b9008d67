"""Text extraction and entity lists."""

from pyspark.sql import functions as F

from ..operators import entities, texts
from ..sources import tables as t
from .catalog import query

_CHARS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _rx(name: str) -> str:
    """First match of a field's patterns in prose."""
    tries = ", ".join("nullif(regexp_extract(text, '(?i)" + p.replace("'", "''") + "', 1), '')" for p in texts.FIELD_PATTERNS[name])
    return f"coalesce({tries})"


_PROSE_FIELDS = ", ".join(f"TRY_CAST({_rx(n)} AS BIGINT)" for n in texts.FIELD_PATTERNS if n != "station")


@query("t01_extract_fields", f"""
SELECT s.sheet_id AS doc_id, station, CASE WHEN m = 0 THEN eligible END AS electors, CASE WHEN m = 0 THEN emitted END AS voters,
  emitted AS emitted, NULL::BIGINT AS valid, n.votes AS nulls, b.votes AS blanks, c.votes AS challenged
FROM (SELECT *, sheet_id % 4 AS m FROM v_sheet) s LEFT JOIN v_line n ON n.sheet_id = s.sheet_id AND n.code = 81 AND m <> 2
LEFT JOIN v_line b ON b.sheet_id = s.sheet_id AND b.code = 80 AND m <> 2 LEFT JOIN v_line c ON c.sheet_id = s.sheet_id AND c.code = 90 AND m <> 2 WHERE m <> 2
UNION ALL SELECT sheet_id, station, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM v_sheet WHERE sheet_id % 4 = 2
UNION ALL SELECT -1 - doc_id, lpad({_rx('station')}, 6, '0'), {_PROSE_FIELDS} FROM documents""", "v_sheet v_line")
def t01(spark, sf):
    return texts.extract_fields(t.v_texts(spark, sf)).select(
        "doc_id", "station", "electors", "voters", "emitted", "valid", "nulls", "blanks", "challenged")


_SIG = texts.SIGNATURE_PATTERN
_DNI = texts.DNI_PATTERN
_TIME = texts.TIME_PATTERN


@query("t02_extract_lists", f"""
SELECT sheet_id AS doc_id, 'FIRMA,PRESIDENTE' AS signatures, lpad(CAST(sheet_id AS VARCHAR), 8, '0') AS ids, '16:' || lpad(CAST(sheet_id % 60 AS VARCHAR), 2, '0') AS times FROM v_sheet
UNION ALL SELECT -1 - doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_SIG}'))), ','), array_to_string(regexp_extract_all(text, '{_DNI}', 1), ','),
  array_to_string(list_transform(list_zip(regexp_extract_all(text, '{_TIME}', 1), regexp_extract_all(text, '{_TIME}', 2)), lambda z: z[1] || ':' || z[2]), ',') FROM documents""", "v_sheet")
def t02(spark, sf):
    return texts.extract_lists(t.v_texts(spark, sf)).select(
        "doc_id", F.array_join("signatures", ",").alias("signatures"), F.array_join("ids", ",").alias("ids"),
        F.array_join("times", ",").alias("times"))


@query("t03_text_sections", """
WITH n AS (SELECT s.sheet_id, count(*) FILTER (kind = 'party') AS p, count(*) FILTER (kind = 'party' AND code % 2 = 0) AS e, count(*) FILTER (kind <> 'party') AS x
  FROM v_sheet s JOIN v_line USING (sheet_id) GROUP BY 1)
SELECT sheet_id AS doc_id, CAST(idx AS INT) AS idx, label, CAST(n_lines AS INT) AS n_lines FROM (
  SELECT sheet_id, 0 AS idx, 'ENCABEZADO' AS label, 1 AS n_lines FROM n WHERE sheet_id % 4 = 1
  UNION ALL SELECT sheet_id, 1, 'TABLA DE PARTIDOS', greatest(p, 1) FROM n WHERE sheet_id % 4 = 1
  UNION ALL SELECT sheet_id, 2, 'TOTALES', x + 2 FROM n WHERE sheet_id % 4 = 1
  UNION ALL SELECT sheet_id, 0, 'COLUMNA PARTIDOS', 1 + greatest(e, 1) FROM n WHERE sheet_id % 4 = 2
  UNION ALL SELECT sheet_id, 1, 'COLUMNA VOTOS (DIGITOS)', 25 FROM n WHERE sheet_id % 4 = 2
  UNION ALL SELECT sheet_id, 2, 'FIN', 1 FROM n WHERE sheet_id % 4 = 2)""", "v_sheet v_line")
def t03(spark, sf):
    return texts.text_sections(t.v_texts(spark, sf)).drop("body")


@query("t04_table_votes", """
SELECT sheet_id AS doc_id, CASE WHEN real THEN b.name ELSE 'CANDIDATO LIBRE' END AS party, CAST(votes AS INT) AS votes FROM v_line JOIN ballot b ON b.row = code
WHERE kind = 'party' AND sheet_id % 4 = 1 AND votes <= 500 QUALIFY row_number() OVER (PARTITION BY sheet_id, party ORDER BY code) = 1""", "v_line ballot")
def t04(spark, sf):
    return texts.table_votes(t.v_texts(spark, sf))


@query("t05_fulltext_votes")
def t05(spark, sf):
    return texts.fulltext_votes(t.v_texts(spark, sf))


@query("t06_special_totals", """
SELECT sheet_id AS doc_id, CASE code WHEN 80 THEN 'VOTOS EN BLANCO' WHEN 81 THEN 'VOTOS NULOS' ELSE 'VOTOS IMPUGNADOS' END AS label, CAST(votes AS INT) AS votes
FROM v_line WHERE code >= 80 AND sheet_id % 4 IN (1, 3) AND votes <= 500
UNION ALL SELECT sheet_id, 'TOTAL EMITIDOS', CAST(emitted AS INT) FROM v_sheet WHERE sheet_id % 4 IN (1, 3) AND emitted <= 500""", "v_line v_sheet")
def t06(spark, sf):
    return texts.special_totals(t.v_texts(spark, sf))


@query("t07_positional_votes", """
SELECT sheet_id AS doc_id, CASE WHEN code % 2 = 0 THEN b.name || ' X' WHEN real THEN b.name ELSE 'PARTIDO FILA ' || CAST(code AS VARCHAR) END AS party, CAST(votes AS INT) AS votes
FROM v_line JOIN ballot b ON b.row = code WHERE kind = 'party' AND sheet_id % 4 = 2 AND votes <= 999
QUALIFY row_number() OVER (PARTITION BY sheet_id, party ORDER BY code DESC) = 1""", "v_line ballot")
def t07(spark, sf):
    return texts.positional_votes(t.v_texts(spark, sf))


@query("t08_party_name_lines", """
SELECT sheet_id AS doc_id, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY code) - 1 AS INT) AS idx, CAST(code AS INT) AS row, b.name || ' X' AS name
FROM v_line JOIN ballot b ON b.row = code WHERE kind = 'party' AND sheet_id % 4 = 2 AND code % 2 = 0""", "v_line ballot")
def t08(spark, sf):
    return texts.party_name_lines(t.v_texts(spark, sf))


@query("t09_label_value_pairs", """
SELECT s.sheet_id AS doc_id, CAST(b.votes AS INT) AS blanks, CAST(n.votes AS INT) AS nulls, CAST(c.votes AS INT) AS challenged,
  CASE WHEN m THEN CAST(emitted AS INT) END AS emitted, CASE WHEN m THEN CAST(emitted AS INT) END AS voters
FROM (SELECT *, sheet_id % 4 = 0 AS m FROM v_sheet) s LEFT JOIN v_line b ON b.sheet_id = s.sheet_id AND b.code = 80 AND m
LEFT JOIN v_line n ON n.sheet_id = s.sheet_id AND n.code = 81 AND m LEFT JOIN v_line c ON c.sheet_id = s.sheet_id AND c.code = 90 AND m
UNION ALL SELECT -1 - doc_id, NULL, NULL, NULL, NULL, NULL FROM documents""", "v_sheet v_line")
def t09(spark, sf):
    return texts.label_value_pairs(t.v_texts(spark, sf))


_PAIRED = """
SELECT doc_id, party, CAST(next AS INT) AS votes FROM (
  SELECT d.sheet_id AS doc_id, p.name AS party, d.votes AS next, 1.0 - levenshtein(p.name, d.line) * 1.0 / greatest(length(p.name), length(d.line)) AS s
  FROM (SELECT sheet_id, code AS pos, b.name AS line, votes FROM v_line JOIN ballot b ON b.row = code WHERE kind = 'party' AND sheet_id % 4 = 0
        UNION ALL SELECT sheet_id, 100, 'CIUDADANOS QUE VOTARON', emitted FROM v_sheet WHERE sheet_id % 4 = 0) d, ballot p WHERE p.real
  QUALIFY row_number() OVER (PARTITION BY d.sheet_id, p.name ORDER BY s DESC, d.pos) = 1) WHERE s > 0.55"""


@query("t10_party_next_line_votes", _PAIRED, "v_sheet v_line ballot")
def t10(spark, sf):
    return texts.party_next_line_votes(t.v_texts(spark, sf))


@query("t11_merge_votes")
def t11(spark, sf):
    return texts.merge_votes(t.v_texts(spark, sf))


@query("t12_extract_votes")
def t12(spark, sf):
    return texts.extract_votes(t.v_texts(spark, sf))


@query("t13_entities_to_fields", """
SELECT sheet_id AS doc_id, unnest(['mesa', 'mesa_de_sufragio', 'electores_habiles', 'total_electores_habiles', 'votos_emitidos', 'total_votos_emitidos', 'miembro_mesa', 'miembro_mesa.nombre']) AS field,
  unnest([station, station, CASE WHEN eligible <= 999 THEN CAST(eligible AS VARCHAR) END, replace(CAST(eligible AS VARCHAR), '0', 'O'),
    CASE WHEN emitted <= 999 THEN CAST(emitted AS VARCHAR) END, CAST(emitted AS VARCHAR), 'N' || CAST(sheet_id AS VARCHAR), 'Ana']) AS value FROM v_sheet""", "v_sheet")
def t13(spark, sf):
    return entities.entities_to_fields(entities.parse_entities(t.v_entities(spark, sf)))


_VOTES = """SELECT sheet_id AS doc_id, name AS party, CAST(CASE WHEN code % 3 = 2 OR votes > 999 THEN 0 ELSE votes END AS INT) AS votes FROM v_line WHERE kind = 'party'"""


@query("t14_entities_to_votes", _VOTES, "v_line")
def t14(spark, sf):
    return entities.entities_to_votes(entities.parse_entities(t.v_entities(spark, sf)))


@query("t15_derive_totals", f"""
SELECT doc_id, coalesce(x.valid, CASE WHEN v.s > 0 THEN v.s END) AS valid, coalesce(x.voters, s.emitted) AS voters, s.emitted FROM (SELECT sheet_id AS doc_id, valid, voters FROM v_extract) x
JOIN (SELECT sheet_id AS doc_id, emitted FROM v_sheet) s USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(votes) AS BIGINT) AS s FROM ({_VOTES}) GROUP BY 1) v USING (doc_id)""", "v_line v_extract v_sheet")
def t15(spark, sf):
    x = t.v_extract(spark, sf).selectExpr("sheet_id AS doc_id", "valid", "voters").join(
        t.v_sheet(spark, sf).selectExpr("sheet_id AS doc_id", "emitted"), "doc_id")
    return entities.derive_totals(x, entities.entities_to_votes(entities.parse_entities(t.v_entities(spark, sf))))


@query("t16_merge_extracts", """
SELECT sheet_id, coalesce(a.electors, b.electors) AS electors, coalesce(a.voters, b.voters) AS voters, coalesce(a.valid, b.valid) AS valid
FROM v_extract a LEFT JOIN v_extract2 b USING (sheet_id)""", "v_extract v_extract2")
def t16(spark, sf):
    return entities.merge_extracts(t.v_extract(spark, sf), t.v_extract(spark, sf, 41, 47), "sheet_id")


@query("t17_reader_quality", """
SELECT conv_id AS doc_id, round(avg(1.0 / (1 + turn)), 4) AS confidence, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS tokens,
  count(DISTINCT turn // 2) AS pages, count(*) AS blocks FROM conversations GROUP BY conv_id""")
def t17(spark, sf):
    blocks = t.table(spark, sf, "conversations").selectExpr(
        "conv_id AS doc_id", "turn div 2 AS page", "1.0D / (1 + turn) AS confidence", "size(split(text, ' ')) AS tokens")
    return entities.reader_quality(blocks)


_ANSWER = """CASE turn % 3 WHEN 0 THEN text || ' {"anomalia": true, "confianza": "ALTA", "anotacion": "' || CAST(conv_id AS VARCHAR) || '"} fin'
  WHEN 1 THEN 'x {"anomalia": false, "confianza": "Media", "anotacion": "ok"}' ELSE text || ' {"anomalia": tru' END"""


@query("t18_parse_verdict", f"""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS anomaly, CASE turn % 3 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'baja' END AS confidence,
  CASE turn % 3 WHEN 0 THEN CAST(conv_id AS VARCHAR) WHEN 1 THEN 'ok' ELSE {_ANSWER} END AS note FROM conversations""")
def t18(spark, sf):
    c = t.table(spark, sf, "conversations").selectExpr("conv_id", "turn", _ANSWER.replace("VARCHAR", "STRING") + " AS answer")
    return c.select("conv_id", "turn", entities.parse_verdict(F.col("answer")).alias("v")).select("conv_id", "turn", "v.*")


@query("t19_extract_vote_table", """
SELECT sheet_id AS doc_id, name AS party, votes, kind <> 'party' AS special, CAST(sum(CASE WHEN kind = 'party' THEN votes ELSE 0 END) OVER (PARTITION BY sheet_id) AS BIGINT) AS party_sum FROM v_line""", "v_line")
def t19(spark, sf):
    return texts.extract_vote_table(t.v_line(spark, sf).selectExpr("sheet_id AS doc_id", "name AS party", "votes"))
