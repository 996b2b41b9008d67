"""Edge cases of the audit rules on small hand-made inputs."""

import json

from pyspark.sql import functions as F

from tallyaudit.functions import clock, lines, names, values
from tallyaudit.operators import compare, forensics, history, sums, sweep, turnout
from tallyaudit.sources import sheets


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_station_padding_never_truncates(spark):
    r = one(spark, a=values.pad_station(F.lit("42")), b=values.pad_station(F.lit("1234567")))
    assert (r.a, r.b) == ("000042", None)


def test_digit_repair(spark):
    r = one(spark, a=values.repair_digits(F.lit(" 1O ")), b=values.repair_digits(F.lit("xx")),
            c=values.repair_digits(F.lit("1000")), d=values.repair_digits(F.lit("")), e=values.repair_digits(F.lit("lI2")))
    assert tuple(r) == (10, 0, None, None, 112)


def test_first_number(spark):
    r = one(spark, a=values.first_number(F.lit("(22 FUERZA POPULAR)")), b=values.first_number(F.lit("(FE EN EL PERÚ)")),
            c=values.first_number(F.lit("1234 x 7")))
    assert tuple(r) == (22, None, 7)


def test_names(spark):
    r = one(spark, n=names.norm_name(F.lit("  Acción Ñandú ß ª ")),
            same=names.name_match(F.lit("FUERZA POPULAR"), F.lit("FUERZA POPULAR X")),
            other=names.name_match(F.lit("FUERZA POPULAR"), F.lit("RENOVACION POPULAR")),
            short=names.name_match(F.lit("AN"), F.lit("AB")))
    assert r.n == "ACCION NANDU SS a"
    assert (r.same, r.other, r.short) == (True, False, False)


def test_line_kind_rules(spark):
    df = spark.createDataFrame([("81", "x"), ("80", "x"), ("5", "VOTOS IMPUGNADOS"), ("x9", "ALFA"), (None, "Nulos")], "c STRING, n STRING")
    got = df.select(*[lines.line_kind(F.col("c"), F.col("n"), r).alias(r) for r in lines.RULES]).collect()
    assert [r.audit for r in got] == ["null", "blank", "challenged", "party", "null"]
    assert [r.share for r in got] == ["special", "special", "special", "party", "special"]
    assert [r.exact for r in got] == ["party", "party", "special", "party", "special"]
    assert [r.plural for r in got] == ["party", "party", "challenged", "party", "null"]


def test_clock(spark):
    ms = F.lit(1775952000123).cast("long")
    r = one(spark, d=clock.voting_day(ms), h=clock.local_hour(ms), t=clock.local_text(ms),
            none=clock.voting_day(F.lit(None).cast("long")), nh=clock.local_hour(F.lit(None).cast("long")))
    assert tuple(r) == (12, 19, "11/04/2026 19:00:00", 0, -1)


def test_parse_skips_bad_documents_and_reads_both_spellings(spark):
    good = {"totalVotosEmitidos": 10, "totalVotosValidos": 7, "detalle": [
        {"adCodigo": "1", "adDescripcion": "A", "adVotos": 7}, {"adCodigo": "80", "descripcion": "BLANCO", "nvotos": 3},
        {"adCodigo": "2", "adDescripcion": "B", "adVotos": None}],
        "lineaTiempo": [{"codigoEstadoActa": "T", "fechaRegistro": 5}, {"codigoEstadoActa": "T", "fechaRegistro": 4},
                        {"codigoEstadoActa": "C", "fechaRegistro": 0}, {"codigoEstadoActa": "Z", "fechaRegistro": 9}],
        "archivos": [{"id": "a", "tipo": 2}, {"id": "b", "tipo": 1}]}
    raw = spark.createDataFrame(
        [(1, "000001", 10, "P", json.dumps(good)), (2, "000002", 10, "P", "{}"), (3, "000003", 10, "P", "{bad"), (4, "000004", 10, "P", None)],
        "sheet_id LONG, station STRING, contest_id INT, contest STRING, api_json STRING")
    s = sheets.parse_sheets(raw)
    assert [r.sheet_id for r in s.collect()] == [1]
    ls = sheets.sheet_lines(s).orderBy("pos").collect()
    assert [(r.pos, r.code, r.name, r.votes) for r in ls] == [(0, "1", "A", 7), (1, "80", "BLANCO", 3)]
    t = sheets.state_times(sheets.state_log(s)).first()
    assert (t.scanned_ms, t.counted_ms) == (4, None)
    assert s.select(sheets.attachment_id(F.col("doc.archivos"))).first()[0] == "b"
    assert sums.vote_sum_mismatches(s, sheets.sheet_lines(s)).count() == 0


def test_upsert_applies_rows_in_order(spark):
    base = spark.createDataFrame([(1, "old", "u0", "{1}", 0), (2, "b", None, "{2}", 0)], "k INT, s STRING, url STRING, doc STRING, seq INT")
    new = spark.createDataFrame([(1, "x", "u1", "{}", 1), (1, "y", None, None, 2), (3, "z", None, "{}", 1)], base.schema)
    got = {r.k: (r.s, r.url, r.doc) for r in history.upsert_coalesce(base, new, ["k"], ["url"], ["doc"], "seq").collect()}
    assert got == {1: ("y", "u1", "{1}"), 2: ("b", None, "{2}"), 3: ("z", None, "{}")}


def test_turnout_edges(spark):
    s = spark.createDataFrame(
        [(1, "a", "c", 10, 0, None), (2, "b", "c", None, 5, 1.0), (3, "d", "c", 331, 300, 110.4), (4, "e", "c", 301, None, None)],
        "sheet_id INT, station STRING, contest STRING, emitted LONG, eligible LONG, declared_pct DOUBLE")
    got = {(r.sheet_id, r.category, r.severity) for r in turnout.turnout_rules(s).collect()}
    assert got == {(3, "votos_excedentes", "alta"), (3, "sobre_capacidad", "alta"), (3, "participacion_imposible", "alta"),
                   (4, "sobre_capacidad", "media")}
    assert turnout.turnout_outliers(s).count() == 0


def test_quoted_and_decimal_numbers_keep_their_sheet(spark):
    docs = ['{"totalVotosEmitidos": 10, "detalle": [{"adCodigo": "1", "adDescripcion": "A", "adVotos": 7}]}',
            '{"totalVotosEmitidos": 10, "detalle": [{"adCodigo": "1", "adDescripcion": "A", "adVotos": "7"}]}',
            '{"totalVotosEmitidos": "10", "porcentajeParticipacionCiudadana": "85.2", "detalle": []}',
            '{"totalVotosEmitidos": 10.0, "detalle": [{"adCodigo": "1", "adDescripcion": "A", "nvotos": "x"}], "archivos": "none"}',
            '{"totalVotosEmitidos": 1']
    raw = spark.createDataFrame([(i, "000001", 10, "P", d) for i, d in enumerate(docs)],
                                "sheet_id LONG, station STRING, contest_id INT, contest STRING, api_json STRING")
    s = sheets.parse_sheets(raw)
    assert {r.sheet_id: (r.emitted, r.declared_pct) for r in s.collect()} == {0: (10, None), 1: (10, None), 2: (10, 85.2), 3: (10, None)}
    assert {(r.sheet_id, r.votes) for r in sheets.sheet_lines(s).collect()} == {(0, 7), (1, 7)}


def test_name_pairs_lose_no_match(spark):
    import random

    rng = random.Random(5)
    vocabulary = ["PARTIDO", "FRENTE", "NORTE", "UNIDOS", "POPULAR", "PERU", "AL", "VERDE"]
    left, right = ({" ".join(rng.choices(vocabulary, k=rng.randint(1, 6))) for _ in range(120)} for _ in range(2))

    def match(a, b):
        x, y = ({w for w in n.split() if len(w) >= 4} for n in (a, b))
        return a == b or bool(x and y) and len(x & y) / len(x | y) >= 0.5

    frames = [spark.createDataFrame([(n,) for n in sorted(names)], "name STRING") for names in (left, right)]
    got = {(r.a, r.b) for r in compare.name_pairs(*frames).collect()}
    assert got == {(a, b) for a in left for b in right if match(a, b)}


def test_a_word_that_all_names_share_forms_no_pairs(spark):
    left, right = (spark.range(2000).selectExpr(f"concat('PARTIDO {k}', id) AS name") for k in ("NORTE", "SURES"))
    assert compare.name_pairs(left, right.union(left.limit(1))).count() == 1


def test_compat_reaches_the_comparison(spark):
    s = spark.createDataFrame([(1, "a", 10, None, None, None)], "sheet_id INT, station STRING, contest_id INT, eligible LONG, emitted LONG, valid LONG")
    official = spark.createDataFrame([(1, "5", "TOTAL EMITIDOS ALFA", 5, 0)], "sheet_id INT, code STRING, name STRING, votes LONG, pos INT")
    extract = spark.createDataFrame([(1, None, None, None)], "sheet_id INT, electors LONG, voters LONG, valid LONG")
    reader = spark.createDataFrame([(1, "TOTAL EMITIDOS ALFA", 9, 0)], "sheet_id INT, name STRING, votes LONG, pos INT")
    r = compare.compare_status(s, official, extract, reader, compat=True).first()
    assert (r.sum_reader, r.abs_diff, r.n_discrepancies, r.status) == (9, 4, 1, "info")


def test_station_overview_reads_all_sheets(spark):
    rows = [(i, "000001", 10, "CON_ERROR" if i == 15 else "C", "u") for i in range(16)]
    s = spark.createDataFrame(rows, "sheet_id INT, station STRING, contest_id INT, state STRING, file_url STRING")
    events = s.selectExpr("sheet_id", "'e' AS event", "'d' AS date")
    scores = spark.createDataFrame([(0, True, 0.5)], "sheet_id INT, is_anomaly BOOLEAN, score DOUBLE")
    got = sweep.station_overview("000001", s, events, scores).collect()
    assert {(r.n_sheets, r.status) for r in got} == {(16, "CON_ERROR_ACTA")} and len(got) == 16


def test_every_page_is_scored(spark):
    px = spark.range(3 * 64).selectExpr("1L AS doc_id", "CAST(id div 64 AS INT) + 1 AS page", "CAST(id % 64 div 8 AS INT) AS y",
                                        "CAST(id % 8 AS INT) AS x", "CAST(id * 37 % 256 AS INT) AS gray")
    for out in (forensics.artificial_score(forensics.raster_rows(px)), forensics.histogram_gaps(px), forensics.scan_score(px)):
        assert sorted(r.page for r in out.collect()) == [1, 2, 3]
