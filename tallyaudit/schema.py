"""Declared schemas of the nested documents the audit reads."""

# One official tally sheet as published; numbers are read as text, since some come quoted or with decimals.
SHEET_DOC = """
totalElectoresHabiles STRING, totalVotosEmitidos STRING, totalVotosValidos STRING,
porcentajeParticipacionCiudadana STRING,
detalle ARRAY<STRUCT<adCodigo: STRING, adAgrupacionPolitica: STRING, adDescripcion: STRING,
                     adVotos: STRING, descripcion: STRING, nvotos: STRING>>,
lineaTiempo ARRAY<STRUCT<codigoEstadoActa: STRING, fechaRegistro: STRING>>,
archivos ARRAY<STRUCT<id: STRING, tipo: STRING>>
"""

# Official participants of one contest.
PARTICIPANTS = """
ARRAY<STRUCT<codigoAgrupacionPolitica: STRING, nombreAgrupacionPolitica: STRING,
             totalVotosValidos: BIGINT, porcentajeVotosValidos: DOUBLE>>
"""

# Official national turnout.
TURNOUT_DOC = """
totalElectoresHabiles BIGINT, totalAsistentes BIGINT, totalAusentes BIGINT,
porcentajeAsistentes DOUBLE, porcentajeAusentes DOUBLE
"""

# One entity list of a document reader.
ENTITIES = """
ARRAY<STRUCT<tipo: STRING, texto: STRING, confidence: DOUBLE, normalizado: STRING,
             sub_entidades: ARRAY<STRUCT<tipo: STRING, texto: STRING, conf: DOUBLE>>>>
"""

ALERTS = "ARRAY<STRUCT<nivel: STRING, mensaje: STRING>>"
