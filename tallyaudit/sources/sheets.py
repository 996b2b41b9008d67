"""From published sheet documents to sheets, vote lines and state times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.values import strip

# State code of each step in a sheet's log.
STATE_CODES = {"T": "scanned", "D": "typed", "C": "counted", "O": "observed", "J": "sent_jee"}


def whole(c: Column) -> Column:
    """A published number as a whole one, written plain, quoted or with decimals; null where it is none."""
    return c.cast("string").try_cast("decimal(38,6)").try_cast("bigint")


def parse_sheets(raw: DataFrame) -> DataFrame:
    """Sheets whose document is present and is JSON; a field that does not fit is null, the sheet stays.

    ``raw`` carries the envelope (sheet_id, station, contest_id, contest, state, ...) and ``api_json``.
    """
    usable = raw.where(F.col("api_json").isNotNull() & ~strip(F.col("api_json")).isin("", "{}"))
    parsed = usable.withColumn("doc", F.from_json(
        "api_json", schema.SHEET_DOC + ", _bad STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return (
        parsed.where(F.col("doc").isNotNull() & (F.col("doc._bad").isNull() | F.try_parse_json("api_json").isNotNull()))
        .withColumns({
            "eligible": whole(F.col("doc.totalElectoresHabiles")),
            "emitted": whole(F.col("doc.totalVotosEmitidos")),
            "valid": whole(F.col("doc.totalVotosValidos")),
            "declared_pct": F.col("doc.porcentajeParticipacionCiudadana").try_cast("double"),
        })
        .drop("api_json")
    )


def sheet_lines(sheets: DataFrame) -> DataFrame:
    """One row per vote line in printed order; both field spellings are read, null votes drop."""
    keys = [c for c in ("sheet_id", "station", "contest_id", "contest") if c in sheets.columns]
    return (
        sheets.select(*keys, F.posexplode("doc.detalle").alias("pos", "item"))
        .select(
            *keys, "pos",
            F.coalesce(F.nullif(F.col("item.adCodigo"), F.lit("")), F.col("item.adAgrupacionPolitica"))
            .alias("code"),
            F.coalesce("item.descripcion", "item.adDescripcion").alias("name"),
            whole(F.coalesce("item.nvotos", "item.adVotos")).alias("votes"),
        )
        .where(F.col("votes").isNotNull())
    )


def state_log(sheets: DataFrame) -> DataFrame:
    """State changes in logged order: sheet_id, pos, state_code, ts_ms."""
    return sheets.select("sheet_id", F.posexplode("doc.lineaTiempo").alias("pos", "e")).select(
        "sheet_id", "pos", F.col("e.codigoEstadoActa").alias("state_code"),
        whole(F.col("e.fechaRegistro")).alias("ts_ms"))


def state_times(log: DataFrame) -> DataFrame:
    """One row per sheet with the time of each known state; the last entry of a code wins.

    ``max_by`` combines on the map side, so one very long log stays cheap.
    """
    known = log.where(F.col("state_code").isin(*STATE_CODES) & (F.coalesce("ts_ms", F.lit(0)) != 0))
    return known.groupBy("sheet_id").agg(*[
        F.max_by("ts_ms", F.when(F.col("state_code") == code, F.col("pos"))).alias(f"{name}_ms")
        for code, name in STATE_CODES.items()
    ])


def attachment_id(files: Column, kind: int = 1) -> Column:
    """Id of the first attachment of the wanted kind, else of the first one."""
    wanted = F.filter(files, lambda f: whole(f["tipo"]) == kind)
    return F.coalesce(F.get(wanted, F.lit(0))["id"], F.get(files, F.lit(0))["id"])
