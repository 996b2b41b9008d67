"""Official national snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema


def official_totals(snapshot: DataFrame) -> DataFrame:
    """(contest_id, code, name, votes, pct) from ``participants_json`` of each contest."""
    return (
        snapshot.select("contest_id", F.inline(F.from_json("participants_json", schema.PARTICIPANTS)))
        .where(F.coalesce("codigoAgrupacionPolitica", F.lit("")) != "")
        .select(
            "contest_id", F.col("codigoAgrupacionPolitica").alias("code"),
            F.coalesce("nombreAgrupacionPolitica", F.lit("")).alias("name"),
            F.coalesce("totalVotosValidos", F.lit(0)).alias("votes"),
            F.coalesce("porcentajeVotosValidos", F.lit(0.0)).alias("pct"),
        )
    )


def official_turnout(snapshot: DataFrame) -> DataFrame:
    """One row of national turnout with the electors still pending."""
    d = snapshot.select(F.from_json("totals_json", schema.TURNOUT_DOC).alias("d")).select("d.*")
    zero = F.lit(0).cast("long")
    electors = F.coalesce("totalElectoresHabiles", zero)
    present = F.coalesce("totalAsistentes", zero)
    absent = F.coalesce("totalAusentes", zero)
    pending = electors - present - absent
    return d.select(
        electors.alias("electors"), present.alias("present"), absent.alias("absent"),
        F.greatest(zero, pending).alias("pending"),
        F.coalesce("porcentajeAsistentes", F.lit(0.0)).alias("present_pct"),
        F.coalesce("porcentajeAusentes", F.lit(0.0)).alias("absent_pct"),
        F.coalesce(F.round(F.try_divide(pending * 100.0, electors), 3), F.lit(0.0)).alias("pending_pct"),
    )
