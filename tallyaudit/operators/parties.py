"""Party totals, official reconciliation and share outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import line_kind
from ..functions.values import strip
from ..session import cut_lineage


def party_totals(lines: DataFrame, top: int | None = None) -> DataFrame:
    """Votes and line count per (contest, party code), ranked inside the contest."""
    named = lines.where(
        (F.coalesce(F.col("code").cast("string"), F.lit("")) != "")
        & (strip(F.coalesce("name", F.lit(""))) != "")
        & ~F.upper("name").rlike("NULO|BLANCO|IMPUGN"))
    totals = named.groupBy("contest_id", "code").agg(
        F.min_by(strip(F.col("name")), "sheet_id").alias("name"), F.sum("votes").alias("votes"),
        F.count("*").alias("n_lines"))
    w = Window.partitionBy("contest_id").orderBy(F.col("votes").desc(), F.col("code").asc())
    ranked = totals.withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def local_vs_official(lines: DataFrame, official: DataFrame, flag_pct: float = 15.0) -> DataFrame:
    """Official party totals against ours; the official side drives."""
    local = party_totals(lines).select(
        "contest_id", F.col("code").cast("string").alias("code"), F.col("votes").alias("_v"),
        F.col("n_lines").alias("_n"))
    off = official.select("contest_id", "code", "name", F.col("votes").alias("votes_official"), "pct")
    j = off.join(local, ["contest_id", "code"], "left").withColumn("votes_local", F.coalesce("_v", F.lit(0)))
    diff = F.col("votes_official") - F.col("votes_local")
    diff_pct = F.when(F.col("votes_official") > 0,
                      F.round(diff * 100.0 / F.col("votes_official"), 2)).otherwise(0.0)
    return j.select(
        "contest_id", "code", "name", "votes_official", "votes_local",
        F.coalesce("_n", F.lit(0)).alias("n_lines"), diff.alias("diff"), diff_pct.alias("diff_pct"),
        F.col("pct").alias("pct_official"), (F.abs(diff_pct) > flag_pct).alias("flagged"))


def party_shares(sheets: DataFrame, lines: DataFrame) -> DataFrame:
    """Each party's share of the valid votes of its sheet."""
    parties = lines.where(
        (line_kind(F.col("code"), F.col("name"), "share") == "party") & F.col("votes").isNotNull()
        & (F.coalesce(F.col("code").cast("string"), F.lit("")) != "")
    ).select("sheet_id", "code", strip(F.col("name")).alias("name"), "votes")
    valid = sheets.where(F.coalesce("valid", F.lit(0)) != 0).select(
        "sheet_id", "station", "contest_id", "contest", "valid")
    return valid.join(parties, "sheet_id").withColumn("share", F.col("votes") * 100.0 / F.col("valid"))


def party_outliers(sheets: DataFrame, lines: DataFrame, z_min: float = 2.5, z_high: float = 4.0,
                   min_n: int = 3, min_std: float = 0.01, limit: int | None = None) -> DataFrame:
    """Sheets where a party's share is far from that party's contest-wide distribution.

    Mean and deviation come from a grouped aggregate, never from a window: a (contest, party) group
    spans every station. The statistics are written once, so the join sees their real size: small ones
    are broadcast and the detail side is not shuffled again, large ones join by shuffle.
    """
    shares = party_shares(sheets, lines)
    stats = cut_lineage(shares.groupBy("contest_id", "code").agg(
        F.avg("share").alias("mean"), F.stddev_samp("share").alias("std"), F.count("*").alias("n")
    ).where((F.col("n") >= min_n) & (F.col("std") >= min_std)))
    z = F.abs(F.col("share") - F.col("mean")) / F.col("std")
    hits = shares.join(stats, ["contest_id", "code"]).withColumn("z", z).where(F.col("z") >= z_min)
    out = hits.select(
        "sheet_id", "station", "contest_id", "contest", "name", "code", "votes",
        F.round("share", 2).alias("share"), F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"),
        F.round("z", 2).alias("z_score"),
        F.when(F.col("share") > F.col("mean"), "Porcentaje muy por encima de la media")
        .otherwise("Porcentaje muy por debajo de la media").alias("reason"),
        F.when(F.col("z") > z_high, "alta").otherwise("media").alias("severity"))
    if limit is None:
        return out
    return out.orderBy(F.col("z_score").desc(), "sheet_id", "code").limit(limit)


def outliers_by_party(outliers: DataFrame, top: int = 12) -> DataFrame:
    return outliers.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(top)
