"""Vote-sum consistency of each sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import line_kind


def line_sums(lines: DataFrame, rule: str = "audit") -> DataFrame:
    """Per sheet: all votes, party votes, null, blank and challenged votes (one partial aggregate)."""
    kind = line_kind(F.col("code"), F.col("name"), rule)

    def total(k: str):
        return F.sum(F.when(F.col("_k") == k, F.col("votes")).otherwise(0))

    return lines.withColumn("_k", kind).groupBy("sheet_id").agg(
        F.sum("votes").alias("sum_all"), total("party").alias("sum_valid"), total("null").alias("nulls"),
        total("blank").alias("blanks"), total("challenged").alias("challenged"))


def vote_sum_mismatches(sheets: DataFrame, lines: DataFrame, ordered: bool = True) -> DataFrame:
    """Sheets whose lines do not add up to the declared totals, largest difference first."""
    checked = sheets.where(F.col("emitted").isNotNull()).join(line_sums(lines), "sheet_id").withColumns({
        "diff_emitted": F.col("sum_all") - F.col("emitted"),
        "diff_valid": F.col("sum_valid") - F.col("valid"),
    })
    wrong = checked.where((F.col("diff_emitted") != 0) | (F.coalesce("diff_valid", F.lit(0)) != 0))
    out = wrong.select(
        "sheet_id", "station", "contest_id", "contest", "emitted", "sum_all", "diff_emitted", "valid",
        "sum_valid", "diff_valid", "nulls", "blanks", "challenged", "eligible", "declared_pct",
        F.round(F.try_divide(F.col("emitted") * 100.0, F.col("eligible")), 3).alias("computed_pct"),
        F.when(F.abs("diff_emitted") > 1, "alta").otherwise("baja").alias("severity"),
    )
    return out.orderBy(F.abs("diff_emitted").desc(), "sheet_id") if ordered else out


def mismatch_by_contest(mismatches: DataFrame) -> DataFrame:
    return mismatches.groupBy("contest").agg(F.count("*").alias("n"))


def check_arithmetic(sheets: DataFrame, lines: DataFrame, tolerance: int = 1) -> DataFrame:
    """Official arithmetic of every sheet; missing totals count as 0 and still compare."""
    zero = F.lit(0).cast("long")
    joined = sheets.join(line_sums(lines, "plural"), "sheet_id", "left")
    sums = {c: F.coalesce(F.col(c), zero) for c in ("sum_all", "sum_valid", "nulls", "blanks", "challenged")}
    diff_valid = sums["sum_valid"] - F.coalesce("valid", zero)
    diff_emitted = sums["sum_all"] - F.coalesce("emitted", zero)
    bad_valid, bad_emitted = F.abs(diff_valid) > tolerance, F.abs(diff_emitted) > tolerance
    return joined.select(
        "sheet_id", "station", "contest_id", sums["sum_valid"].alias("sum_parties"),
        F.coalesce("valid", zero).alias("valid"), F.coalesce("emitted", zero).alias("emitted"),
        sums["nulls"].alias("nulls"), sums["blanks"].alias("blanks"),
        diff_valid.alias("diff_valid"), diff_emitted.alias("diff_emitted"),
        (~(bad_valid | bad_emitted)).alias("consistent"),
        (bad_valid.cast("int") + bad_emitted.cast("int")).alias("n_alerts"))
