"""Writers: append-only history and the CSV export of the sheet list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header of the exported list.
EXPORT_HEADER = [
    "Mesa", "ID Elección", "Tipo Elección", "Estado",
    "Tiene PDF", "Tiene OCR", "Es Escaneado", "Método OCR",
    "Tiene Forense", "Anomalía Forense", "Anomalía SVM", "Score SVM", "Confianza SVM",
    "Estado Comparación", "Nro Discrepancias", "Fecha Descarga",
]


def append_history(df: DataFrame, path: str, partition_by: str = "contest_id") -> None:
    """Reader results and comparisons keep their history; readers take the latest per key."""
    df.write.mode("append").partitionBy(partition_by).parquet(path)


def export_sheet_list(listing: DataFrame) -> DataFrame:
    """The 16 text columns of the export, in header order."""
    def yes_no(c: Column) -> Column:
        return F.when(c, "SI").otherwise("NO")

    def tri(c: Column) -> Column:
        return F.when(c.isNull(), "—").when(c, "SI").otherwise("NO")

    def or_dash(c: Column) -> Column:
        return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("—"))

    cols = [
        F.col("station"), F.col("contest_id").cast("string"), F.coalesce("contest", F.lit("")),
        F.coalesce("state", F.lit("")),
        yes_no(F.col("has_pdf")), yes_no(F.col("has_reader")),
        F.when(F.col("scanned").isNull(), "—").when(F.col("scanned"), "ESCANEADO").otherwise("DIGITAL"),
        or_dash(F.col("method")), yes_no(F.col("has_report")), tri(F.col("report_flag")),
        tri(F.col("score_flag")), or_dash(F.col("score")), or_dash(F.col("confidence")),
        or_dash(F.col("compare_status")), F.coalesce("n_discrepancies", F.lit(0)).cast("string"),
        or_dash(F.col("captured_text")),
    ]
    return listing.select(*[c.alias(h) for c, h in zip(cols, EXPORT_HEADER)])


def write_export(listing: DataFrame, folder: str, day: str) -> str:
    """Write the export as quoted CSV part files under a dated folder name."""
    path = f"{folder}/resultados_actas_{day}.csv"
    (export_sheet_list(listing).write.mode("overwrite")
     .option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
    return path
