"""Landed documents: one row of file facts per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File name of a stored sheet, the magic bytes and the smallest cached size.
SHEET_PATH = r"acta_([0-9]{6})_e([0-9]+)\.[A-Za-z0-9]+$"
MAGIC = "%PDF-"
MIN_CACHED_BYTES = 1024


def read_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Stored files below ``path`` with their bytes; Spark lists no files without a byte."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(path))


def scan_documents(files: DataFrame) -> DataFrame:
    """File facts of ``path``, ``content`` rows: identity, size, digests, validity, reusability."""
    size = F.octet_length("content").cast("long")
    return files.select(
        "path",
        F.nullif(F.regexp_extract("path", SHEET_PATH, 1), F.lit("")).alias("station"),
        F.regexp_extract("path", SHEET_PATH, 2).try_cast("int").alias("contest_id"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
        size.alias("size_bytes"),
        F.round(size / 1024.0, 1).alias("size_kb"),
        F.sha2("content", 256).alias("sha256"),
        F.md5("content").alias("md5"),
        (F.substring("content", 1, 5) == F.lit(MAGIC).cast("binary")).alias("is_pdf"),
        (size > MIN_CACHED_BYTES).alias("reusable"),
    )
