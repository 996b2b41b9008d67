"""Facts about one extracted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import strip

# Words that show a text is a tally sheet.
QUALITY_WORDS = ["MESA", "ELECCIONES", "PRESIDENTE", "ACTA", "ELECTORAL",
                 "ELECTORES", "HABILES", "VOTOS", "NULOS", "BLANCO",
                 "PARTIDO", "PERU", "TOTAL", "ESCRUTINIO", "FIRMA", "DNI"]


def quality_score(text: Column) -> Column:
    """5 per word present, up to 40 for numbers, up to 20 for length."""
    upper = F.upper(text)
    words = sum((F.when(upper.contains(w), 5).otherwise(0) for w in QUALITY_WORDS), F.lit(0))
    numbers = F.least(F.regexp_count(text, F.lit("[0-9]+")) * 2, F.lit(40))
    length = F.least(F.floor(F.length(text) / 100), F.lit(20))
    return (words + numbers + length).cast("int")


def is_scanned(text: Column, min_chars: int = 100) -> Column:
    """A document whose embedded text is shorter than this needs optical reading."""
    return F.length(strip(F.coalesce(text, F.lit("")))) < min_chars


def preview(text: Column, chars: int = 3000) -> Column:
    return F.struct(F.substring(text, 1, chars).alias("preview"),
                    F.length(text).alias("full_length"))
