"""Scalar column expressions: ids, numbers, labels, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by a full trim.
WHITESPACE = " \t\n\r\x0b\x0c"

# Label of every sweep status.
STATUS_LABELS = {
    "NO_EXISTE": "No existe en ONPE",
    "EXISTE_SIN_PDF": "Registrada (sin PDF)",
    "EXISTE_CON_PDF": "Registrada (con PDF)",
    "PARA_JEE": "Para envío al JEE",
    "CON_ERROR_ACTA": "Con error en acta",
    "OBSERVADA": "Observada / impugnada",
    "ERROR_API": "Error de consulta",
}

# Label of every curated category.
CATEGORY_LABELS = {
    "normal": "Normal / Desmentida",
    "sospecha": "Sospecha / Disputa no resuelta",
    "incidencia": "Incidencia real de custodia",
    "observada": "Observada / Enviada al JEE",
    "analisis": "Para análisis forense",
    "referencia": "Referencia",
}

# Producer keywords of document-generating software.
GENERATION_PRODUCERS = [
    "itext", "reportlab", "wkhtmltopdf", "imagemagick", "ghostscript",
    "fpdf", "tcpdf", "weasyprint", "pdfbox", "aspose", "pdftron",
    "chrome", "chromium", "puppeteer", "selenium", "phantomjs",
    "openpdf", "mpdf", "htmldoc", "princexml",
    "nitro", "foxit", "pdf24", "pdfescape", "smallpdf",
    "microsoft word", "microsoft excel", "microsoft powerpoint",
    "libreoffice", "openoffice", "indesign", "quarkxpress", "scribus",
    "pdfcreator", "bullzip", "cutepdf", "primopdf",
    "acrobat distiller", "acrobat pdfmaker",
]

# Producer keywords of scanners and multi-function devices.
SCANNER_PRODUCERS = [
    "hp", "canon", "epson", "xerox", "ricoh", "konica", "kyocera",
    "brother", "lexmark", "samsung", "sharp", "toshiba", "fujitsu",
    "scansnap", "paperport", "nuance",
    "mfp", "laserjet", "imagerunner", "ecosys", "bizhub",
    "workcentre", "documentcentre", "aficio",
]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def number(c: Column, kind: str = "int") -> Column:
    """Number of a text of digits. An empty text is no number; it is set aside first, since a failed cast is costly."""
    return F.nullif(c, F.lit("")).try_cast(kind)


def pad_station(c: Column) -> Column:
    """Six-digit station id; longer input is invalid, never truncated."""
    s = strip(c.cast("string"))
    return F.when((F.length(s) <= 6) & (F.length(s) > 0), F.lpad(s, 6, "0"))


def fixed1(c: Column) -> Column:
    """Text with one decimal, rounded half-up before formatting."""
    return F.format_string("%.1f", F.round(c, 1))


def fixed2(c: Column) -> Column:
    return F.format_string("%.2f", F.round(c, 2))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Dictionary lookup that falls back to the key itself."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def status_label(c: Column) -> Column:
    return lookup(c, STATUS_LABELS)


def category_label(c: Column) -> Column:
    return lookup(c, CATEGORY_LABELS)


def repair_digits(c: Column) -> Column:
    """Number read from a noisy cell: look-alike letters become digits, >999 is unreadable."""
    s = F.translate(strip(c), "ΟОOIl", "00011")
    digits = F.regexp_replace(s, "[^0-9]", "")
    n = number(digits, "decimal(38,0)")
    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast("int"))
        .when(digits == "", F.lit(0))
        .when(n <= 999, n.cast("int"))
    )


def first_number(c: Column) -> Column:
    """First stand-alone number of one to three digits."""
    return number(F.regexp_extract(c, r"(?:^|[^\p{L}\p{N}_])([0-9]{1,3})(?:[^\p{L}\p{N}_]|$)", 1))


def progress_pct(done: Column, total: Column) -> Column:
    return F.round(100.0 * done / F.greatest(F.lit(1), total), 1)


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Remaining seconds at the observed rate; unknown before any progress."""
    rate = F.try_divide(done.cast("double"), elapsed)
    return F.when(rate > 0, F.round((total - done) / rate, 0).cast("long"))


def elapsed_seconds(started: Column, now: Column) -> Column:
    """Whole seconds since the start; unknown before it."""
    return F.bround((F.unix_micros(now) - F.unix_micros(started)) / F.lit(1e6), 0).cast("long")


def progress_rate(done: Column, elapsed: Column) -> Column:
    """Stations per second; unknown before any progress or second."""
    return F.when((done > 0) & (elapsed != 0), done / elapsed)


def running_eta(done: Column, total: Column, elapsed: Column, running: Column) -> Column:
    """Remaining seconds at the observed rate, only while the job runs."""
    rate = progress_rate(done, elapsed)
    return F.when(running & (rate > 0), F.bround((total - done) / rate, 0).cast("long"))


def page_cost(stations: Column, sheets_per_station: float = 4.2, pages_per_sheet: float = 1.0,
              usd_per_1000: float = 1.50) -> Column:
    pages = stations * F.lit(sheets_per_station) * F.lit(pages_per_sheet)
    return F.struct(
        F.round(pages, 0).cast("long").alias("pages"),
        (F.floor(pages * F.lit(usd_per_1000) / 1000.0 * 100 + 0.5) / 100).alias("usd"),
    )


def _any_of(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def producer_category(producer: Column, creator: Column) -> Column:
    """Software family behind a document, first matching keyword list wins."""
    text = F.concat(F.lower(F.coalesce(producer, F.lit(""))), F.lit(" "),
                    F.lower(F.coalesce(creator, F.lit(""))))
    return (
        F.when(_any_of(text, GENERATION_PRODUCERS), "generacion")
        .when(_any_of(text, SCANNER_PRODUCERS), "scanner")
        .when(text.contains("acrobat"), "acrobat")
        .when(strip(text) != "", "otro")
        .otherwise("desconocido")
    )


def score_normalized(score: Column) -> Column:
    return F.tanh(score)


def score_confidence(score: Column) -> Column:
    return F.when(F.abs(score) > 0.5, "alta").when(F.abs(score) > 0.2, "media").otherwise("baja")


def contest_name(name: Column, contest_id: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("Elección "), contest_id.cast("string")))
