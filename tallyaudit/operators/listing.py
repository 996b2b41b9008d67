"""The sheet list: filters, latest lookups, sorting, paging, badges, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder
from .history import reader_family

FILTERS = ("todos", "con_pdf", "con_ocr", "con_anomalia", "con_discrepancia", "sin_procesar")


def filter_sheets(sheets: DataFrame, kind: str = "todos", readers: DataFrame | None = None,
                  reports: DataFrame | None = None, compares: DataFrame | None = None,
                  scores: DataFrame | None = None, station_like: str = "", contest: str = "") -> DataFrame:
    """List filters as semi and anti joins on the sheet key; an invalid contest value is ignored."""
    out = sheets
    if station_like.strip():
        out = out.where(F.col("station").ilike(f"%{station_like.strip()}%"))
    if contest.strip().lstrip("-").isdigit():
        out = out.where(F.col("contest_id") == int(contest))
    if kind == "con_pdf":
        return out.where(F.coalesce("pdf_path", F.lit("")) != "")
    if kind == "con_ocr":
        return out.join(readers.select("sheet_id"), "sheet_id", "left_semi")
    if kind == "con_anomalia":
        flagged = reports.where("has_anomaly").select("sheet_id").union(
            scores.where("is_anomaly").select("sheet_id"))
        return out.join(flagged, "sheet_id", "left_semi")
    if kind == "con_discrepancia":
        return out.join(compares.where("status = 'alerta'").select("sheet_id"), "sheet_id", "left_semi")
    if kind == "sin_procesar":
        return out.join(readers.select("sheet_id").union(reports.select("sheet_id")), "sheet_id", "left_anti")
    return out


def sheet_list(sheets: DataFrame, readers: DataFrame, reports: DataFrame, compares: DataFrame,
               scores: DataFrame) -> DataFrame:
    """One row per sheet with the newest reader result, report, comparison and score.

    Every history table is read once and reduced to one row per sheet before it is joined.
    """
    family = reader_family(F.col("method"))
    order = F.struct("ts", "result_id")
    r = readers.groupBy("sheet_id").agg(
        F.max_by(F.struct("scanned", "method", "extract"), order).alias("r"),
        F.max_by("extract", F.when(family == "local", order)).alias("extract_local"),
        F.max_by("extract", F.when(family == "google", order)).alias("extract_google"),
    ).select("sheet_id", "r.*", "extract_local", "extract_google", F.lit(True).alias("has_reader"))
    p = reports.groupBy("sheet_id").agg(
        F.max_by(F.struct("has_anomaly", "alerts"), F.struct("ts", "report_id")).alias("p")
    ).select("sheet_id", F.col("p.has_anomaly").alias("report_flag"), F.col("p.alerts").alias("alerts"),
             F.lit(True).alias("has_report"))
    c = compares.groupBy("sheet_id").agg(
        F.max_by(F.struct("status", "n_discrepancies"), F.struct("ts", "compare_id")).alias("c"),
        F.coalesce(F.max(F.col("status") == "alerta"), F.lit(False)).alias("any_alert"),
    ).select("sheet_id", F.col("c.status").alias("compare_status"),
             F.col("c.n_discrepancies").alias("n_discrepancies"), "any_alert")
    s = scores.select("sheet_id", F.col("is_anomaly").alias("score_flag"), "score", "confidence")
    joined = sheets.join(r, "sheet_id", "left").join(p, "sheet_id", "left").join(c, "sheet_id", "left").join(
        s, "sheet_id", "left")
    return joined.withColumns({
        "has_reader": F.coalesce("has_reader", F.lit(False)),
        "has_report": F.coalesce("has_report", F.lit(False)),
        "any_alert": F.coalesce("any_alert", F.lit(False)),
    })


def sort_columns(mode: str) -> list[Column]:
    """Total order of each list mode."""
    station = [F.col("station").asc(), F.col("contest_id").asc(), F.col("sheet_id").asc()]
    if mode == "anomalia":
        return [F.coalesce(F.col("report_flag"), F.lit(False)).desc(), *station]
    if mode == "discrepancia":
        return [F.col("any_alert").desc(), *station]
    if mode == "fecha":
        return [F.coalesce(F.col("captured_text"), F.lit("0000-00-00")).desc(), *station]
    if mode == "tipo":
        return [F.col("contest_id").asc(), *station]
    return station


def sort_sheets(listing: DataFrame, mode: str = "mesa") -> DataFrame:
    return listing.orderBy(*sort_columns(mode))


#: Parts of a page index: fewer than this, or one per so many rows.
MAX_PARTS, ROWS_OF_A_PART = 256, 1_000_000


def write_page_index(listing: DataFrame, path: str, mode: str = "mesa", rows_per_part: int = 100_000) -> None:
    """Write the list in the order of ``mode`` for :func:`read_page`, as parts of consecutive rows.

    The list is range-partitioned by the sort key, every part sorted on its own; a row keeps its place in its part. A
    summary of one row per part holds how many rows the parts before it have, so any place in the order is found
    without sorting or passing over the rows ahead of it. Parts hold more than ``rows_per_part`` rows where there would be
    more than MAX_PARTS, since every part is a task and a sample of its bounds on the driver; of a large part a page
    reads the row groups that hold it, as places ascend in the file.
    """
    spark = listing.sparkSession
    # Counted, sampled and sorted from a table, so that its joins run, and broadcast, once.
    listing = cut_lineage(listing)
    n = listing.count()
    parts = max(1, min(-(-n // rows_per_part), MAX_PARTS), -(-n // ROWS_OF_A_PART))
    order = sort_columns(mode)
    # A sorted partition numbers its rows one after another in the lower 33 bits.
    number = F.monotonically_increasing_id()
    rows = listing.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "*", F.shiftright(number, 33).alias("page_part"), number.bitwiseAND((1 << 33) - 1).alias("page_place"))
    rows.write.partitionBy("page_part").parquet(f"{path}/rows")
    # A list without rows leaves no file that tells its columns.
    rows.where(F.lit(False)).write.parquet(f"{path}/columns")
    sizes = spark.read.schema(rows.schema).parquet(f"{path}/rows").groupBy("page_part").agg(F.count("*").alias("n"))
    # One row per part.
    before = Window.orderBy("page_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select(F.col("page_part").cast("long"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/parts")


def read_page(spark: SparkSession, path: str, number: int = 1, size: int = 100) -> DataFrame:
    """One page of a list written by :func:`write_page_index`, in order, with the total and the page count.

    Only the parts that hold the page are read.
    """
    # One row per part of a hundred thousand rows.
    parts = spark.read.parquet(f"{path}/parts").collect()
    total = sum(p["n"] for p in parts)
    first, last = (number - 1) * size, number * size
    held = {p["page_part"]: p["start"] for p in parts if p["start"] < last and p["start"] + p["n"] > first}
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows").where(F.col("page_part").isin(list(held)))
    start = F.create_map(*[F.lit(x) for kv in held.items() for x in kv])[F.col("page_part")] if held else F.lit(0)
    return (rows.withColumn("page_place", start + F.col("page_place")).where(F.col("page_place").between(first, last - 1)).orderBy("page_place")
            .drop("page_part", "page_place").withColumn("total", F.lit(total).cast("long"))
            .withColumn("pages", F.lit(max(1, -(-total // size))).cast("long")))


def page(listing: DataFrame, number: int = 1, size: int = 100, mode: str = "mesa") -> DataFrame:
    """One page plus the total and the page count; to read several pages, write the index once."""
    path = shared_folder(listing.sparkSession, "pages")
    write_page_index(listing, path, mode)
    return read_page(listing.sparkSession, path, number, size)


def row_badges(listing: DataFrame) -> DataFrame:
    """Badges of a list row."""
    anomaly = F.coalesce("report_flag", F.lit(False)) | F.coalesce("score_flag", F.lit(False))
    n_disc = F.coalesce("n_discrepancies", F.lit(0))
    known = F.col("report_flag").isNotNull() | F.col("score_flag").isNotNull()
    return listing.withColumns({
        "document_badge": F.when(~F.col("has_reader"), "Sin OCR").when(F.col("scanned"), "Escaneado")
        .otherwise("Digital"),
        "n_alerts": F.coalesce(F.size(F.filter("alerts", lambda a: a["nivel"] == "alerta")), F.lit(0)),
        "report_badge": F.when(~F.col("has_report"), "—").when(F.col("report_flag"), "alerta").otherwise("Normal"),
        "anomaly_badge": F.when(anomaly, "ANOMALÍA").when(known, "Normal").otherwise("—"),
        "discrepancy_count": n_disc,
        "row_class": F.when(anomaly, "row-anomaly").when(n_disc > 0, "row-warning").otherwise(""),
    })


def by_key(df: DataFrame, key: str, value, order: list[Column] | None = None) -> DataFrame:
    """Lookup of one key; the filter reaches the scan."""
    out = df.where(F.col(key) == value)
    return out.orderBy(*order) if order else out


def with_document(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Parsed JSON in place of a text column; a missing or empty text counts as an empty document."""
    text = F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit("{}"))
    return df.withColumn(col, F.from_json(text, schema))


def newest_first(df: DataFrame, ts: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(tie).asc())


def stations_by_status(results: DataFrame, status: str, n: int | None = None) -> DataFrame:
    out = results.where(F.col("status") == status.upper()).orderBy("station", "job_id")
    return out if n is None else out.limit(n)


def anomalies(scores: DataFrame, only_positive: bool = True, n: int | None = None, tie: str = "sheet_id") -> DataFrame:
    """Scores, lowest (most unusual) first."""
    out = scores.where("is_anomaly") if only_positive else scores
    out = out.orderBy(F.col("score").asc_nulls_first(), F.col(tie).asc())
    return out if n is None else out.limit(n)


def curated_status(sheets: DataFrame, curated: DataFrame) -> DataFrame:
    """Which curated stations have sheets, and how many. ``curated`` is a fixed short list."""
    stations = F.broadcast(curated.select("station"))
    counts = sheets.join(stations, "station", "left_semi").groupBy("station").agg(F.count("*").alias("n_sheets"))
    return curated.join(counts, "station", "left").withColumn(
        "n_sheets", F.coalesce("n_sheets", F.lit(0))).withColumn("has_sheets", F.col("n_sheets") > 0)


GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct runs of GRAM characters of the lower-cased text."""
    low = F.lower(text)
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: low.substr(i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


#: Rows whose trigrams one task sorts.
ROWS_OF_A_SHARE = 200_000


def write_gram_index(rows: DataFrame, path: str, key: str, cols: list[str], buckets: int = 64) -> None:
    """Postings of the trigrams of ``cols`` for :func:`search_grams`, laid out by a hash of the trigram.

    Of a trigram that very many rows hold, the postings are spread over its files like any other; a search reads the
    folders of its own trigrams only. The rows are dealt out in shares of a fixed size beforehand, so what a task sorts
    does not grow with the table.
    """
    narrow = cut_lineage(rows.select(key, *cols))
    shares = max(1, -(-narrow.count() // ROWS_OF_A_SHARE))
    rows = narrow.repartition(shares, F.xxhash64(key, *cols))
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.coalesce(F.col(c), F.lit(""))) for c in cols])))
    postings = rows.select(F.explode(grams).alias("gram"), F.col(key)).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    # Rows of one folder come from many tasks, so a frequent trigram is not one task's work.
    postings.sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(path)


def search_grams(rows: DataFrame, path: str, key: str, cols: list[str], pattern: str, buckets: int = 64) -> DataFrame:
    """Rows whose ``cols`` contain ``pattern`` in any case: those that hold all its trigrams, then checked.

    A pattern too short for a trigram is a scan.
    """
    text = pattern.strip()
    holds = F.lit(False)
    for c in cols:
        holds = holds | F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(text))), F.lit(False))
    spark = rows.sparkSession
    # The pattern's own trigrams: as many as it has characters, at most.
    asked = spark.range(1).select(F.explode(_grams(F.lit(text))).alias("gram")).select("gram", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("part")).collect()
    if not asked:
        return rows.where(holds)
    found = spark.read.schema(f"gram STRING, {key} {rows.schema[key].dataType.simpleString()}, part INT").parquet(path).where(
        F.col("part").isin([r["part"] for r in asked]) & F.col("gram").isin([r["gram"] for r in asked]))
    hits = found.groupBy(key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(asked)).select(key)
    return rows.join(hits, key, "left_semi").where(holds)
