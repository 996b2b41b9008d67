"""Table upkeep: upserts by key and latest-row lookups.

Parquet has no MERGE, so an upsert is one grouped pass over old and new rows. Every rule is a
``max_by``/``min_by`` that combines before the shuffle: a key with very many versions costs one
row per map task, not one huge group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

SHEET_RULES = {"api_json": "nonempty", "file_url": "coalesce", "pdf_path": "coalesce"}


def _merged(name: str, rule: str, order: Column) -> Column:
    c = F.col(name)
    last = F.max_by(c, order)
    if rule == "overwrite":
        return last
    if rule == "keep":
        return F.min_by(c, order)
    if rule == "coalesce":
        return F.max_by(c, F.when(c.isNotNull(), order))
    if rule == "nonempty":
        return F.coalesce(F.max_by(c, F.when(c.isNotNull() & ~c.isin("", "{}"), order)), last)
    raise ValueError(f"unknown merge rule {rule!r}")


def upsert(base: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str] | None = None,
           seq: str | None = None) -> DataFrame:
    """Apply ``new`` to ``base`` as if its rows arrived one by one in ``seq`` order.

    ``rules`` maps a column to overwrite (default), coalesce, nonempty or keep.
    """
    rules = rules or {}
    position = F.col(seq) if seq else F.lit(0)

    def tagged(df: DataFrame, source: int) -> DataFrame:
        return df.withColumn("_o", F.struct(F.lit(source).alias("s"), position.alias("p")))

    rows = tagged(base, 0).unionByName(tagged(new, 1))
    values = [c for c in base.columns if c not in keys]
    return rows.groupBy(*keys).agg(
        *[_merged(c, rules.get(c, "overwrite"), F.col("_o")).alias(c) for c in values])


def upsert_overwrite(base: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Stations, scores and snapshots: the newest row replaces the whole record."""
    return upsert(base, new, keys, seq=seq)


def upsert_single(base: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    """A table of one row, replaced as a whole by the newest."""
    return upsert(base.withColumn("id", F.lit(1)), new.withColumn("id", F.lit(1)), ["id"], seq=seq)


def upsert_coalesce(base: DataFrame, new: DataFrame, keys: list[str], keep_if_null: list[str],
                    keep_if_empty: list[str], seq: str | None = None) -> DataFrame:
    """Sheets: an empty document or a missing path never erases what is stored."""
    rules = {c: "coalesce" for c in keep_if_null} | {c: "nonempty" for c in keep_if_empty}
    return upsert(base, new, keys, rules, seq)


def upsert_partial(base: DataFrame, new: DataFrame, keys: list[str], cols: list[str],
                   seq: str | None = None) -> DataFrame:
    """Jobs: only ``cols`` follow the newest row, everything else keeps its first value."""
    rules = {c: "keep" for c in base.columns if c not in keys and c not in cols}
    return upsert(base, new, keys, rules, seq)


def with_sweep_flags(results: DataFrame) -> DataFrame:
    """Derived columns of a sweep result: sheets found, any document, sent to the jury."""
    return results.withColumns({
        "sheet_count": F.coalesce(F.size("sheets"), F.lit(0)),
        "has_pdf": F.coalesce(F.size("pdfs"), F.lit(0)) > 0,
        "is_jee": F.col("status") == "PARA_JEE",
    }).drop("sheets", "pdfs")


def upsert_sweep_results(base: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    return upsert(base, with_sweep_flags(new), ["job_id", "station"], seq=seq)


def with_has_alert(reports: DataFrame) -> DataFrame:
    """A report is anomalous when any alert is of level ``alerta``."""
    return reports.withColumn(
        "has_anomaly", F.coalesce(F.exists("alerts", lambda a: a["nivel"] == "alerta"), F.lit(False)))


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Newest row per key with a total order.

    ``row_number() = 1`` is limited inside every map task before the shuffle, so a hot key
    ships at most one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reader_family(method: Column) -> Column:
    """``google`` by prefix in any case, everything else and NULL is ``local``."""
    return F.when(method.ilike("google%"), "google").otherwise("local")


def latest_by_reader(df: DataFrame, family: str, keys: list[str], ts: str, tie: str,
                     method: str = "method") -> DataFrame:
    return latest_per_key(df.where(reader_family(F.col(method)) == family), keys, ts, tie)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int = 64, path: str | None = None) -> DataFrame:
    """Save ``df`` as a table bucketed and sorted by its keys, so later upserts and lookups need not move it."""
    path = path or shared_folder(df.sparkSession, name)
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def upsert_bucketed(base: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str] | None = None, seq: str | None = None) -> DataFrame:
    """:func:`upsert` for a large base that :func:`write_bucketed` has saved: only the new rows are moved.

    The new rows become one per key, with the last value of each column as its rule sees it, and meet the base in a
    merge join on the buckets of the base. The keys of the base are unique.
    """
    rules = rules or {}
    order = F.struct((F.col(seq) if seq else F.lit(0)).alias("p"))
    values = [c for c in base.columns if c not in keys]
    aggregates = []
    for c in values:
        rule = rules.get(c, "overwrite")
        aggregates.append(_merged(c, rule, order).alias(f"_new_{c}"))
        if rule == "nonempty":
            x = F.col(c)
            aggregates.append(F.max_by(x, F.when(x.isNotNull() & ~x.isin("", "{}"), order)).alias(f"_full_{c}"))
    fresh = new.groupBy(*keys).agg(*aggregates).withColumn("_is_new", F.lit(True))
    both = base.withColumn("_is_old", F.lit(True)).join(fresh, keys, "full")

    def value(c: str) -> Column:
        old, last = F.col(c), F.col(f"_new_{c}")
        rule = rules.get(c, "overwrite")
        if rule == "overwrite":
            return F.when(F.col("_is_new"), last).otherwise(old)
        if rule == "keep":
            return F.when(F.col("_is_old"), old).otherwise(last)
        if rule == "coalesce":
            return F.coalesce(last, old)
        full = F.when(~old.isin("", "{}"), old)
        return F.coalesce(f"_full_{c}", full, F.when(F.col("_is_new"), last).otherwise(old))

    return both.select(*keys, *[value(c).alias(c) for c in values])
