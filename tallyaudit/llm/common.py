"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyaudit.session import cut_lineage

#: Word separators of every word rule here: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"

__all__ = ["SPACES", "WORD", "cut_lineage", "let", "per_text", "row_keyed", "table", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once per row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


_SQL = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}


def per_text(docs: DataFrame, carry: list[Column], text: Column, run: Callable[[list], tuple[list | None, list[list]]], added: dict[str, pa.DataType]) -> DataFrame:
    """The columns ``carry`` with those that ``run`` makes of a batch of texts, by Arrow.

    ``run`` returns the row number that each result belongs to (None: one result for each row, in order) and the ``added``
    columns. ``carry`` passes as it is, so ids keep every bit beside nulls.
    """
    kept = docs.select(*carry)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"`{c}` {_SQL[t]}" for c, t in added.items())])
    names = [*kept.columns, *added]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, columns = run(b.column(b.num_columns - 1).to_pylist())
            kept = [b.column(i) if at is None else b.column(i).take(pa.array(at, pa.int64())) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, added.values()))], names=names)

    return docs.select(*carry, text.alias("_text_of_the_row")).mapInArrow(each, fields)


def row_keyed(docs: DataFrame) -> DataFrame:
    """(_doc, _row): the columns of ``docs`` as one struct, and a key of each row that stays the same whenever it is read.

    Of a Parquet table the key is file and row number; anything else is written to the shared folder first.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        try:
            return docs.select(doc, key.alias("_row"))
        except AnalysisException:  # no Parquet
            pass
    return cut_lineage(docs.select(doc, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")).alias("_row")))
