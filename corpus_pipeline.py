"""Training-data pipeline over ``documents``: each stage is one operator; its output is written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyaudit.llm import lines, mixing, near_dedup, packing, quality
from tallyaudit.llm.common import cut_lineage, row_keyed, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.assess(docs).where("kept").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; n_chars follows the text."""
    return lines.drop_templates(docs).selectExpr(*[f"length(text) AS n_chars" if c == "n_chars" else c for c in docs.columns]).to(docs.schema)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (word shingles, similarity 0.8 or more).

    Every row is a document of its own, whatever its id: of a group the row with the smallest id stays, rows without an
    id last. Rows without an id and rows that share one stay unless their text is a duplicate; rows without words all stay.
    """
    rows = row_keyed(docs)
    # The key leads with the id, so the smallest key of a group is the row that stays.
    key = F.struct(F.col("_doc.doc_id").isNull().alias("none"), F.col("_doc.doc_id").alias("id"), "_row")
    keyed = rows.select("_doc", key.alias("_key"))
    groups = near_dedup.near_duplicates(keyed.select("_key", "_doc.text"), id_col="_key", limit=80)
    kept = groups.where("kept").select(F.col("doc_id._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: rows of documents with the words taken, once per pass."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in windows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good), ("line_dedup", drop_lines), ("near_dedup", keep_one), ("mixing", mix), ("packing", pack),
]

#: The stages hash, draw and tokenise, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
