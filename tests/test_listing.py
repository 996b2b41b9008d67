"""Pages are read from the parts that hold them."""

import pytest
from pyspark.sql import functions as F

from tallyaudit.operators import listing


def sheets(spark, n):
    return spark.range(n).select(
        F.col("id").alias("sheet_id"), F.lpad((F.col("id") * 37 % 101).cast("string"), 6, "0").alias("station"), (F.col("id") % 5).alias("contest_id"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 7 == 0).alias("report_flag"), (F.col("id") % 11 == 0).alias("any_alert"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28).cast("string"), 2, "0"))).alias("captured_text"))


@pytest.mark.parametrize("mode", ["mesa", "anomalia", "discrepancia", "fecha", "tipo"])
def test_pages_join_to_the_sorted_list(spark, tmp_path, mode):
    rows = sheets(spark, 523)
    listing.write_page_index(rows, str(tmp_path), mode, rows_per_part=60)
    pages = [listing.read_page(spark, str(tmp_path), i, 50).collect() for i in range(1, 12)]
    assert [r["sheet_id"] for p in pages for r in p] == [r["sheet_id"] for r in listing.sort_sheets(rows, mode).collect()]
    assert [len(p) for p in pages] == [50] * 10 + [23] and {(r["total"], r["pages"]) for p in pages for r in p} == {(523, 11)}
    assert listing.read_page(spark, str(tmp_path), 12, 50).collect() == []


def test_a_page_reads_few_parts(spark, tmp_path):
    listing.write_page_index(sheets(spark, 3000), str(tmp_path), "mesa", rows_per_part=100)
    assert len(spark.read.parquet(f"{tmp_path}/rows").inputFiles()) >= 25
    for number in (1, 75, 150):
        page = listing.read_page(spark, str(tmp_path), number, 20)
        assert page.count() == 20
        read = page.where("sheet_id >= 0").select(F.input_file_name()).distinct().count()
        assert read <= 2
        assert "page_part" in page._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1][:60]


@pytest.mark.parametrize("n", [0, 1])
def test_small_lists(spark, n):
    out = listing.page(sheets(spark, n), 1, 10).collect()
    assert len(out) == n and all((r["total"], r["pages"]) == (1, 1) for r in out)


def test_parts_of_a_long_list_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "MAX_PARTS", 12)
    rows = sheets(spark, 300)
    listing.write_page_index(rows, str(tmp_path), "mesa", rows_per_part=5)
    assert spark.read.parquet(f"{tmp_path}/parts").count() <= 12
    pages = [listing.read_page(spark, str(tmp_path), i, 70).collect() for i in range(1, 6)]
    assert [r["sheet_id"] for p in pages for r in p] == [r["sheet_id"] for r in listing.sort_sheets(rows, "mesa").collect()]


def test_trigrams_are_written_in_shares(spark, tmp_path, monkeypatch):
    """Rows of one key with different texts count every trigram once, whichever share they are in."""
    monkeypatch.setattr(listing, "ROWS_OF_A_SHARE", 40)
    rows = spark.range(200).select((F.col("id") % 90).alias("k"), F.concat(F.lit("ab"), (F.col("id") % 7).cast("string"), F.lit("cab")).alias("a"),
                                   F.when(F.col("id") % 3 > 0, F.lit("ABAB")).alias("b"))
    listing.write_gram_index(rows, str(tmp_path / "grams"), "k", ["a", "b"], 2)
    assert len(list(tmp_path.glob("grams/part=0/*.parquet"))) + len(list(tmp_path.glob("grams/part=1/*.parquet"))) > 4
    for pattern in ("ab3c", "BAB", "abab", "zzz", "3"):
        want = [tuple(r) for r in rows.collect() if pattern.lower() in r["a"].lower() or pattern.lower() in (r["b"] or "").lower()]
        assert sorted(map(str, (tuple(r) for r in listing.search_grams(rows, str(tmp_path / "grams"), "k", ["a", "b"], pattern, 2).collect()))) == sorted(map(str, want))


def test_the_list_is_computed_once(spark, tmp_path):
    """The index counts, samples and sorts a written copy of the list."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = sheets(spark, 400)
    listing.write_page_index(rows.mapInPandas(watched, rows.schema), str(tmp_path), "tipo", rows_per_part=50)
    assert seen.value == 400
    assert listing.read_page(spark, str(tmp_path), 1, 400).count() == 400


def test_sheets_of_the_list_are_dealt_in_bounded_parts(spark, tmp_path, monkeypatch):
    from tallyaudit.sources import tables

    spark.range(900).selectExpr(
        "id % 70 AS l_orderkey", "id % 9 AS l_suppkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber", "CAST(id % 50 AS DOUBLE) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(70).selectExpr(
        "id AS o_orderkey", "id % 12 AS o_custkey", "'1-URGENT' AS o_orderpriority", "'F' AS o_orderstatus", "DATE'2024-01-02' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    plain = sorted(map(tuple, tables.v_sheet(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(tables, "LINES_OF_A_PART", 100)
    dealt = tables.v_list_sheet(spark, str(tmp_path)).drop("pdf_path", "captured_text")
    assert tables.v_line(spark, str(tmp_path), dealt=True).rdd.getNumPartitions() == 9
    assert sorted(map(tuple, dealt.collect())) == plain and len(plain) == 70
