"""Properties that hold whatever the data."""

import numpy as np
from pyspark.sql import functions as F

from tallyaudit.operators import compare, listing, model, ranking, sweep, turnout
from tallyaudit.sources import sheets, tables as t

from .conftest import SF


def test_histogram_counts_every_sheet(spark):
    s = t.v_sheet(spark, SF)
    assert turnout.turnout_histogram(s).agg(F.sum("n")).first()[0] == turnout.turnout(s).count()


def test_matched_and_unmatched_lines_are_all_lines(spark):
    lines, reader = t.v_line(spark, SF), t.v_reader(spark, SF)
    c = compare.compare_parties(lines, reader)
    only = compare.unmatched(lines, reader).where("source = 'official'").count()
    assert c.where("reader_name IS NOT NULL").count() + only == compare.official_parties(lines).count()


def test_first_matching_reader_line_wins(spark):
    lines = spark.createDataFrame([(1, "1", "FUERZA POPULAR", 5), (1, "2", "PARTIDO MORADO", 6)], "sheet_id LONG, code STRING, name STRING, votes LONG")
    reader = spark.createDataFrame([(1, 3, "FUERZA POPULAR AB", 9), (1, 2, "Fuerza Popular Extra", 7), (1, 5, "TOTAL EMITIDOS", 99), (1, 6, "OTRA COSA", 1)],
                                   "sheet_id LONG, pos INT, name STRING, votes LONG")
    got = {r.party: (r.reader_name, r["diff"]) for r in compare.compare_parties(lines, reader).collect()}
    assert got == {"FUERZA POPULAR": ("FUERZA POPULAR EXTRA", -2), "PARTIDO MORADO": (None, None)}
    extra = {r.name for r in compare.unmatched(lines, reader).where("source = 'reader'").collect()}
    assert extra == {"FUERZA POPULAR AB", "OTRA COSA"}


def test_filters_split_the_list(spark):
    s, r = t.v_list_sheet(spark, SF), t.v_result_log(spark, SF)
    p = t.v_report_log(spark, SF).withColumn("has_anomaly", F.lit(True))
    done = s.join(r.select("sheet_id").union(p.select("sheet_id")), "sheet_id", "left_semi").count()
    assert done + listing.filter_sheets(s, "sin_procesar", readers=r, reports=p).count() == s.count()


def test_ranking_score_is_the_sum_of_its_signals(spark):
    sig = ranking.suspicion_signals(t.v_sheet(spark, SF), t.v_line(spark, SF), sheets.state_times(t.v_timeline(spark, SF)))
    assert ranking.suspicion_ranking(sig, None).agg(F.sum("score")).first()[0] == sig.agg(F.sum("points")).first()[0]


def test_runs_do_not_depend_on_the_chunk(spark):
    s = t.v_sweep(spark, SF)
    a, b = sweep.empty_runs(s, 7), sweep.empty_runs(s, 100_000)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_one_class_share_and_planted_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(0, 1, len(model.FEATURES)))) for i in range(600)]
    rows += [(1000 + i, *([9.0 + i] * len(model.FEATURES))) for i in range(3)]
    f = spark.createDataFrame(rows, "sheet_id LONG, " + ", ".join(f"`{c}` DOUBLE" for c in model.FEATURES))
    m = model.fit_one_class(f, nu=0.05, epochs=15)
    scored = model.score(f, m)
    share = model.fit_summary(scored).first()
    assert 0.03 <= share.n_anomalies / share.n_samples <= 0.07
    lowest = [r.sheet_id for r in scored.orderBy("score").limit(30).collect()]
    assert {1000, 1001, 1002} <= set(lowest)


def test_dot_clusters_send_no_cells_through_the_driver(spark):
    from tallyaudit.operators import forensics

    pixels = spark.range(64).selectExpr("1L AS doc_id", "1 AS page", "id div 8 AS y", "id % 8 AS x", "200 AS r", "200 AS g", "CASE WHEN id % 8 = 3 THEN 90 ELSE 10 END AS b")
    out = forensics.yellow_dot_clusters(pixels)
    assert sorted((r.page_dots, r.x, r.y, r.n) for r in out.collect()) == [(56, 1, 3, 24), (56, 5, 3, 32)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
