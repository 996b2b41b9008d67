"""Bucketed bases, daily bitmaps, trigram search, dot clusters and the written export."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallyaudit.operators import dashboard, forensics, history, listing
from tallyaudit.sources import sinks

SCHEMA = "k long, status string, url string, doc string"
RULES = {"url": "coalesce", "doc": "nonempty", "status": "overwrite"}


def test_bucketed_upsert_equals_the_grouped_one(spark):
    base = [(i, f"s{i}", None if i % 3 else f"u{i}", [None, "", "{}", f"d{i}"][i % 4]) for i in range(40)]
    new = [(i, [None, f"n{j}"][j % 2], [None, f"v{j}"][j // 2 % 2], [None, "", "{}", f"e{j}"][(i + j) % 4], j) for i in range(20, 60) for j in range(1 + i % 3)]
    b, n = spark.createDataFrame(base, SCHEMA), spark.createDataFrame(new, f"{SCHEMA}, seq int")
    table = history.write_bucketed(b, "bucketed_upsert_test", ["k"], 4)
    for rules in (RULES, {c: "keep" for c in ("url", "doc")}, {}):
        got = history.upsert_bucketed(table, n, ["k"], rules, "seq")
        want = history.upsert(b.withColumn("seq", F.lit(0)), n, ["k"], rules, "seq").drop("seq")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_bucketed_base_is_not_moved(spark):
    b = spark.createDataFrame([(i, "s", "u", "d") for i in range(100)], SCHEMA)
    table = history.write_bucketed(b, "bucketed_plan_test", ["k"], 4)
    new = spark.createDataFrame([(5, "x", None, None)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = history.upsert_bucketed(table, new, ["k"], RULES)._jdf.queryExecution().executedPlan().toString()
        latest = history.latest_per_key(table, ["k"], "status", "url")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in latest
    base_side = plan[: plan.index("Scan ExistingRDD")] if plan.index("bucketed_plan_test") < plan.index("Scan ExistingRDD") else plan
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "bucketed_plan_test" in x)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
    above = [x for x in lines[:at] if "Exchange" in x and len(x) - len(x.lstrip(" :+-*()0123456789")) < depth]
    assert not above and plan.count("Exchange") >= 1 and base_side


def test_merged_days_equal_the_full_count(spark):
    log = spark.createDataFrame([(i * 7919 % 100_003 - 500, f"2024-01-{1 + i % 9:02d}") for i in range(4000)] + [(None, "2024-01-01"), (5, None)], "id long, d string")
    days = dashboard.daily_bitmaps(log, "id", F.to_date("d"))
    known = log.where("id IS NOT NULL AND d IS NOT NULL")
    for chosen in (["2024-01-01"], ["2024-01-02", "2024-01-05"], [f"2024-01-{i:02d}" for i in range(1, 10)], ["2030-01-01"]):
        want = known.where(F.col("d").isin(chosen)).select("id").distinct().count()
        assert dashboard.merged_distinct(days.where(F.col("day").isin([F.to_date(F.lit(x)) for x in chosen]))).first()["n"] == want
    assert {str(r["day"]): r["n"] for r in dashboard.merged_distinct(days, ["day"]).collect()} == {
        r["d"]: r["n"] for r in known.groupBy("d").agg(F.count_distinct("id").alias("n")).collect()}


def test_search_equals_the_scan(spark, tmp_path):
    names = ["000123", "123000", "Ñuñoa Élite", "ab", "", None, "aaaa", "50% a_b", "Elección Presidencial"]
    rows = [(i, a, b) for i, (a, b) in enumerate(itertools.product(names, names))]
    df = spark.createDataFrame(rows, "sheet_id long, station string, contest string")
    listing.write_gram_index(df, f"{tmp_path}/grams", "sheet_id", ["station", "contest"], 4)
    patterns = {(n or "")[a : a + w] for n in names for w in range(1, 7) for a in range(0, max(1, len(n or "") - w + 1), 2)}
    patterns = sorted(p for p in patterns if p.strip() == p and p) + ["ÑUÑ", "zzz", "%", "a_b", "3001"]
    for p in patterns[:: max(1, len(patterns) // 24)] + ["ÑUÑ", "zzz", "a_b"]:
        got = {r["sheet_id"] for r in listing.search_grams(df, f"{tmp_path}/grams", "sheet_id", ["station", "contest"], p, 4).collect()}
        assert got == {i for i, a, b in rows if p.lower() in (a or "").lower() or p.lower() in (b or "").lower()}, p


def pixels(spark, dots):
    return spark.createDataFrame([(d, 1, y, x, 200, 200, 10) for d, y, x in dots] + [(9, 1, 0, 0, 0, 0, 0)], "doc_id long, page int, y long, x long, r int, g int, b int")


def clusters(dots):
    """Sizes and mean places of 8-connected clusters, by flood fill."""
    left, out = set(dots), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            d, y, x = todo.pop()
            seen.append((d, y, x))
            near = {(d, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append((seen[0][0], sum(s[2] for s in seen) // len(seen), sum(s[1] for s in seen) // len(seen), len(seen)))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_dot_clusters(spark, seed):
    import random
    rng = random.Random(seed)
    snake = [(2, 0, x) for x in range(60)] + [(2, y, 59) for y in range(40)]
    dots = list({(1, rng.randrange(30), rng.randrange(30)) for _ in range(200)}) + list(dict.fromkeys(snake)) + [(3, 1, 1), (3, 50, 50)]
    got = sorted((r["doc_id"], r["x"], r["y"], r["n"]) for r in forensics.yellow_dot_clusters(pixels(spark, dots)).collect())
    assert got == clusters([d for d in dots if d[0] != 3])


def test_a_dot_over_a_cell_edge_is_one(spark):
    dots = [(1, y, x) for y in (4, 5) for x in (4, 5)] + [(1, 40 + i, 40) for i in range(9)]
    assert forensics.yellow_dots(pixels(spark, dots)).count() > 2
    assert sorted(r["n"] for r in forensics.yellow_dot_clusters(pixels(spark, dots), cell=5).collect()) == [4, 9]


def test_written_export_reads_back(spark, tmp_path):
    row = dict(station="000001", contest_id=10, contest='Elección "A", B', state=None, has_pdf=True, has_reader=False, scanned=None, method="", has_report=True,
               report_flag=None, score_flag=True, score="0.1234", confidence=None, compare_status="ok", n_discrepancies=None, captured_text="")
    schema = ("station string, contest_id int, contest string, state string, has_pdf boolean, has_reader boolean, scanned boolean, method string, has_report boolean, "
              "report_flag boolean, score_flag boolean, score string, confidence string, compare_status string, n_discrepancies int, captured_text string")
    df = spark.createDataFrame([tuple(row.values())], schema)
    path = sinks.write_export(df, str(tmp_path), "2024-01-30")
    assert path.endswith("/resultados_actas_2024-01-30.csv")
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.columns == sinks.EXPORT_HEADER
    assert [tuple("" if v is None else v for v in r) for r in back.collect()] == [tuple(r) for r in sinks.export_sheet_list(df).collect()]
    text = spark.read.text(path).first()[0]
    assert text.startswith('"Mesa","ID Elección"')
