"""Cells are grouped in parts of a bounded number of cells."""

from collections import Counter

from tallyaudit.operators import cells


def _digit(form, row, pos):
    return None if (form + row + pos) % 5 == 0 else 3 if pos == 0 and form % 4 == 0 else (form * 7 + row * 3 + pos) % 10


def long_cells(spark, forms=60):
    rows = [(form, row, pos, _digit(form or 0, row, pos), 0.9, 150.0)
            for form in [*range(forms - 1), None] for row in range(9) for pos in range(3)]
    return rows, spark.createDataFrame(rows, "sheet_id BIGINT, row_idx INT, pos INT, digit INT, conf DOUBLE, min_ink DOUBLE")


def test_parts_grow_with_the_cells_and_hold_whole_forms(spark, monkeypatch):
    rows, table = long_cells(spark)
    one = sorted(map(str, cells.templates(cells.wide_cells(table)).collect()))
    monkeypatch.setattr(cells, "CELLS_OF_A_PART", 100)
    wide = cells.wide_cells(table)
    assert wide.rdd.getNumPartitions() == -(-len(rows) // 100)
    want = {(f, r): tuple(_digit(f or 0, r, p) for p in range(3)) for f, r, _ in {x[:3] for x in rows}}
    assert {(r["sheet_id"], r["row_idx"]): (r["d0"], r["d1"], r["d2"]) for r in wide.collect()} == want
    found = cells.templates(wide)
    assert sorted(map(str, found.collect())) == one and one
    # Only the dealing moves rows: the plan has no exchange for the later groups.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan.split("== Initial Plan ==")[0]
    top = Counter(x[3] for x in rows if x[0] == 4 and x[2] == 0 and x[3] is not None).most_common(1)[0]
    assert [(r["pattern"], r["n"]) for r in found.where("sheet_id = 4 AND kind = 'col0'").collect()] == [(str(top[0]), top[1])]
