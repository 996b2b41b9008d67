"""Repair of recognised digit cells: printed guide digits are found per form and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Ink and confidence limits, minimum counts and shares.
FAINT_INK = 145
DARK_INK = 120
COLUMN_SHARE = 0.70
COLUMN_CONF = 0.85
MIN_UNITS = 3
MIN_PATTERN = 4
LOW_CONF = 0.7
MIN_VALUES = 6
DOMINANCE = 0.50
MAX_VALUE = 999

CELLS = ("d0", "d1", "d2")

#: Cells that one task groups, about.
CELLS_OF_A_PART = 500_000


def wide_cells(cells: DataFrame) -> DataFrame:
    """One row per (sheet, ballot row): three digits, confidences and ink levels.

    The cells are written and dealt out by form into parts of a bounded number of cells, as their narrow rows take many
    times their shuffled size in a task's hash tables. Whatever groups by form later finds its rows in one part.
    """
    cells = cut_lineage(cells.select("sheet_id", "row_idx", "pos", "digit", "conf", "min_ink"))
    cells = cells.repartition(max(1, -(-cells.count() // CELLS_OF_A_PART)), "sheet_id")

    def at(pos: int, col: str) -> Column:
        return F.max(F.when(F.col("pos") == pos, F.col(col)))

    return cells.groupBy("sheet_id", "row_idx").agg(
        *[at(p, "digit").alias(f"d{p}") for p in range(3)],
        *[F.coalesce(at(p, "conf"), F.lit(0.0)).alias(f"c{p}") for p in range(3)],
        *[F.coalesce(at(p, "min_ink"), F.lit(0.0)).alias(f"m{p}") for p in range(3)])


def template_counts(wide: DataFrame) -> DataFrame:
    """How often each candidate pattern occurs on a form, and on which row first."""
    d = [F.col(c) for c in CELLS]
    has = [c.isNotNull() for c in d]
    m = [F.col(f"m{p}") for p in range(3)]

    def cand(kind: str, pattern: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern")))

    text = [c.cast("string") for c in d]
    found = F.array_compact(F.array(
        cand("unit", text[2], ~has[0] & ~has[1] & has[2] & (m[2] > FAINT_INK)),
        *[cand(f"col{p}", text[p], has[p] & (F.col(f"c{p}") >= COLUMN_CONF)) for p in range(3)],
        cand("triple", F.concat_ws("-", *text), has[0] & has[1] & has[2] & (F.least(*m) > DARK_INK)),
        cand("d01", F.concat_ws("-", text[0], text[1]), has[0] & has[1] & ~has[2] & (F.least(m[0], m[1]) > DARK_INK)),
        cand("d12", F.concat_ws("-", text[1], text[2]), ~has[0] & has[1] & has[2] & (F.least(m[1], m[2]) > DARK_INK)),
        cand("rows", F.lit(""), F.lit(True)),
    ))
    return wide.select("sheet_id", "row_idx", F.inline(found)).groupBy("sheet_id", "kind", "pattern").agg(
        F.count("*").alias("n"), F.min("row_idx").alias("first_row"))


def templates(wide: DataFrame) -> DataFrame:
    """Accepted printed patterns, one row per form and kind (most frequent, earliest row on ties)."""
    counts = template_counts(wide)
    top = counts.groupBy("sheet_id", "kind").agg(
        F.max_by(F.struct("pattern", "n"), F.struct("n", (-F.col("first_row")).alias("r"))).alias("t"))
    sheet = top.groupBy("sheet_id").agg(
        F.max(F.when(F.col("kind") == "rows", F.col("t.n"))).alias("n_rows"),
        F.collect_list(F.struct("kind", "t.pattern", "t.n")).alias("all"))
    each = sheet.select("sheet_id", "n_rows", F.inline("all"))
    enough = (F.when(F.col("kind") == "unit", F.col("n") >= MIN_UNITS)
              .when(F.col("kind").startswith("col"), F.col("n") >= F.col("n_rows") * COLUMN_SHARE)
              .when(F.col("kind") == "rows", F.lit(False)).otherwise(F.col("n") >= MIN_PATTERN))
    return each.where(enough).select("sheet_id", "kind", "pattern", "n")


def printed_units(wide: DataFrame) -> DataFrame:
    return templates(wide).where("kind = 'unit'")


def printed_columns(wide: DataFrame) -> DataFrame:
    return templates(wide).where(F.col("kind").startswith("col"))


def printed_groups(wide: DataFrame) -> DataFrame:
    return templates(wide).where(F.col("kind").isin("triple", "d01", "d12"))


def _compose(d0: Column, d1: Column, d2: Column) -> Column:
    digits = F.concat_ws("", *[x.cast("string") for x in (d0, d1, d2)])
    n = digits.try_cast("int")
    return F.when(n <= MAX_VALUE, n)


def compose_plain(wide: DataFrame) -> DataFrame:
    """Value of three digits without any template (totals rows)."""
    return wide.select("sheet_id", "row_idx", _compose(*[F.col(c) for c in CELLS]).alias("value"))


def apply_templates(wide: DataFrame) -> DataFrame:
    """Remove printed digits in rule order A, G, B, C, D, E, F and compose the value with a note.

    Templates are one narrow row per form and are joined on the form, beside its rows. The digits of a
    row travel through the rules as the single element of an array, so every rule reads the state
    left by the one before it without repeating its expression.
    """
    kinds = ["unit", "col0", "col1", "col2", "triple", "d01", "d12"]
    flat = templates(wide).groupBy("sheet_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("pattern"))).alias(f"t_{k}") for k in kinds])
    df = wide.join(flat, "sheet_id", "left")
    m0, m1, m2 = F.col("m0"), F.col("m1"), F.col("m2")

    def joined(*cols: Column) -> Column:
        return F.concat_ws("-", *[c.cast("string") for c in cols])

    def rule(cond, cleared: tuple[str, ...], text):
        """``cond`` and ``text`` see the current state; on a hit the digits clear and the note changes."""
        def apply(s: Column) -> Column:
            hit = F.coalesce(cond(s), F.lit(False))
            digits = [F.when(~hit, s[c]).alias(c) if c in cleared else s[c].alias(c) for c in CELLS]
            return F.struct(*digits, F.when(hit, text(s)).otherwise(s["note"]).alias("note"))

        return apply

    def says(text: str):
        return lambda s: F.lit(text)

    def also(text: str):
        return lambda s: F.when(s["note"] != "", F.concat(s["note"], F.lit("+" + text))).otherwise(text)

    def has(s: Column, pattern: str) -> Column:
        """Which of the three digits are present, written like ``x.x``."""
        present = [s[c].isNotNull() if p == "x" else s[c].isNull() for c, p in zip(CELLS, pattern)]
        return present[0] & present[1] & present[2]

    rules = [
        rule(lambda s: has(s, "..x") & (s["d2"].cast("string") == F.col("t_unit")), ("d2",), says("tpl_D2")),
        rule(lambda s: s["d0"].cast("string") == F.col("t_col0"), ("d0",), says("tpl_col0")),
        rule(lambda s: s["d1"].cast("string") == F.col("t_col1"), ("d1",), also("tpl_col1")),
        rule(lambda s: s["d2"].cast("string") == F.col("t_col2"), ("d2",), also("tpl_col2")),
        rule(lambda s: has(s, ".x.") & (m1 > FAINT_INK), ("d1",), says("iso_D1")),
        rule(lambda s: has(s, "..x") & (F.col("c2") < LOW_CONF) & (m2 > FAINT_INK), ("d2",), says("low_D2")),
        rule(lambda s: has(s, "xxx") & (joined(s["d0"], s["d1"], s["d2"]) == F.col("t_triple"))
             & (F.least(m0, m1, m2) > DARK_INK), CELLS, says("tpl_triple")),
        rule(lambda s: has(s, "xx.") & (joined(s["d0"], s["d1"]) == F.col("t_d01")) & (F.least(m0, m1) > DARK_INK),
             ("d0", "d1"), says("tpl_D01")),
        rule(lambda s: has(s, ".xx") & (joined(s["d1"], s["d2"]) == F.col("t_d12")) & (F.least(m1, m2) > DARK_INK),
             ("d1", "d2"), says("tpl_D12")),
    ]
    state = F.array(F.struct(*CELLS, F.lit("").alias("note")))
    for r in rules:
        state = F.transform(state, r)
    return df.select("sheet_id", "row_idx", F.inline(state)).select(
        "sheet_id", "row_idx", _compose(*[F.col(c) for c in CELLS]).alias("value"), "note")


def drop_dominant(values: DataFrame) -> DataFrame:
    """With six or more positive values, one shared by half of them is a leftover print.

    A form has at most as many rows as the ballot, so its windows are small; all share one shuffle.
    """
    form, same = Window.partitionBy("sheet_id"), Window.partitionBy("sheet_id", "value")
    positive = F.col("value") > 0
    counted = values.withColumns({
        "_n": F.count(F.when(positive, 1)).over(same), "_first": F.min("row_idx").over(same),
        "_total": F.count(F.when(positive, 1)).over(form)})
    top = counted.withColumn("_top", F.max(F.when(positive, F.struct(
        F.col("_n"), (-F.col("_first")).alias("r"), F.col("value")))).over(form))
    hit = F.coalesce((F.col("_total") >= MIN_VALUES) & (F.col("_top._n") >= F.col("_total") * DOMINANCE)
                     & (F.col("value") == F.col("_top.value")), F.lit(False))
    return top.select("sheet_id", "row_idx", F.when(~hit, F.col("value")).alias("value"),
                      F.when(hit, F.concat_ws(" ", F.nullif(F.col("note"), F.lit("")), F.lit("sanity_dup")))
                      .otherwise(F.col("note")).alias("note"))
