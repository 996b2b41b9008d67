"""Official numbers against one or two readers.

Names are matched once per distinct spelling, through an inverted index of their long words, and
the resulting spelling map is joined to the lines. No pair of lines is ever formed inside a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import line_kind
from ..functions.names import norm_name, words
from ..functions.values import strip
from ..session import cut_lineage

# Compared totals and the rows a reader's vote map may carry besides parties.
TOTALS = [("Electores Hábiles", "eligible", "electors"), ("Total Votantes", "emitted", "voters"),
          ("Votos Válidos", "valid", "valid")]
READER_SPECIAL = ["TOTAL EMITIDOS", "VOTOS EN BLANCO", "VOTOS BLANCOS", "VOTOS NULOS",
                  "VOTOS IMPUGNADOS", "EN BLANCO", "NULOS", "IMPUGNADOS"]
ALERT_DIFF = 5


def _totals(sheets: DataFrame, *extracts: DataFrame) -> DataFrame:
    """Long totals: sheet_id, field, official, r1 [, r2]."""
    j = sheets.select("sheet_id", *[c for _, c, _ in TOTALS])
    for i, x in enumerate(extracts, 1):
        j = j.join(x.select("sheet_id", *[F.col(r).alias(f"_{r}{i}") for _, _, r in TOTALS]), "sheet_id", "left")
    rows = F.array(*[
        F.struct(F.lit(label).alias("field"), F.col(o).alias("official"),
                 *[F.col(f"_{r}{i}").alias(f"r{i}") for i in range(1, len(extracts) + 1)])
        for label, o, r in TOTALS])
    return j.select("sheet_id", F.inline(rows))


def compare_totals(sheets: DataFrame, extract: DataFrame) -> DataFrame:
    """Electors, voters and valid votes wherever both sources have a value."""
    t = _totals(sheets, extract).where(F.col("official").isNotNull() & F.col("r1").isNotNull())
    return t.select("sheet_id", "field", "official", F.col("r1").alias("reader"),
                    F.abs(F.col("official") - F.col("r1")).alias("abs_diff"),
                    (F.col("official") == F.col("r1")).alias("equal"))


def name_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b) for every pair of distinct normalised names that match.

    Names of n and m words match only if they share ``need`` words, so one of the first n - need + 1 words of one name,
    rarest first, is among the first m - need + 1 of the other. Only these words are joined, per pair of lengths: a
    word that most names carry comes last in each and meets no one, and no match is lost.
    """
    sides = [names.select("name", F.explode(words(F.col("name"))).alias("w")) for names in (left, right)]
    common = sides[0].union(sides[1]).groupBy("w").agg(F.count("*").alias("n"))

    def keyed(side: DataFrame, name: str, mine: str, other: str) -> DataFrame:
        ranked = side.join(common, "w").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("_r"))
        sized = ranked.select(F.col("name").alias(name), F.transform("_r", lambda x: x["w"]).alias(f"w{name}")).withColumn(
            mine, F.size(f"w{name}"))
        few, many = F.ceil(F.col(mine) * threshold - 1e-9), F.floor(F.col(mine) / threshold + 1e-9)
        partners = sized.withColumn(other, F.explode(F.sequence(few.cast("int"), many.cast("int"))))
        need = F.ceil((F.col(mine) + F.col(other)) * threshold / (1 + threshold) - 1e-9).cast("int")
        return partners.select(name, f"w{name}", mine, other, F.explode(F.slice(f"w{name}", F.lit(1), F.col(mine) - need + 1)).alias("w"))

    met = keyed(sides[0], "a", "na", "nb").join(keyed(sides[1], "b", "nb", "na"), ["w", "na", "nb"])
    shared = F.size(F.array_intersect("wa", "wb"))
    similar = met.where(shared / (F.col("na") + F.col("nb") - shared) >= threshold).select("a", "b")
    same = left.select(F.col("name").alias("a")).join(right.select(F.col("name").alias("b")), F.col("a") == F.col("b"))
    return similar.union(same).distinct()


def official_parties(lines: DataFrame) -> DataFrame:
    """One row per (sheet, normalised party); a repeated name keeps its last votes."""
    party = lines.where((line_kind(F.col("code"), F.col("name"), "exact") == "party") & F.col("votes").isNotNull())
    order = F.col("pos") if "pos" in lines.columns else F.col("code")
    return party.select("sheet_id", norm_name(F.col("name")).alias("party"), "votes", order.alias("p")).groupBy(
        "sheet_id", "party").agg(F.max_by("votes", "p").alias("votes"), F.min("p").alias("pos"))


def reader_parties(reader: DataFrame, compat: bool = False) -> DataFrame:
    """One row per (sheet, normalised reader name); special rows drop unless ``compat``."""
    kept = reader if compat else reader.where(
        ~strip(F.upper("name")).rlike("^(" + "|".join(READER_SPECIAL) + ")"))
    rows = kept.select("sheet_id", norm_name(F.col("name")).alias("reader_name"), "votes", F.col("pos").alias("p"))
    return rows.groupBy("sheet_id", "reader_name").agg(
        F.max_by("votes", "p").alias("votes"), F.min("p").alias("pos"))


def _spellings(lines: DataFrame) -> DataFrame:
    """Distinct normalised names, written once. Raw spellings are deduplicated before any text work."""
    raw = lines.select("name").distinct()
    return cut_lineage(raw.select(norm_name(F.col("name")).alias("name")).distinct())


def spelling_map(lines: DataFrame, reader: DataFrame) -> DataFrame:
    """(party, reader_name) of every pair of spellings that match; its measured size decides the join."""
    pairs = name_pairs(_spellings(lines), _spellings(reader))
    return cut_lineage(pairs.select(F.col("a").alias("party"), F.col("b").alias("reader_name")))


def _first_match(spellings: DataFrame, reader: DataFrame) -> DataFrame:
    """(sheet, party) with the first reader row whose name matches."""
    candidates = reader.join(spellings, "reader_name")
    return candidates.groupBy("sheet_id", "party").agg(
        F.min_by(F.struct("reader_name", "votes"), "pos").alias("m")
    ).select("sheet_id", "party", F.col("m.reader_name").alias("reader_name"), F.col("m.votes").alias("reader_votes"))


def compare_parties(lines: DataFrame, reader: DataFrame, compat: bool = False) -> DataFrame:
    """Every official party line with the reader line it matches, if any."""
    off, rd = official_parties(lines), reader_parties(reader, compat)
    j = off.join(_first_match(spelling_map(lines, reader), rd), ["sheet_id", "party"], "left")
    return j.select("sheet_id", "party", "reader_name", "votes", "reader_votes",
                    (F.col("votes") - F.col("reader_votes")).alias("diff"),
                    (F.col("votes") == F.col("reader_votes")).alias("equal"))


def unmatched(lines: DataFrame, reader: DataFrame, compat: bool = False) -> DataFrame:
    """Parties found in only one of the two sources."""
    compared = compare_parties(lines, reader, compat)
    only_official = compared.where("reader_name IS NULL").select(
        "sheet_id", F.lit("official").alias("source"), F.col("party").alias("name"), "votes")
    rd = reader_parties(reader, compat)
    only_reader = rd.join(compared.where("reader_name IS NOT NULL").select("sheet_id", "reader_name"),
                          ["sheet_id", "reader_name"], "left_anti").select(
        "sheet_id", F.lit("reader").alias("source"), F.col("reader_name").alias("name"), "votes")
    return only_official.unionByName(only_reader)


def compare_alerts(sheets: DataFrame, lines: DataFrame, extract: DataFrame, reader: DataFrame,
                   compat: bool = False) -> DataFrame:
    """One row per discrepancy with its alert level."""
    totals = compare_totals(sheets, extract).where("NOT equal").select(
        "sheet_id", F.col("field"), F.lit("alerta").alias("level"), "official", "reader")
    parties = compare_parties(lines, reader, compat).where("NOT equal").select(
        "sheet_id", F.concat(F.lit("Votos "), F.col("party")).alias("field"),
        F.when(F.abs("diff") > ALERT_DIFF, "alerta").otherwise("info").alias("level"),
        F.col("votes").alias("official"), F.col("reader_votes").alias("reader"))
    return totals.unionByName(parties)


def compare_status(sheets: DataFrame, lines: DataFrame, extract: DataFrame, reader: DataFrame,
                   compat: bool = False) -> DataFrame:
    """Roll-up of a sheet: ok, info or alerta, discrepancy count and both vote sums."""
    alerts = compare_alerts(sheets, lines, extract, reader, compat).groupBy("sheet_id").agg(
        F.count("*").alias("n_disc"), F.max(F.col("level") == "alerta").alias("has_alert"))
    off = official_parties(lines).groupBy("sheet_id").agg(F.sum("votes").alias("so"))
    rd = reader_parties(reader, compat).groupBy("sheet_id").agg(F.sum("votes").alias("sr"))
    zero = F.lit(0).cast("long")
    so, sr = F.coalesce("so", zero), F.coalesce("sr", zero)
    return sheets.select("sheet_id", "station", "contest_id").join(off, "sheet_id", "left").join(
        rd, "sheet_id", "left").join(alerts, "sheet_id", "left").select(
        "sheet_id", "station", "contest_id", so.alias("sum_official"), sr.alias("sum_reader"),
        F.abs(so - sr).alias("abs_diff"), F.coalesce("n_disc", zero).alias("n_discrepancies"),
        F.when(F.col("n_disc").isNull(), "ok").when(F.col("has_alert"), "alerta").otherwise("info").alias("status"))


def consensus_lines(lines: DataFrame, local: DataFrame, google: DataFrame) -> DataFrame:
    """Official parties with the votes each reader found."""
    off = official_parties(lines)
    m1 = _first_match(spelling_map(lines, local), reader_parties(local)).select(
        "sheet_id", "party", F.col("reader_name").alias("local_name"), F.col("reader_votes").alias("local"))
    m2 = _first_match(spelling_map(lines, google), reader_parties(google)).select(
        "sheet_id", "party", F.col("reader_name").alias("google_name"), F.col("reader_votes").alias("google"))
    return off.select("sheet_id", "party", F.col("votes").alias("official")).join(
        m1, ["sheet_id", "party"], "left").join(m2, ["sheet_id", "party"], "left")


def _consensus_rows(sheets: DataFrame, lines: DataFrame, x1: DataFrame, x2: DataFrame, local: DataFrame,
                    google: DataFrame) -> DataFrame:
    totals = _totals(sheets, x1, x2).where(F.col("official").isNotNull()).select(
        "sheet_id", F.lit("total").alias("section"), "field", "official",
        F.col("r1").alias("local"), F.col("r2").alias("google"))
    parties = consensus_lines(lines, local, google).select(
        "sheet_id", F.lit("party").alias("section"), F.col("party").alias("field"), "official", "local", "google")
    return totals.unionByName(parties)


def compare_consensus(sheets: DataFrame, lines: DataFrame, x1: DataFrame, x2: DataFrame, local: DataFrame,
                      google: DataFrame) -> DataFrame:
    """Every compared field; it agrees when either reader equals the official value."""
    rows = _consensus_rows(sheets, lines, x1, x2, local, google)
    same1 = F.coalesce(F.col("official") == F.col("local"), F.lit(False))
    same2 = F.coalesce(F.col("official") == F.col("google"), F.lit(False))
    none = F.col("local").isNull() & F.col("google").isNull()
    return rows.select("sheet_id", "section", "field", "official", "local", "google",
                       same1.alias("same_local"), same2.alias("same_google"), (same1 | same2).alias("agree"),
                       (~(same1 | same2) & ~((F.col("section") == "party") & none)).alias("alert"))


def consensus_status(consensus: DataFrame) -> DataFrame:
    """A sheet with any field without consensus is ``alerta`` even when no reader saw the field."""
    return consensus.groupBy("sheet_id").agg(
        F.count_if(~F.col("agree")).alias("n_discrepancies"), F.count_if("alert").alias("n_alerts"),
    ).withColumn("status", F.when(F.col("n_discrepancies") > 0, "alerta").otherwise("ok"))


def consensus_only_reader(lines: DataFrame, local: DataFrame, google: DataFrame) -> DataFrame:
    """Reader names neither matched nor official, once per sheet."""
    c = consensus_lines(lines, local, google)
    seen = reader_parties(local).select("sheet_id", "reader_name").union(
        reader_parties(google).select("sheet_id", "reader_name")).distinct()
    used = c.select("sheet_id", F.explode(F.array_compact(F.array("local_name", "google_name", "party")))
                    .alias("reader_name"))
    return seen.join(used, ["sheet_id", "reader_name"], "left_anti")


def _signed(c: Column) -> Column:
    return F.concat(F.when(c > 0, "+").otherwise(""), c.cast("string"))


def _special_totals(lines: DataFrame) -> DataFrame:
    """Null and blank votes as published on the sheet."""
    kind = line_kind(F.col("code"), F.col("name"), "plural")
    return lines.withColumn("_k", kind).groupBy("sheet_id").agg(
        F.max(F.when(F.col("_k") == "null", F.col("votes"))).alias("nulls"),
        F.max(F.when(F.col("_k") == "blank", F.col("votes"))).alias("blanks"))


def comparison_table(sheets: DataFrame, lines: DataFrame, x1: DataFrame, x2: DataFrame, local: DataFrame,
                     google: DataFrame) -> DataFrame:
    """Two-reader table: who agreed, per-reader deltas, count of parties without consensus."""
    rows = _consensus_rows(sheets, lines, x1, x2, local, google)
    null_long = F.lit(None).cast("long")
    special = _special_totals(lines).select("sheet_id", F.inline(F.array(
        F.struct(F.lit("total").alias("section"), F.lit("Votos Nulos").alias("field"), F.col("nulls").alias("official"),
                 null_long.alias("local"), null_long.alias("google")),
        F.struct(F.lit("total").alias("section"), F.lit("Votos en Blanco").alias("field"),
                 F.col("blanks").alias("official"), null_long.alias("local"), null_long.alias("google")),
    ))).where("official IS NOT NULL")
    o, a, b = F.col("official"), F.col("local"), F.col("google")
    same1, same2 = F.coalesce(o == a, F.lit(False)), F.coalesce(o == b, F.lit(False))
    delta = F.array_join(F.array_compact(F.array(
        F.when(a.isNotNull(), F.concat(F.lit("L:"), _signed(o - a))),
        F.when(b.isNotNull(), F.concat(F.lit("G:"), _signed(o - b))))), " ")
    state = (F.when(a.isNull() & b.isNull(), "⚠").when(same1 & same2, "✓ ambos").when(same1, "✓ local")
             .when(same2, "✓ google").otherwise(delta))
    out = rows.unionByName(special).withColumn("state", state)
    open_party = (F.col("section") == "party") & ~(same1 | same2)
    return out.withColumn("n_no_consensus", F.count_if(open_party).over(Window.partitionBy("sheet_id")))


def comparison_table_simple(lines: DataFrame, reader: DataFrame) -> DataFrame:
    """One-reader table with rows of either source: equal, one-sided or signed delta."""
    c = compare_parties(lines, reader).select(
        "sheet_id", F.col("party").alias("field"), F.col("votes").alias("official"),
        F.col("reader_votes").alias("reader"))
    extra = unmatched(lines, reader).where("source = 'reader'").select(
        "sheet_id", F.col("name").alias("field"), F.lit(None).cast("long").alias("official"),
        F.col("votes").alias("reader"))
    o, r = F.col("official"), F.col("reader")
    return c.unionByName(extra).withColumn(
        "state", F.when(o.isNull() | r.isNull(), "⚠").when(o == r, "✓").otherwise(_signed(o - r)))


def compare(mode: str, sheets: DataFrame, lines: DataFrame, extracts: list[DataFrame],
            readers: list[DataFrame]) -> DataFrame:
    """Sheet status under the configured mode: ``simple`` or two-reader consensus."""
    if mode in ("hibrido", "hibrido_ia"):
        return consensus_status(compare_consensus(sheets, lines, *extracts, *readers))
    return compare_status(sheets, lines, extracts[0], readers[0])
