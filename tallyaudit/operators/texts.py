"""Fields and votes from extracted texts.

A document is one row and stays one row: sections, lines and votes are arrays and maps inside it,
so extraction is a pure projection with no shuffle at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import best_ballot_row, edit_similarity, keyword_hits, let, similarity_table, strip_marks
from ..functions.text import is_scanned
from ..functions.values import number, strip
from ..sources.dims import BALLOT

# Field patterns, primary and alternate, case-insensitive.
FIELD_PATTERNS = {
    "station": [r"(?:MESA|N[°º.]?\s*(?:DE\s+)?(?:SUFRAGIO|MESA))[:\s.]*[NnºO°]*[:\s.]*(\d{5,6})",
                r"(\d{6})\s*[-–]\s*\d{2}\s*[-–]\s*[A-Z]"],
    "electors": [r"(?:TOTAL\s*(?:DE\s*)?)?ELECTORES?\s*H[ÁáAa]BILES?\s*[:\s|]+(\d+)",
                 r"ELECTORESHABILES\s*[|:]\s*(\d+)"],
    "voters": [r"(?:TOTAL\s*(?:DE\s*)?)?(?:CIUDADANOS\s*QUE\s*VOTARON|VOTANTES|ASISTENTES)\s*[:\s|]+(\d+)",
               r"VOTARON\s*[:\s|]*(\d+)"],
    "emitted": [r"TOTAL\s*(?:DE\s*)?VOTOS?\s*EMITIDOS?\s*[:\s→|]+(\d+)"],
    "valid": [r"VOTOS?\s*V[ÁáAa]LIDOS?\s*[:\s|]+(\d+)"],
    "nulls": [r"VOTOS?\s*(?:EN\s+)?NULOS?\s*[:\s|]+(\d+)"],
    "blanks": [r"(?:VOTOS?\s*(?:EN\s+)?)?BLANCO\s*[:\s|]+(\d+)"],
    "challenged": [r"VOTOS?\s*IMPUGNADOS?\s*[:\s|]+(\d+)"],
}
SIGNATURE_PATTERN = r"(?i)(?:FIRMA|RUBRICA|MIEMBRO|PRESIDENTE|SECRETARIO|ESCRUTADOR|PERSONERO)"
DNI_PATTERN = r"(?i)D\.?N\.?I\.?\s*[:\s]?\s*(\d{8})"
TIME_PATTERN = r"(?i)(?:HORA|las)\s*[:\s]*(\d{1,2})\s*[:h]\s*(\d{2})"
TABLE_ROW = r"^(\d{1,2})\s+(.{3,50}?)\s+(\d{1,3})$"
FULLTEXT_ROW = r"^(\d{1,2})\s+(.{3,55}?)\s+(\d{1,3})$"
PARTY_ROW = r"^(\d{1,2})\s+(.{3,})"

# Labels of the totals rows and the heading words that are never a party.
TOTAL_LABELS = ["VOTOS EN BLANCO", "VOTOS NULOS", "VOTOS IMPUGNADOS", "TOTAL EMITIDOS"]
HEADINGS = ["VOTOS EN BLANCO", "VOTOS NULOS", "VOTOS IMPUGNADOS", "TOTAL DE VOTOS", "ORGANIZACIONES",
            "MESA DE SUFRAGIO", "ACTA ELECTORAL", "ELECCIONES", "OBSERVACIONES", "FIRMA", "PERSONERO"]

MAX_ROW, MAX_VOTES, MAX_CELL = 38, 500, 999
NO_VOTES = "map<string,int>"


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def field(text: Column, name: str) -> Column:
    return F.coalesce(*[_extract(text, "(?i)" + p) for p in FIELD_PATTERNS[name]])


def extract_fields(docs: DataFrame) -> DataFrame:
    """Station and totals by pattern."""
    text = F.col("text")
    return docs.select("doc_id", F.lpad(field(text, "station"), 6, "0").alias("station"),
                       *[field(text, n).try_cast("long").alias(n) for n in FIELD_PATTERNS if n != "station"])


def extract_lists(docs: DataFrame) -> DataFrame:
    """Distinct signature words, document numbers and times."""
    text = F.col("text")
    hours = F.regexp_extract_all(text, F.lit(TIME_PATTERN), F.lit(1))
    mins = F.regexp_extract_all(text, F.lit(TIME_PATTERN), F.lit(2))
    return docs.select(
        "doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(SIGNATURE_PATTERN), F.lit(0))))
        .alias("signatures"),
        F.regexp_extract_all(text, F.lit(DNI_PATTERN), F.lit(1)).alias("ids"),
        F.zip_with(hours, mins, lambda h, m: F.concat(h, F.lit(":"), m)).alias("times"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def sections(text: Column) -> Column:
    """Array of (label, body) of the ``--- NAME ---`` zones; text before the first has no zone."""
    cut = F.split(F.concat(F.lit("\n"), text), r"\n(?=--- (?:[^\n]* )?---(?:\n|$))")
    parts = F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))
    named = F.transform(parts, lambda p: F.struct(
        F.btrim(F.substring_index(p, "\n", 1), F.lit("- ")).alias("label"),
        F.regexp_replace(p, r"^[^\n]*\n?", "").alias("body")))
    return F.filter(named, lambda s: s["label"] != "")


def section_body(zones: Column, label: str) -> Column:
    """Body of the last zone of that name."""
    return F.try_element_at(F.filter(zones, lambda s: s["label"] == label), F.lit(-1))["body"]


def text_sections(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode_outer(sections(F.col("text"))).alias("idx", "s")).where("idx IS NOT NULL").select(
        "doc_id", "idx", "s.label", "s.body", F.size(lines_of(F.col("s.body"))).alias("n_lines"))


def _empty() -> Column:
    return F.create_map().cast(NO_VOTES)


def _put(votes: Column, name: Column, value: Column) -> Column:
    """Add an entry unless its name is NULL or already present."""
    fresh = name.isNotNull() & ~F.coalesce(F.map_contains_key(votes, name), F.lit(False))
    return F.when(fresh, F.map_concat(votes, F.create_map(F.coalesce(name, F.lit("")), value)).cast(NO_VOTES)).otherwise(votes)


def _row_entry(line: Column, pattern: str) -> Column:
    """(name, votes) of a ``row name votes`` line; the name is NULL when the line is no such row."""
    parts = F.struct(
        number(F.regexp_extract(line, pattern, 1)).alias("row"),
        strip(F.regexp_extract(line, pattern, 2)).alias("name"),
        number(F.regexp_extract(line, pattern, 3)).alias("votes"))
    return let(parts, lambda p: F.struct(
        F.when(p["row"].between(1, MAX_ROW) & (p["votes"] <= MAX_VOTES), best_ballot_row(p["name"], p["row"], BALLOT))
        .alias("name"), p["votes"].alias("votes")))


def _matching(lines: Column, pattern: str) -> Column:
    """Trimmed lines that match; the fold below only runs over these."""
    return F.filter(F.transform(lines, strip), lambda x: x.rlike(pattern))


def _or_none(rows: Column, kind: str) -> Column:
    return F.coalesce(rows, F.array().cast(kind))


def fold_table(body: Column, start: Column, pattern: str = TABLE_ROW) -> Column:
    entries = F.transform(_matching(lines_of(body), pattern), lambda x: _row_entry(x, pattern))
    return F.aggregate(_or_none(entries, "array<struct<name:string,votes:int>>"), start,
                       lambda acc, e: _put(acc, e["name"], e["votes"]))


def fold_fulltext(body: Column, start: Column) -> Column:
    """Numbered rows plus lines that contain a party's words and end in a number.

    The scan is sequential by definition: a party already found no longer matches later lines. All
    text work happens per line beforehand; the fold only looks names up.
    """
    def facts(line: Column) -> Column:
        row = _row_entry(line, FULLTEXT_ROW)
        return let(row, lambda r: F.struct(
            r["name"].alias("name"), r["votes"].alias("votes"), number(F.regexp_extract(line, r"(\d{1,3})\s*$", 1)).alias("tail"),
            let(F.upper(line), lambda u: keyword_hits(BALLOT, u)).alias("hits")))

    def step(acc: Column, e: Column) -> Column:
        def second(votes: Column) -> Column:
            hit = F.get(F.filter(e["hits"], lambda h: ~F.map_contains_key(votes, h)), F.lit(0))
            return let(F.when(e["tail"] <= MAX_VOTES, hit), lambda h: _put(votes, h, e["tail"]))

        return let(_put(acc, e["name"], e["votes"]), second)

    rows = F.transform(_matching(lines_of(body), r"\d$"), facts)
    return F.aggregate(_or_none(rows, "array<struct<name:string,votes:int,tail:int,hits:array<string>>>"), start, step)


def fold_totals(text: Column, start: Column) -> Column:
    """Totals rows anywhere in the text; the first of each label wins."""
    def step(acc: Column, line: Column) -> Column:
        upper = F.upper(line)
        tail = number(F.regexp_extract(line, r"(\d{1,4})\s*$", 1))

        def open_label(label: str, cond: Column) -> Column:
            return cond & ~F.map_contains_key(acc, F.lit(label))

        label = (
            F.when(open_label("VOTOS EN BLANCO", upper.contains("BLANCO")), "VOTOS EN BLANCO")
            .when(open_label("VOTOS NULOS", upper.contains("NULO")), "VOTOS NULOS")
            .when(open_label("VOTOS IMPUGNADOS", upper.contains("IMPUGNAD")), "VOTOS IMPUGNADOS")
            .when(open_label("TOTAL EMITIDOS", upper.contains("EMITID") | upper.contains("TOTAL DE VOTOS")),
                  "TOTAL EMITIDOS"))
        return let(F.when(tail <= MAX_VOTES, label), lambda name: _put(acc, name, tail))

    rows = F.filter(F.transform(lines_of(text), strip),
                    lambda x: x.rlike(r"\d$") & F.upper(x).rlike("BLANCO|NULO|IMPUGNAD|EMITID|TOTAL DE VOTOS"))
    return F.aggregate(_or_none(rows, "array<string>"), start, step)


def digit_values(body: Column) -> Column:
    """Value per line of the digit column; empty, unreadable and too large lines keep their place."""
    def value(line: Column) -> Column:
        n = number(F.regexp_replace(line, "[^0-9]", ""), "decimal(38,0)")
        return let(n, lambda v: F.when(v <= MAX_CELL, v.cast("int")))

    return F.transform(lines_of(body), value)


def party_rows(body: Column) -> Column:
    """(row, name) of the numbered lines of the name column."""
    rows = F.transform(_matching(lines_of(body), PARTY_ROW), lambda x: F.struct(
        number(F.regexp_extract(x, PARTY_ROW, 1)).alias("row"),
        strip(F.regexp_extract(x, PARTY_ROW, 2)).alias("name")))
    return F.filter(rows, lambda r: r["row"].between(1, MAX_ROW))


def fold_positional(digits: Column, names: Column) -> Column:
    """Line i of the digit column belongs to ballot row i; a later line replaces an equal name."""
    official = F.create_map(*[F.lit(x) for r, p in BALLOT if p for x in (r, p)])
    cells = F.transform(_or_none(digits, "array<int>"), lambda v, i: F.struct((i + 1).alias("row"), v.alias("v")))
    filled = F.filter(cells, lambda c: F.coalesce(c["v"], F.lit(0)) != 0)

    def named(read: Column) -> Column:
        def entry(c: Column) -> Column:
            seen = F.get(F.filter(read, lambda r: r["row"] == c["row"]), F.lit(0))["name"]
            name = F.coalesce(F.nullif(seen, F.lit("")), F.try_element_at(official, c["row"]),
                              F.concat(F.lit("PARTIDO FILA "), c["row"].cast("string")))
            return F.struct(F.upper(name).alias("name"), c["v"].alias("v"))

        return F.transform(filled, entry)

    def step(acc: Column, e: Column) -> Column:
        rest = F.map_filter(acc, lambda k, _: k != e["name"])
        return F.map_concat(rest, F.create_map(e["name"], e["v"])).cast(NO_VOTES)

    return F.aggregate(let(_or_none(names, "array<struct<row:int,name:string>>"), named), _empty(), step)


def _explode_votes(docs: DataFrame, votes: str = "votes") -> DataFrame:
    # The outer form keeps the optimizer from repeating the whole fold in an inferred ``size > 0`` filter.
    return docs.select("doc_id", F.explode_outer(votes).alias("party", "votes")).where("party IS NOT NULL")


def table_votes(docs: DataFrame) -> DataFrame:
    """Votes of the table zone."""
    body = section_body(sections(F.col("text")), "TABLA DE PARTIDOS")
    return _explode_votes(docs.withColumn("body", body).withColumn("votes", fold_table(F.col("body"), _empty())))


def fulltext_votes(docs: DataFrame) -> DataFrame:
    """Votes of the whole text."""
    return _explode_votes(docs.withColumn("votes", fold_fulltext(F.col("text"), _empty())))


def special_totals(docs: DataFrame) -> DataFrame:
    return _explode_votes(docs.withColumn("votes", fold_totals(F.col("text"), _empty()))).withColumnRenamed(
        "party", "label")


def positional_votes(docs: DataFrame) -> DataFrame:
    """Votes of the digit zone, named by the name zone or the ballot."""
    z = docs.withColumn("z", sections(F.col("text"))).withColumn(
        "digits", digit_values(section_body(F.col("z"), "COLUMNA VOTOS (DIGITOS)"))).withColumn(
        "names", party_rows(section_body(F.col("z"), "COLUMNA PARTIDOS")))
    return _explode_votes(z.withColumn("votes", fold_positional(F.col("digits"), F.col("names"))))


def party_name_lines(docs: DataFrame) -> DataFrame:
    body = section_body(sections(F.col("text")), "COLUMNA PARTIDOS")
    return docs.select("doc_id", F.posexplode_outer(party_rows(body)).alias("idx", "r")).where("idx IS NOT NULL").select(
        "doc_id", "idx", "r.row", "r.name")


def _pairs(text: Column) -> Column:
    """(pos, line, next) of the non-empty lines, trimmed."""
    lines = F.transform(lines_of(text), strip)
    following = F.concat(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
                         F.array(F.lit(None).cast("string")))
    zipped = F.zip_with(lines, following, lambda a, b: F.struct(
        a.alias("line"), F.when(b.rlike("^[0-9]{1,4}$"), b.try_cast("int")).alias("next")))
    placed = F.transform(zipped, lambda p, i: F.struct(i.alias("pos"), p["line"].alias("line"), p["next"].alias("next")))
    return F.filter(placed, lambda p: p["line"] != "")


def label_value_pairs(docs: DataFrame) -> DataFrame:
    """Totals printed as a label line followed by a number line; the last occurrence wins."""
    def label(p: Column) -> Column:
        u = F.upper(p["line"])
        return (F.when(u.contains("VOTOS EN BLANCO"), "blanks").when(u.contains("VOTOS NULOS"), "nulls")
                .when(u.contains("VOTOS IMPUGNADOS"), "challenged")
                .when(u.contains("TOTAL DE VOTOS EMITIDOS"), "emitted")
                .when(u.contains("CIUDADANOS QUE VOTARON"), "voters"))

    numbered = docs.select("doc_id", F.filter(_pairs(F.col("text")), lambda p: p["next"].isNotNull()).alias("p"))
    tagged = numbered.select("doc_id", F.transform("p", lambda p: F.struct(
        label(p).alias("label"), p["next"].alias("v"))).alias("p"))

    def last(name: str) -> Column:
        return F.try_element_at(F.filter("p", lambda p: p["label"] == name), F.lit(-1))["v"]

    return tagged.select("doc_id", *[last(n).alias(n) for n in ("blanks", "nulls", "challenged", "emitted", "voters")])


def _party_candidates(text: Column) -> Column:
    """Lines that may hold a party name, normalised, with the number on the line after."""
    norm = F.transform(_pairs(text), lambda p: F.struct(
        p["pos"].alias("pos"), strip(F.upper(strip_marks(p["line"]))).alias("line"), p["next"].alias("next"),
        p["line"].rlike("^[0-9]{1,4}$").alias("number")))
    return F.filter(norm, lambda p: ~p["number"] & (F.length(p["line"]) >= 4)
                    & ~p["line"].rlike("|".join(HEADINGS)))


def party_next_line_votes(docs: DataFrame, min_score: float = 0.55) -> DataFrame:
    """Each ballot party's most similar line by edit similarity, and the number printed below it.

    Lines without a number below matter only where one with a number is similar enough, since they may still be more
    similar. A line that reads as a ballot name has the similarities of that name, which are known beforehand.
    """
    parties = [p for _, p in BALLOT if p]
    known = similarity_table(parties)
    base = docs.select("doc_id", F.transform(_party_candidates(F.col("text")), lambda x: F.struct(
        x["pos"].alias("pos"), x["line"].alias("line"), x["next"].alias("next"),
        F.try_element_at(known, x["line"]).alias("known"))).alias("lines"))

    def measured(lines: Column, p: Column, i: Column) -> Column:
        return F.transform(lines, lambda x: F.struct(
            F.coalesce(F.get(x["known"], i), edit_similarity(p, x["line"], min_score)).alias("score"),
            (-x["pos"]).alias("rank"), x["next"].alias("next")))

    def best_of(numbered: Column, bare: Column) -> Column:
        return F.transform(F.array(*[F.lit(p) for p in parties]), lambda p, i: F.struct(p.alias("party"), let(
            F.array_max(measured(numbered, p, i)), lambda b: F.when(
                b["score"] > min_score, F.array_max(F.concat(F.array(b), measured(bare, p, i))))).alias("b")))

    best = let(F.col("lines"), lambda lines: let(F.filter(lines, lambda x: x["next"].isNotNull()), lambda numbered: F.when(
        F.size(numbered) > 0, best_of(numbered, F.filter(lines, lambda x: x["next"].isNull())))))
    rows = base.select("doc_id", F.explode_outer(best).alias("r")).select(
        "doc_id", "r.party", F.col("r.b.score").alias("score"), F.col("r.b.next").alias("votes"))
    return rows.where((F.col("score") > min_score) & F.col("votes").isNotNull()).select("doc_id", "party", "votes")


def merge_votes(docs: DataFrame) -> DataFrame:
    """Votes of a zoned text by precedence: digits, table, full text below five parties, plain text,
    totals. A later source never overwrites an earlier one."""
    z = docs.select("doc_id", "text", sections(F.col("text")).alias("z"))
    step1 = z.withColumn("v1", fold_positional(
        digit_values(section_body(F.col("z"), "COLUMNA VOTOS (DIGITOS)")),
        party_rows(section_body(F.col("z"), "COLUMNA PARTIDOS"))))
    step2 = step1.withColumn("v2", fold_table(section_body(F.col("z"), "TABLA DE PARTIDOS"), F.col("v1")))
    body = (F.when(F.size("z") == 0, F.col("text"))
            .when(F.size("v2") < 5, section_body(F.col("z"), "PAGINA COMPLETA")))
    step3 = step2.withColumn("v3", fold_fulltext(body, F.col("v2")))
    return _explode_votes(step3.withColumn("votes", fold_totals(F.col("text"), F.col("v3"))))


def extract_votes(docs: DataFrame) -> DataFrame:
    """Digital texts (100 characters and more) by line pairs, scanned ones by zones."""
    digital = docs.where(~is_scanned(F.col("text")))
    pairs = label_value_pairs(digital)
    totals = pairs.select("doc_id", F.inline(F.array(
        *[F.struct(F.lit(label).alias("party"), F.col(c).alias("votes"))
          for label, c in zip(TOTAL_LABELS, ("blanks", "nulls", "challenged", "emitted"))]))).where("votes IS NOT NULL")
    return (party_next_line_votes(digital).unionByName(totals).withColumn("kind", F.lit("digital"))
            .unionByName(merge_votes(docs.where(is_scanned(F.col("text")))).withColumn("kind", F.lit("scanned"))))


def extract_vote_table(votes: DataFrame) -> DataFrame:
    """Vote table of each extract (doc_id, party, votes): special rows flagged, party sum."""
    from pyspark.sql import Window

    special = F.col("party").startswith("VOTOS") | F.col("party").startswith("TOTAL")
    w = Window.partitionBy("doc_id")
    return votes.withColumn("special", special).withColumn(
        "party_sum", F.sum(F.when(F.col("special"), 0).otherwise(F.col("votes"))).over(w))
