"""Entity lists of a document reader, and merging of extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.names import let
from ..functions.values import first_number, repair_digits, strip

# Entity type to field, numeric fields, names that are not parties.
FIELD_OF = {
    "mesa_de_sufragio": "mesa",
    "mesa": "mesa",
    "total_electores_habiles": "electores_habiles",
    "electores_habiles": "electores_habiles",
    "total_ciudadanos_votaron": "total_votantes",
    "total_votantes": "total_votantes",
    "total_votos_emitidos": "votos_emitidos",
    "votos_emitidos": "votos_emitidos",
    "votos_en_blanco": "votos_blanco",
    "votos_blanco": "votos_blanco",
    "votos_blancos": "votos_blanco",
    "votos_nulos": "votos_nulos",
    "votos_impugnados": "votos_impugnados",
    "departamento": "departamento",
    "provincia": "provincia",
    "distrito": "distrito",
    "fecha_escrutinio": "fecha_escrutinio",
    "fecha_fin_escrutinio": "fecha_fin_escrutinio",
    "hora_inicio": "hora_inicio",
    "hora_inicio_escrutinio": "hora_inicio",
    "hora_fin_escrutinio": "hora_fin",
    "observaciones": "observaciones",
}
IGNORED = ["0.000"]
NUMERIC = ["electores_habiles", "total_votantes", "votos_emitidos", "votos_blanco", "votos_nulos", "votos_impugnados"]
NOT_PARTIES = ["TOTAL EMITIDOS", "TOTAL DE VOTOS EMITIDOS", "VOTOS EN BLANCO", "VOTOS BLANCOS", "EN BLANCO",
               "VOTOS NULOS", "NULOS", "VOTOS IMPUGNADOS", "IMPUGNADOS"]
PARTY_TYPES = ["voto", "organizacion_politica"]
PEOPLE_TYPES = ["miembro_mesa", "miembro_de_mesa", "personero"]


def parse_entities(docs: DataFrame) -> DataFrame:
    """``entities_json`` to an array column ``ents``."""
    return docs.withColumn("ents", F.from_json("entities_json", schema.ENTITIES)).drop("entities_json")


def _text(e: Column) -> Column:
    return strip(F.coalesce(F.nullif(e["normalizado"], F.lit("")), e["texto"], F.lit("")))


def entities_to_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, field, value): known types renamed, numbers repaired, the first value of a field wins.

    People entities keep dotted sub-fields; their own text is replaced by the last one read.
    """
    alias = F.create_map(*[F.lit(x) for kv in FIELD_OF.items() for x in kv])

    def item(key: Column, value: Column, replace: bool, use: Column) -> Column:
        return F.when(use, F.struct(key.alias("k"), value.alias("v"), F.lit(replace).alias("replace")))

    def subs(kind: Column, e: Column) -> Column:
        return F.transform(F.coalesce(e["sub_entidades"], F.array().cast(
            "array<struct<tipo:string,texto:string,conf:double>>")), lambda s: item(
            F.concat(kind, F.lit("."), F.coalesce(s["tipo"], F.lit(""))), strip(F.coalesce(s["texto"], F.lit(""))),
            False, strip(F.coalesce(s["texto"], F.lit(""))) != ""))

    def items(e: Column) -> Column:
        kind, text, std = e["kind"], e["text"], e["std"]
        value = F.when(std.isin(NUMERIC), repair_digits(text).cast("string")).otherwise(text)
        simple = F.concat(F.array(item(std, value, False, text != ""),
                                  item(kind, text, False, (text != "") & (kind != std))), subs(kind, e["e"]))
        people = F.concat(subs(kind, e["e"]), F.array(item(kind, text, True, text != "")))
        return F.when(kind.isin(PEOPLE_TYPES), people).otherwise(simple)

    def winner(all_items: Column, key: Column) -> Column:
        """The last item that replaces, else the first."""
        return let(F.filter(all_items, lambda it: it["k"] == key), lambda own: let(
            F.filter(own, lambda it: it["replace"]), lambda late: F.struct(key.alias("field"), F.when(
                F.size(late) > 0, F.try_element_at(late, F.lit(-1))["v"]).otherwise(F.get(own, F.lit(0))["v"]).alias("value"))))

    kinds = F.filter(F.transform("ents", lambda e: F.struct(
        strip(F.coalesce(e["tipo"], F.lit(""))).alias("kind"), e.alias("e"))), lambda s: ~s["kind"].isin(PARTY_TYPES + IGNORED))
    read = F.transform(kinds, lambda s: F.struct(
        s["kind"].alias("kind"), _text(s["e"]).alias("text"), F.coalesce(F.try_element_at(alias, s["kind"]), s["kind"]).alias("std"), s["e"].alias("e")))
    flat = F.array_compact(F.flatten(F.transform(read, items)))
    fields = let(flat, lambda found: F.transform(F.array_distinct(F.transform(found, lambda it: it["k"])), lambda key: winner(found, key)))
    # The outer form keeps the optimizer from repeating the rules in an inferred ``size > 0`` filter.
    return docs.select("doc_id", F.explode_outer(fields).alias("f")).where("f.field IS NOT NULL").select("doc_id", "f.field", "f.value")


def entities_to_votes(docs: DataFrame) -> DataFrame:
    """(doc_id, party, votes) of the party entities; an unread number is 0 and the last entry wins."""
    e = docs.select("doc_id", F.posexplode_outer("ents").alias("pos", "e")).where(
        strip(F.col("e.tipo")).isin(PARTY_TYPES))
    subs = F.coalesce(F.col("e.sub_entidades"), F.array().cast("array<struct<tipo:string,texto:string,conf:double>>"))
    text = _text(F.col("e"))

    def last_sub(*kinds: str) -> Column:
        return F.try_element_at(F.filter(subs, lambda s: strip(s["tipo"]).isin(*kinds)), F.lit(-1))["texto"]

    flat_name = F.when((F.size(subs) == 0) & (text != "") & (strip(F.col("e.tipo")) == "organizacion_politica"), text)
    party = F.coalesce(flat_name, strip(last_sub("organizacion_politica", "nombre")))
    votes = F.coalesce(repair_digits(strip(last_sub("total_votos"))), F.when(text != "", first_number(text)), F.lit(0))
    rows = e.select("doc_id", "pos", party.alias("party"), votes.alias("votes")).where(
        (F.coalesce("party", F.lit("")) != "") & ~F.upper("party").isin(NOT_PARTIES))
    return rows.groupBy("doc_id", "party").agg(F.max_by("votes", "pos").alias("votes"))


def derive_totals(extracts: DataFrame, votes: DataFrame) -> DataFrame:
    """Fill missing valid votes from a positive party sum and missing voters from emitted votes."""
    sums = votes.groupBy("doc_id").agg(F.sum("votes").alias("_s"))
    return extracts.join(sums, "doc_id", "left").withColumns({
        "valid": F.coalesce("valid", F.when(F.col("_s") > 0, F.col("_s"))),
        "voters": F.coalesce("voters", "emitted"),
    }).drop("_s")


def merge_extracts(first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """Field by field, the first extract wins and the second fills its gaps."""
    cols = [c for c in first.columns if c != key]
    a, b = first.alias("a"), second.alias("b")
    return a.join(b, key, "left").select(key, *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in cols])


def reader_quality(blocks: DataFrame) -> DataFrame:
    """Mean block confidence, tokens and pages per document."""
    return blocks.groupBy("doc_id").agg(
        F.round(F.avg("confidence"), 4).alias("confidence"), F.sum("tokens").alias("tokens"),
        F.count_distinct("page").alias("pages"), F.count("*").alias("blocks"))


VERDICT_PATTERN = r'(?is)\{[^{}]*"anomalia"[^{}]*\}'


def parse_verdict(text: Column) -> Column:
    """Verdict object inside a model answer; without one the raw text becomes a low-confidence note."""
    body = F.nullif(F.regexp_extract(text, VERDICT_PATTERN, 0), F.lit(""))
    doc = F.from_json(body, "anomalia STRING, confianza STRING, anotacion STRING, _bad STRING",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ok = body.isNotNull() & doc["_bad"].isNull()
    truthy = ~F.lower(F.coalesce(doc["anomalia"], F.lit("false"))).isin("false", "0", "", "null", "0.0", "[]")
    return F.struct(
        F.when(ok, truthy).alias("anomaly"),
        F.when(ok, F.lower(F.coalesce(doc["confianza"], F.lit("")))).otherwise("baja").alias("confidence"),
        F.when(ok, F.coalesce(doc["anotacion"], F.lit(""))).otherwise(text).alias("note"))
