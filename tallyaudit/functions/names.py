"""Party-name normalisation and matching."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import strip


def _ascii(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")


# Compatibility decompositions of the Latin letters, spaces and signs below U+2200.
_SINGLE = {chr(c): _ascii(chr(c)) for c in range(0xA0, 0x2200) if len(_ascii(chr(c))) == 1}
_MULTI = {chr(c): _ascii(chr(c)) for c in (*range(0xA0, 0x250), 0x2026, 0x2116, 0x2122)
          if len(_ascii(chr(c))) > 1}


def strip_marks(c: Column) -> Column:
    """Latin letters without diacritics; anything else outside ASCII is dropped."""
    plain = c
    for src, dst in _MULTI.items():
        plain = F.replace(plain, F.lit(src), F.lit(dst))
    plain = F.translate(plain, "".join(_SINGLE), "".join(_SINGLE.values()))
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(plain, r"[^\x00-\x7F]", ""))


def norm_name(c: Column) -> Column:
    return let(strip(F.upper(c)), strip_marks)


def words(c: Column, min_len: int = 4) -> Column:
    """Distinct words long enough to identify a party."""
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= min_len))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word sets, 0 when either is empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def name_match(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Both names already normalised."""
    return (a == b) | (jaccard(words(a), words(b)) >= threshold)


def ballot_array(parties: list[tuple[int, str]], min_len: int) -> Column:
    """The ballot as one literal array, so that matching needs no join at all."""
    return F.array(*[
        F.struct(
            F.lit(row).alias("row"), F.lit(name).alias("name"),
            F.array(*[F.lit(w) for w in dict.fromkeys(name.split()) if len(w) >= min_len])
            .cast("array<string>").alias("words"),
        )
        for row, name in parties if name
    ])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` as a variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def best_ballot_row(name: Column, row: Column, parties: list[tuple[int, str]],
                    min_score: float = 0.3) -> Column:
    """Official name by row number, else by word overlap, else the name as read."""
    official = F.create_map(*[F.lit(x) for r, p in parties if p for x in (r, p)])
    scored = let(words(F.upper(name), 3), lambda mine: F.transform(ballot_array(parties, 3), lambda p: F.struct(
        jaccard(mine, p["words"]).alias("score"), (-p["row"]).alias("rank"), p["name"].alias("name"))))
    best = F.array_max(F.filter(scored, lambda s: s["score"] > min_score))
    return F.coalesce(F.try_element_at(official, row), best["name"], name)


def keyword_hits(parties: list[tuple[int, str]], line: Column) -> Column:
    """All parties, in ballot order, whose long words occur in the line (see ``keyword_match``)."""
    def hit(party: str) -> Column:
        ws = [w for w in party.split() if len(w) >= 4]
        found = sum((line.contains(w).cast("int") for w in ws), F.lit(0))
        return F.when(found >= max(1, len(ws) // 2), party)

    long_words = dict.fromkeys(w for _, p in parties for w in p.split() if len(w) >= 4)
    hits = F.array_compact(F.array(*[hit(p) for _, p in parties if any(len(w) >= 4 for w in p.split())]))
    # Most lines hold no such word at all.
    return F.when(line.rlike("|".join(re.escape(w) for w in long_words)), hits).otherwise(F.array().cast("array<string>"))


def keyword_match(party: Column, line: Column) -> Column:
    """At least half (and at least one) of the party's long words occur in the line."""
    ws = F.filter(F.split(party, r"\s+"), lambda w: F.length(w) >= 4)
    hits = F.size(F.filter(ws, lambda w: line.contains(w)))
    return (F.size(ws) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(ws) / 2)))


def edit_similarity(a: Column, b: Column, above: float | None = None) -> Column:
    """1 - edit distance / longer length. With ``above``, pairs whose lengths alone rule out a score
    beyond it are not measured and score 0."""
    longest = F.greatest(F.length(a), F.length(b))
    score = F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest).otherwise(0.0)
    if above is None:
        return score
    return F.when(F.least(F.length(a), F.length(b)) > longest * above, score).otherwise(0.0)


def similarity_table(names: list[str]) -> Column:
    """Literal map from every name to its edit similarities with all of ``names``, in their order."""
    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    def scores(a: str) -> Column:
        return F.array(*[F.lit(1.0 - distance(a, b) / max(len(a), len(b))) for b in names])

    return F.create_map(*[c for a in dict.fromkeys(names) for c in (F.lit(a), scores(a))])


def best_edit_match(name: Column, parties: list[tuple[int, str]], min_score: float = 0.55) -> Column:
    """Official name with the highest edit similarity above the threshold."""
    scored = F.transform(ballot_array(parties, 3), lambda p: F.struct(
        edit_similarity(p["name"], name, min_score).alias("score"), (-p["row"]).alias("rank"),
        p["name"].alias("name")))
    return F.array_max(F.filter(scored, lambda s: s["score"] > min_score))["name"]
