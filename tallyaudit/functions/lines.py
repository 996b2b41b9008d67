"""Kind of one vote line under the rule sets the audit reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names the source comparison leaves out.
SPECIAL_NAMES = ["VOTOS NULOS", "VOTOS EN BLANCO", "VOTOS IMPUGNADOS", "NULOS", "EN BLANCO", "IMPUGNADOS"]

RULES = ("audit", "share", "exact", "plural")


def line_kind(code: Column, name: Column, rule: str = "audit") -> Column:
    """``party``, ``null``, ``blank`` or ``challenged``.

    audit  code 81-83 or NULO, code 80 or BLANCO, IMPUGN
    share  any special word, or a numeric code of 80 and above, is ``special``
    exact  only the exact special names are ``special``
    plural NULOS, BLANCO, IMPUGNADOS as substrings
    """
    text = F.upper(F.coalesce(name, F.lit("")))
    tag = F.coalesce(code.cast("string"), F.lit(""))
    if rule == "audit":
        return (
            F.when(tag.isin("81", "82", "83") | text.contains("NULO"), "null")
            .when((tag == "80") | text.contains("BLANCO"), "blank")
            .when(text.contains("IMPUGN"), "challenged")
            .otherwise("party")
        )
    if rule == "share":
        number = tag.try_cast("int")
        special = text.rlike("NULO|BLANCO|IMPUGN") | F.coalesce(number >= 80, F.lit(False))
        return F.when(special, "special").otherwise("party")
    if rule == "exact":
        return F.when(text.isin(*SPECIAL_NAMES), "special").otherwise("party")
    if rule == "plural":
        return (
            F.when(text.contains("NULOS"), "null")
            .when(text.contains("BLANCO"), "blank")
            .when(text.contains("IMPUGNADOS"), "challenged")
            .otherwise("party")
        )
    raise ValueError(f"unknown rule {rule!r}, expected one of {RULES}")
