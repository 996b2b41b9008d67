"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule votes +1 (good), -1 (bad) or 0 (abstains) on a document from counts over its whole text. The votes of the
corpus are pre-aggregated into at most 3^8 vote patterns. Expectation-maximisation over that bounded table estimates
the prior of good documents and, per rule, how often it is right on good and on bad ones. A document's posterior
follows from its votes. Everything is DataFrame expressions; per round of EM only 17 sums reach the driver.

Edge cases: a null or empty text has no words and fails the base rule; a table without rows gives no rows and keeps
the starting accuracies; repeated rows are judged alike, each once; other columns pass through, and one that has the
name of a column added here is replaced by it.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, cut_lineage, let, words

SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of languages in Latin letters.
FUNCTION_WORDS = list(dict.fromkeys((
    "the of and to in is that for it with as was on are by "
    "de la le et les des en un une du que qui dans pour "
    "der die und das von zu mit den nicht ist im auf "
    "el los las y por con para una es se del al "
    "il che di non per sono della nel anche "
    "o os as um uma em com mais "
    "het een van niet dat voor zijn ook "
    "och att det som av inte till med er ikke og "
    "i w na z do nie to jest "
    "ve bir bu da ile için "
    "ja ei se on oli että "
    "a az és hogy nem si cu pe este "
    "yang dan di ini dengan"
).split()))
#: Scripts in which those words are written; a text mostly in others gets no vote on function words.
SCRIPT = r"\p{IsLatin}"

MIN_WORDS = 50
#: (rule, measure, good up to / from, bad from / up to); between the two limits the rule abstains.
LOW_IS_GOOD = (
    ("symbols", 0.02, 0.10),
    ("dup_lines", 0.05, 0.30),
    ("repeats", 0.12, 0.30),
    ("capitals", 0.15, 0.40),
)
HIGH_IS_GOOD = (
    ("function_words", 3.0, 1.0),
    ("letters", 0.75, 0.60),
    ("sentence_ends", 0.50, 0.10),
)
RULES = tuple(r[0] for r in LOW_IS_GOOD) + tuple(r[0] for r in HIGH_IS_GOOD) + ("word_length",)
#: Start of EM: share of good documents; how often a voting rule is right on a good document, and on a bad one.
START = (0.7, 0.99, 0.3)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the word list ``w``, the first occurrence included.

    Windows are compared by 64-bit hash. Sorted by (hash, position), equal windows are neighbours; the union of
    [p, p+2] over their positions p is summed in one pass.
    """
    def windows(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(a) - 3)
        return F.array_sort(F.transform(at, lambda i: F.struct(
            F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)).alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(p, start, lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    return F.when(F.size(w) < 6, _short_repeats(w)).otherwise(let(windows(w), lambda s: covered(positions(s))))


def _short_repeats(w: Column) -> Column:
    """Up to five words: windows at 0, 1 and 2 at most, compared directly."""
    def same(i: int, j: int) -> Column:
        pairs = [F.get(w, F.lit(i + k)) == F.get(w, F.lit(j + k)) for k in range(3)]
        return F.coalesce(pairs[0] & pairs[1] & pairs[2], F.lit(False))

    ab, bc, ac = same(0, 1), same(1, 2), same(0, 2)
    return F.when(ac | (ab & bc), 5).when(ab | bc, 4).otherwise(0)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five base counts and the measures of the rules, all over whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumn("_w", words(t)).withColumn("_lines", lines)
    w = F.col("_w")
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": let(w, repeat_words).cast("long"),
        "_n_lines": F.size("_lines"),
        "_ends": F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?:;…。！？][\"'”»)\]]*\s*$"))),
        "_letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")),
        "_capitals": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
        "_latin": F.length(F.regexp_replace(t, f"[^{SCRIPT}]+", "")),
        "_function": F.size(F.array_intersect(w, F.array(*map(F.lit, FUNCTION_WORDS)))),
    })
    return out.drop("_w", "_lines")


def votes() -> list[Column]:
    """One column of -1, 0 or 1 for each of RULES, from the measures of :func:`counts`."""
    def at_least_one(c: str) -> Column:
        return F.greatest(F.col(c), F.lit(1))

    n, chars, n_lines = at_least_one("n_words"), at_least_one("word_chars"), at_least_one("_n_lines")
    measure = {
        "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / n_lines,
        "repeats": F.col("n_repeat_words") / n,
        "capitals": F.col("_capitals") / at_least_one("_letters"),
        "function_words": F.when(2 * F.col("_latin") >= F.col("_letters"), F.col("_function").cast("double")),
        "letters": F.col("_letters") / chars,
        "sentence_ends": F.when(F.col("_n_lines") >= 3, F.col("_ends") / n_lines),
    }
    out = []
    for rule, good, bad in LOW_IS_GOOD:
        out.append(F.when(measure[rule] <= good, 1).when(measure[rule] >= bad, -1).otherwise(0))
    for rule, good, bad in HIGH_IS_GOOD:
        out.append(F.when(measure[rule] >= good, 1).when(measure[rule] < bad, -1).otherwise(0))
    mean = F.col("word_chars") / n
    out.append(F.when(mean.between(3, 9), 1).when((mean < 2) | (mean > 14), -1).otherwise(0))
    return [v.cast("byte").alias(f"_v{i}") for i, v in enumerate(out)]


def log_odds(prior: float, right_good: list[float], right_bad: list[float]) -> Column:
    """Log-odds that a document with votes _v0, _v1, ... is good."""
    total = F.lit(log(prior / (1 - prior)))
    for i, (a, b) in enumerate(zip(right_good, right_bad)):
        v = F.col(f"_v{i}")
        total = total + F.when(v == 1, log(a / (1 - b))).when(v == -1, log((1 - a) / b)).otherwise(0.0)
    return total


def fit(patterns: DataFrame, rounds: int = 15, strength: float = 0.02) -> tuple[float, list[float], list[float]]:
    """EM over vote patterns with their document counts ``n``: (prior of good, accuracy on good, accuracy on bad).

    It starts from START: a rule seldom condemns a good document, and each sort of bad document trips only some of the
    rules. The start also weighs as a prior worth ``strength`` of all documents, so a rule that hardly votes keeps its
    starting value and the labels cannot swap. The prior is relative: the fit is alike at every corpus size.
    """
    k = len(RULES)
    prior0, good0, bad0 = START
    prior, good, bad = prior0, [good0] * k, [bad0] * k
    for _ in range(rounds):
        p = (F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds(prior, good, bad)))).alias("p")
        e = patterns.select("*", p)
        w, u = F.col("n") * F.col("p"), F.col("n") * (F.lit(1.0) - F.col("p"))
        sums = [F.sum("n"), F.sum(w)]
        for i in range(k):
            v = F.col(f"_v{i}")
            sums += [F.sum(F.when(v == 1, w)), F.sum(F.when(v != 0, w)), F.sum(F.when(v == -1, u)), F.sum(F.when(v != 0, u))]
        n, n_good, *rest = [float(x or 0) for x in e.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        if not n:
            break
        c = strength * n
        prior = min(0.99, max(0.01, (n_good + prior0 * c) / (n + c)))
        for i in range(k):
            hit_g, all_g, hit_b, all_b = rest[4 * i : 4 * i + 4]
            good[i] = min(0.999, max(0.5, (hit_g + good0 * c) / (all_g + c)))
            bad[i] = min(0.99, max(0.02, (hit_b + bad0 * c) / (all_b + c)))
    return prior, good, bad


def assess(docs: DataFrame, text: str = "text", carry: list[str] | None = None, threshold: float = 0.2) -> DataFrame:
    """Documents with the five counts, ``base_failed``, ``p_good`` (posterior) and ``kept``.

    ``carry`` names the columns of ``docs`` that the result has besides (all, if None). ``base_failed``: fewer than 50
    words, or more than half of them in repeated 3-word windows. ``kept``: not base_failed, and p_good >= threshold
    (below a half: a lost clean document costs more than a kept poor one).
    The counts are computed once and written to the shared folder; EM and the verdict read that table.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*COUNTS, "base_failed", "p_good", "kept")]
    scored = counts(docs.select(F.struct(F.lit(None).alias("none"), *carry).alias("_doc"), F.col(text).alias("_t")), "_t")
    scored = cut_lineage(scored.select("_doc", *COUNTS, *votes()))
    names = [f"_v{i}" for i in range(len(RULES))]
    patterns = cut_lineage(scored.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))
    odds = log_odds(*fit(patterns))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return scored.select(*[F.col(f"_doc.`{c}`") for c in carry], *COUNTS, failed.alias("base_failed"), p.alias("p_good"), (~failed & (p >= threshold)).alias("kept"))
