"""Line deduplication with a log-template tree of fixed depth.

A line descends by its number of tokens and its leading tokens to a leaf; tokens with a digit are variable fields from
the start. In a leaf, a token is constant at its position if it stands there in enough documents' lines, otherwise it
becomes a variable field. Lines with the same generalised form share a template; with too few constants left, a line
is its own template. A template that recurs in enough documents is boilerplate: its lines are dropped, but for those
of the document with the smallest id, so that no content disappears from the corpus.

The shorter a line, the more documents it takes: lines of fewer than ``min_tokens`` tokens lie in a leaf of all their
tokens, those of numbers alone with their digits, and each token that they lack asks for another ``min_docs``
documents. A long line that stands in two different texts recurs, but for its fields word for word.

Documents with the same text count once, so copies of a document are no evidence against its lines. A document of
which nearly all would go stays whole only where document deduplication is sure to take it: all that would go belongs to
one other document, which loses no line itself, and the two share ``similarity`` percent of their 5-word shingles,
counted on both full texts. Lines are told apart by leaf and hash together. Everything is hash aggregation
and equi-joins on distinct lines: no line pairs are formed, and a line that a third of all documents share is one row
after the first partial aggregate.

Edge cases: null and empty texts, and lines without a word, stay as they are; repeated rows are
treated alike and all stay; an empty table gives no rows; other columns pass through, and one that has the name of a
column added here is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, let, words

FIELD = "<*>"
ADDED = ("n_lines", "n_dropped")


def drop_templates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_docs: int = 3, min_tokens: int = 5,
                   depth: int = 3, constant: float = 0.7, copy_share: float = 0.8, similarity: int = 80, long_tokens: int = 20) -> DataFrame:
    """``docs`` with ``text`` freed of recurring templates, and the counts ``n_lines`` and ``n_dropped``.

    ``min_docs``: documents of different text that make a token constant and a template recurring. ``depth``: leading
    tokens of a leaf. ``constant``: least share of constant tokens in a generalised template. ``copy_share``: a
    document is compared with another in full if its recurring lines have it as their one owner and hold this share of
    the words of both together; ``similarity``: it stays whole from there on. ``min_tokens``: shorter lines ask for more documents. ``long_tokens``: tokens without a digit of a line for which two texts are enough.
    """
    text_lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_cls"), text_lines.alias("_lines"))
    # Every line is placed in the tree once; of the texts only the lines in shared leaves are read again.
    placed = cut_lineage(
        keyed.select("_id", "_cls", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", "_cls", "_pos", words(F.col("_line")).alias("_tokens"))
        .where((F.size("_tokens") > 0) | (F.col("_pos") == 0))  # a first line counts its row below
        .select("_id", "_cls", "_pos", F.size("_tokens").alias("_n"), _leaf(F.col("_tokens"), depth, min_tokens).alias("_leaf"))
    )
    # A leaf of a single document holds no recurring template; minimum and maximum tell, and combine before the shuffle.
    shared = placed.where("_n > 0").groupBy("_leaf").agg(F.min("_cls").alias("a"), F.max("_cls").alias("b")).where("a <> b").select("_leaf")
    spots = (
        placed.join(shared, "_leaf", "left_semi")
        .groupBy(F.col("_id").alias("_i"), F.col("_cls").alias("_c")).agg(F.collect_set(F.struct("_pos", "_leaf")).alias("_spots"))
    )
    held = cut_lineage(
        keyed.join(spots, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_cls") == F.col("_c")))
        .select("_id", "_cls", "_lines", F.explode("_spots").alias("_s"))
        .select("_id", "_cls", "_s.*", let(words(F.get("_lines", F.col("_s._pos"))), lambda t: _fields(t, min_tokens)).alias("_tokens"))
        .withColumn("_lid", F.xxhash64("_tokens"))
    )
    templates = _templates(held, min_docs, constant, min_tokens, long_tokens)
    gone = cut_lineage(
        held.select("_id", "_cls", "_pos", "_leaf", "_lid", F.size("_tokens").alias("_n"))
        .join(templates, ["_leaf", "_lid"]).where(F.col("_cls") != F.col("_owner"))
        .groupBy("_id", "_cls").agg(F.array_sort(F.collect_set(F.struct("_pos", "_n"))).alias("_gone"),
                                    F.min("_owner").alias("_owner"), F.max("_owner").alias("_last"))
    )
    words_of = cut_lineage(placed.groupBy("_cls").agg((F.sum("_n") / F.count_if(F.col("_pos") == 0)).alias("_all")))
    lost = F.aggregate("_gone", F.lit(0), lambda a, x: a + x["_n"])
    copies = (
        gone.where("_owner = _last").select("_id", "_cls", "_owner", lost.alias("_lost"))
        .join(words_of, "_cls").where(F.col("_lost") >= copy_share * F.col("_all"))
        .join(words_of.select(F.col("_cls").alias("_owner"), F.col("_all").alias("_theirs")), "_owner")
        .where(F.col("_lost") >= copy_share * (F.col("_all") + F.col("_theirs") - F.col("_lost")))
        .join(gone.select(F.col("_cls").alias("_owner")).distinct(), "_owner", "left_anti")
    )
    copies = _near(docs, text, cut_lineage(copies.select("_id", "_cls", "_owner")), similarity)
    gone = gone.join(copies, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_cls") == F.col("_c")), "left_anti")
    keep = [c for c in docs.columns if c not in ADDED]
    base = docs.select(F.struct(*keep).alias("_doc"), F.col(id_col).alias("_d"), F.xxhash64(text).alias("_k"))
    joined = base.join(gone, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_cls")), "left")
    whole, t = F.col("_gone").isNull(), F.col(f"_doc.{text}")
    all_lines = F.split(t, "\n")
    out = F.when(whole, t).otherwise(
        let(all_lines, lambda a: F.array_join(_without(a, F.transform("_gone", lambda x: x["_pos"])), "\n")))
    return joined.select(
        *[(out if c == text else F.col(f"_doc.`{c}`")).alias(c) for c in keep],
        F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(F.size("_gone")).cast("long").alias("n_dropped"))


def _near(docs: DataFrame, text: str, pairs: DataFrame, similarity: int) -> DataFrame:
    """(_i, _c) of the pairs (_id, _cls, _owner) whose texts share enough of their distinct 5-word shingles."""
    def shingles(w: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(w) - 4)
        return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, 5))))

    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = cut_lineage(pairs.select(F.col("_cls").alias("_k")).union(pairs.select("_owner")).distinct())
    sets = (
        docs.select(F.xxhash64(text).alias("_k"), lower.alias("_t")).join(asked, "_k", "left_semi").dropDuplicates(["_k"])
        .select("_k", let(words(F.col("_t")), shingles).alias("_s"))
    )
    both = F.size(F.array_intersect("_a", "_b"))
    return (
        pairs.join(sets.select(F.col("_k").alias("_cls"), F.col("_s").alias("_a")), "_cls").join(sets.select(F.col("_k").alias("_owner"), F.col("_s").alias("_b")), "_owner")
        .where(100 * both >= similarity * (F.size("_a") + F.size("_b") - both)).select(F.col("_id").alias("_i"), F.col("_cls").alias("_c")).distinct()
    )


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))


def _fields(tokens: Column, min_tokens: int) -> Column:
    """The tokens with fields for those with a digit; a short line of nothing else keeps them."""
    bare = (F.size(tokens) < min_tokens) & F.forall(tokens, lambda t: t.rlike("[0-9]"))
    return F.when(bare, tokens).otherwise(_masked(tokens))


def _leaf(tokens: Column, depth: int, min_tokens: int) -> Column:
    """The leaf of a line: token count and leading tokens, of a short line all tokens."""
    n = F.size(tokens)
    return F.when(n < min_tokens, F.xxhash64(n, _fields(tokens, min_tokens))).otherwise(F.xxhash64(n, _masked(F.slice(tokens, 1, depth))))


def _without(a: Column, gone: Column) -> Column:
    """Array ``a`` without the sorted 0-based positions ``gone``: the runs between them, in linear time."""
    def runs(g: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(g, lambda p: p + 1))
        ends = F.concat(g, F.array(F.size(a)))
        return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(a, s + 1, e - s)))

    return let(gone, runs)


def _templates(held: DataFrame, min_docs: int, constant: float, min_tokens: int, long_tokens: int) -> DataFrame:
    """(_leaf, _lid, _owner) of the distinct lines that belong to a recurring template."""
    line = ["_leaf", "_lid"]
    seen = cut_lineage(held.groupBy(*line, "_cls").agg(F.min("_id").alias("_id")))
    distinct = (
        held.groupBy(*line).agg(F.any_value("_tokens").alias("_tokens"))
        .join(seen.groupBy(*line).agg(F.count("*").alias("_n")), line)
    )
    tokens = cut_lineage(distinct.select(*line, "_n", F.posexplode("_tokens").alias("_at", "_token")))
    frequent = (
        tokens.where(F.col("_token") != FIELD).groupBy("_leaf", "_at", "_token").agg(F.sum("_n").alias("_docs"))
        .where(F.col("_docs") >= min_docs).select("_leaf", "_at", "_token", F.lit(1).alias("_const"))
    )
    part = F.xxhash64("_at", F.when(F.col("_const") == 1, F.col("_token")).otherwise(FIELD))
    forms = (
        tokens.join(frequent, ["_leaf", "_at", "_token"], "left")
        .groupBy(*line).agg(F.bit_xor(part).alias("_form"), F.sum("_const").alias("_c"), F.count("*").alias("_len"), F.count_if(F.col("_token") != FIELD).alias("_words"))
        .select(*line, "_len", "_words", F.when(F.col("_c") >= constant * F.col("_len"), F.xxhash64("_leaf", "_form")).otherwise(F.xxhash64("_lid", "_leaf")).alias("_tpl"))
    )
    forms = cut_lineage(forms)
    owner = F.min_by("_cls", F.struct("_id", "_cls")).alias("_owner")
    # The lines of a template are equally long.
    recurring = cut_lineage(
        seen.join(forms.select(*line, "_len", "_tpl"), line).groupBy("_tpl", "_cls").agg(F.min("_id").alias("_id"), F.max("_len").alias("_len"))
        .groupBy("_tpl").agg(F.count("*").alias("_docs"), F.max("_len").alias("_len"), owner)
        .where(F.col("_docs") >= min_docs * F.greatest(F.lit(1), 1 + min_tokens - F.col("_len"))).select("_tpl", "_owner")
    )
    twice = seen.groupBy(*line).agg(F.count("*").alias("_docs"), owner).where("_docs > 1")
    exact = forms.where(F.col("_words") >= long_tokens).join(recurring, "_tpl", "left_anti").join(twice, line)
    return forms.join(recurring, "_tpl").select(*line, "_owner").union(exact.select(*line, "_owner"))
