"""Document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs are its lines with a word; a paragraph that stands there repeatedly counts once. Each has a 60-bit
digest, which is put into one cell of each of ``TABLES`` tables: a cell holds the number, the exclusive or of the digests
and that of their check values. The fingerprint is these cells as text, with the number of paragraphs.

Two fingerprints are subtracted cell by cell, which leaves the paragraphs that only one text has. A cell with a single
one of them gives its digest, which is taken out of its other cells, and so on: peeling. It recovers all digests that
differ, whatever the size of the texts, as long as they are few beside the cells. Where it does not, the sketch is
retried larger: four sketches, each for the digests with other bits, for as long as some part does not peel. So the
digests that differ are always recovered in full, in work linear in the paragraphs.

Everything is arrays and higher-order functions on one row per pair of texts; a row's sketches have a fixed size, and
larger ones are more rows.

Edge cases: a null or empty text, or one without a word, has no paragraphs; two such texts are alike (1); repeated rows
have a fingerprint each and stand next to each other; rows without an id come last; the only row of a table is its own
successor; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut_lineage, let

TABLES, CELLS = 3, 16
BITS = 4
#: Rounds of peeling; what is left after them is retried larger.
ROUNDS = 12
#: Bits of the digest that place it in the first sketch; those above part it into larger ones, two at a time.
PLACED = TABLES * BITS
#: Check values are a linear congruence of the digest, so they do not follow from an exclusive or of digests.
MERSENNE, FACTOR, PRIME = 2147483647, 1103515245, 4294967291
#: Rows of one run of successive documents.
RUN = 4096
#: Equal rows (id and text) beyond so many are spread over tasks.
REPEATED = 10_000


def paragraphs(text: Column) -> Column:
    """The sorted distinct digests of the paragraphs of a text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return F.array_sort(F.array_distinct(F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("long"))))


def _check(k: Column) -> Column:
    return ((k % MERSENNE) * FACTOR + 12345) % PRIME


def _placing(k: Column, level: int) -> Column:
    """The bits that place a digest; another hash for each retry."""
    return k if not level else F.xxhash64(k, F.lit(level))


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def sketch(digests: Column, level: int = 0) -> Column:
    """The cells of a set of digests, table by table."""
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))

    def tables(items: Column) -> Column:
        def cells(t: int) -> Column:
            def cell(i: Column) -> Column:
                here = F.filter(items, lambda e: F.shiftright(e["x"], BITS * t).bitwiseAND(CELLS - 1) == i)
                return F.aggregate(here, zero, lambda a, e: _cell(a["n"] + 1, a["k"].bitwiseXOR(e["k"]), a["c"].bitwiseXOR(e["c"])))

            return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell)

        return F.concat(*map(cells, range(TABLES)))

    return let(F.transform(digests, lambda k: F.struct(k.alias("k"), _check(k).alias("c"), _placing(k, level).alias("x"))), tables)


def fingerprint(digests: Column) -> Column:
    """The number of paragraphs and the cells as text: number, digests and checks in hexadecimal, nothing if empty."""
    def shown(c: Column) -> Column:
        return F.when(c["n"] == 0, "").otherwise(F.lower(F.concat_ws(",", c["n"].cast("string"), F.hex(c["k"]), F.hex(c["c"]))))

    return F.concat(F.size(digests).cast("string"), F.lit(":"), F.array_join(F.transform(sketch(digests), shown), ";"))


def peel(a: Column, b: Column, level: int = 0) -> Column:
    """struct(ok, only_a, only_b): the digests recovered from the difference of two sketches, and whether none is left."""
    cells = F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))
    none = F.array().cast("array<long>")

    def pure(left: Column) -> Column:
        single = F.filter(left, lambda c: (F.abs(c["n"]) == 1) & (c["k"] >= 0) & (c["c"] == _check(c["k"])))
        return F.array_distinct(F.transform(single, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"), c["c"].alias("c"), _placing(c["k"], level).alias("x"))))

    def without(left: Column, found: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            t = F.floor(i / CELLS).cast("int")
            # Shifts take a constant: table t reads the bits from BITS * t on.
            bits = lambda e: reduce(lambda rest, j: F.when(t == j, F.shiftright(e["x"], BITS * j)).otherwise(rest), range(TABLES - 1), F.shiftright(e["x"], BITS * (TABLES - 1)))
            here = F.filter(found, lambda e: bits(e).bitwiseAND(CELLS - 1) == i % CELLS)
            return F.aggregate(here, c, lambda s, e: _cell(s["n"] - e["n"], s["k"].bitwiseXOR(e["k"]), s["c"].bitwiseXOR(e["c"])))

        return F.transform(left, one)

    def state(left: Column, only_a: Column, only_b: Column) -> Column:
        return F.struct(left.alias("left"), only_a.alias("only_a"), only_b.alias("only_b"))

    def round_(s: Column, _: Column) -> Column:
        return let(pure(s["left"]), lambda found: F.when(F.size(found) == 0, s).otherwise(state(
            without(s["left"], found),
            F.concat(s["only_a"], F.transform(F.filter(found, lambda e: e["n"] == 1), lambda e: e["k"])),
            F.concat(s["only_b"], F.transform(F.filter(found, lambda e: e["n"] == -1), lambda e: e["k"])))))

    def result(s: Column) -> Column:
        return F.struct(F.forall(s["left"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)).alias("ok"), s["only_a"].alias("only_a"), s["only_b"].alias("only_b"))

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, none, none), round_), result)


def differing(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """``keys``, ``only_a`` and ``only_b``: the digests that only one set of each pair has, recovered from their sketches.

    ``pairs``: one row for each key, with the digests ``a`` and ``b``. What does not peel goes to the next, larger level.
    """
    key = F.struct(*keys).alias("_key")
    todo, level, done = pairs.select(key, F.col(a).alias("_a"), F.col(b).alias("_b")), 0, []
    while True:
        tried = todo.select("_key", "_a", "_b", peel(sketch(F.col("_a"), level), sketch(F.col("_b"), level), level).alias("_p"))
        tried = cut_lineage(tried.select(
            "_key", *[F.when(~F.col("_p.ok"), F.col(c)).alias(c) for c in ("_a", "_b")],
            *[F.when(F.col("_p.ok"), F.col(f"_p.{c}")).alias(c) for c in ("only_a", "only_b")]))
        done.append(tried.where("only_a IS NOT NULL").select("_key", "only_a", "only_b"))
        failed = tried.where("only_a IS NULL")
        if failed.isEmpty():
            break

        def part(c: str, i: int, at: int = PLACED + 2 * level) -> Column:
            return F.filter(c, lambda k: F.shiftright(k, at).bitwiseAND(3) == i)

        todo = failed.select("_key", F.explode(F.array(*[F.struct(part("_a", i).alias("_a"), part("_b", i).alias("_b")) for i in range(4)])).alias("_s")).select("_key", "_s.*")
        level += 1
    whole = done[0]
    if len(done) > 1:
        rest = reduce(DataFrame.union, done[1:]).groupBy("_key").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("only_a", "only_b")])
        # A key that peeled in part has parts at later levels only.
        whole = whole.union(rest)
    return whole.select("_key.*", "only_a", "only_b")


def likeness(n_a: Column, n_b: Column, n_differing: Column) -> Column:
    """Shared paragraphs as a share of all paragraphs of two texts; 1 if there are none."""
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - n_differing) / (n_a + n_b + n_differing))


def _order(id_col: str, text: str) -> list[Column]:
    return [F.col(id_col).isNull().cast("long"), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), F.xxhash64(F.coalesce(F.col(text), F.lit("")))]


def successors(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, digests, next_text, next_digests) of each row and the one after it by id, the last before the first.

    The ids are cut into runs of about ``RUN`` rows at bounds found from ids alone: three numbers per run pass through the
    driver. The first row of a run is also sent to the run before it, so the texts are shuffled once and a run is
    ordered on its own.
    """
    key = docs.select(*[c.alias(n) for c, n in zip(_order(id_col, text), "nih")])
    counted = cut_lineage(key.groupBy("n", "i", "h").agg(F.count("*").alias("c")))
    n = counted.count()
    runs = -(-n // RUN)
    bounds = sorted(
        tuple(r["b"]) for r in counted.repartitionByRange(max(1, runs), "n", "i", "h").withColumn("p", F.spark_partition_id())
        .groupBy("p").agg(F.min(F.struct("n", "i", "h")).alias("b")).collect())
    nulls, ids, hashes = (F.split(F.lit(",".join(str(b[j]) for b in bounds)), ",").cast("array<long>") for j in range(3)) if bounds else [F.array().cast("array<long>")] * 3
    steps = [1 << j for j in reversed(range(max(1, len(bounds)).bit_length()))]

    # Binary search: the number of bounds not above the row's key.
    def bound(at: Column) -> Column:
        return F.struct(F.get(nulls, at).alias("n"), F.get(ids, at).alias("i"), F.get(hashes, at).alias("h"))

    mine = F.struct("_n", "_i", "_h")
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                        lambda at, s: F.when((at + s <= len(bounds)) & (bound(at + s - 1) <= mine), at + s).otherwise(at))
    many = cut_lineage(counted.where(F.col("c") > REPEATED).select(
        F.col("n").alias("_n"), F.col("i").alias("_i"), F.col("h").alias("_h"), F.expr(f"c div {REPEATED}").alias("_parts")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[c.alias(n) for c, n in zip(_order(id_col, text), ("_n", "_i", "_h"))])
    rows = rows.withColumn("_s", F.xxhash64(F.monotonically_increasing_id())).join(many, ["_n", "_i", "_h"], "left")
    rows = rows.withColumn("_run", found - 1).withColumn("_salt", F.coalesce(F.expr("pmod(_s, _parts)"), F.lit(0).cast("long")))
    opens = (bound(F.col("_run")) == mine) & (F.col("_salt") == 0)
    before = F.pmod(F.col("_run") - 1, F.lit(max(1, len(bounds))))
    own = F.struct(F.col("_run").alias("run"), F.lit(False).alias("guest"))
    sent = F.when(opens, F.array(own, F.struct(before.alias("run"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    # A salted group holds rows of one key, each followed by its like.
    apart = [F.when(F.col("_salt") > 0, F.col(c)).alias(f"{c}a") for c in ("_n", "_i", "_h")]
    dealt = rows.select("doc_id", "text", "_n", "_i", "_h", "_salt", *apart, paragraphs(F.col("text")).alias("digests"), F.explode(sent).alias("_to"))
    dealt = dealt.select("*", "_to.run", "_to.guest")
    w = Window.partitionBy("run", "_salt", "_na", "_ia", "_ha").orderBy("guest", "_n", "_i", "_h")
    return dealt.select(
        "doc_id", "text", "digests", "guest", *[F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"next_{c}") for c in ("text", "digests")]).where("NOT guest").drop("guest")


def edited(text: Column, next_text: Column) -> Column:
    """A text whose last half (rounded down) is replaced by the first as many code points of the next."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - half), next_text.substr(F.lit(1), half))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, and the likeness of each text to its edit and to the next text."""
    rows = successors(docs, text, id_col).withColumn("_e", edited(F.col("text"), F.col("next_text")))
    # From here on only digests.
    held = cut_lineage(rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("_e").cast("binary"), 256).alias("edited_sha256"),
        F.col("digests").alias("a"), paragraphs(F.col("_e")).alias("e"), F.col("next_digests").alias("b"), F.monotonically_increasing_id().alias("_row")))
    pairs = held.select("_row", "a", F.explode(F.array(
        F.struct(F.lit("edited").alias("what"), F.col("e").alias("b")), F.struct(F.lit("next").alias("what"), F.col("b").alias("b")))).alias("_p")).select("_row", "a", "_p.*")
    # Peeling is work on little data: by rows, not by bytes.
    pairs = pairs.repartition(max(1, held.count() // RUN), "_row", "what")
    found = differing(pairs, ["_row", "what"]).select("_row", "what", (F.size("only_a") + F.size("only_b")).alias("d"))
    sizes = found.groupBy("_row").agg(*[F.max(F.when(F.col("what") == x, F.col("d"))).alias(x) for x in ("edited", "next")])
    n = {c: F.size(c) for c in "aeb"}
    return held.join(sizes, "_row").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(n["a"], n["e"], F.col("edited")).alias("near_edited"), likeness(n["a"], n["b"], F.col("next")).alias("near_next"))
