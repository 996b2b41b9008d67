"""Mixing sources to target weights, by fixed-length blocks.

The words of a source form one stream, its documents in a fixed pseudorandom order, cut into blocks of fixed length.
The targets say how many blocks the mix takes of each source. Output shards draw their counts per source from a
multinomial over what each source still owes, so every source ends on its own total. A source's slots are numbered
through all shards; slot k is the block at k mod N under a pseudorandom permutation of the N blocks, a new one for
each pass, so blocks are used evenly and none oftener than the cap. Blocks and slots meet in an equi-join on (source,
block), which spreads the largest source like any other.

The driver holds one row per source, and counts per shard and source (10 million at most: shards grow before that).

Edge cases: a null text has size 0 and nothing is taken; a null source is a source of its own, last in order; repeated
rows stand in the stream as often as they occur; an empty table gives no rows; other columns are carried by
:func:`mixed_documents` and ignored by :func:`mix`. Every step is a function of the rows and the seed: reruns agree, but
for which of several identical rows takes which share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage, row_keyed, words

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BLOCK = 128
#: A source has at least so many blocks (as far as its words go), so rounding to blocks stays small.
LEAST_BLOCKS = 1024
SHARD_SLOTS = 65_536
CHUNK_ROWS = 20_000
MOST_COUNTS = 10_000_000
PIECES = "array<struct<lo:long,hi:long,times:long>>"


def targets(sizes: np.ndarray, weights: np.ndarray, cap: float = CAP) -> np.ndarray:
    """Shares of the total by weight; none above ``cap`` times its size, the excess reshared among the others."""
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), float(sizes.sum())
    while free.any():
        share = left * weights / weights[free].sum()
        over = free & (share > cap * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = cap * sizes[over]
        left -= out[over].sum()
        free &= ~over
    return out


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position of k in a pseudorandom permutation of range(n), per row; a Feistel network with cycle walking."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x, limit, key = k.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right, m, s = x[todo] >> bits[todo], x[todo] & mask[todo], mask[todo], key[todo]
        for r in range(4):
            f = (right + s + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        x[todo] = (left << bits[todo]) | right
        todo[todo] = x[todo] >= limit[todo]
    return x.astype(np.int64)


def shard_counts(slots: np.ndarray, seed: int, shard_slots: int = SHARD_SLOTS) -> np.ndarray:
    """Counts by shard and source whose columns sum to ``slots``: multinomial draws from what is still owed."""
    total = int(slots.sum())
    shards = max(1, min(-(-total // shard_slots), MOST_COUNTS // max(1, len(slots))))
    rng, owed, out = np.random.default_rng(seed), slots.astype(np.int64).copy(), np.zeros((shards, len(slots)), np.int64)
    for j in range(shards - 1):
        rest = owed.sum()
        if rest:
            out[j] = np.minimum(rng.multinomial(rest // (shards - j), owed / rest), owed)
            owed -= out[j]
    out[-1] = owed
    return out


def sources(sized: DataFrame, cap: float = CAP) -> pd.DataFrame:
    """One row per source in order (code points, null last): sid, source, source_size, target, block, n, slots."""
    rows = [(r["source"], int(r["s"])) for r in sized.groupBy("source").agg(F.sum("size").alias("s")).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    out = pd.DataFrame({"sid": range(len(rows)), "source": pd.Series([r[0] for r in rows], dtype=object),
                        "source_size": np.array([r[1] for r in rows], np.int64)})
    sizes = out["source_size"].to_numpy(np.float64)
    out["target"] = targets(sizes, np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]), cap)
    out["block"] = np.clip(out["source_size"] // LEAST_BLOCKS, 1, BLOCK)
    out["n"] = -(-out["source_size"] // out["block"])
    exact = out["target"].to_numpy() * out["n"].to_numpy() / np.maximum(sizes, 1)
    out["slots"] = np.minimum(np.rint(exact), cap * out["n"].to_numpy()).astype(np.int64)
    return out


def block_uses(spark: SparkSession, plan: pd.DataFrame, seed: int) -> DataFrame:
    """(sid, block, times) of the blocks that the shards take."""
    counts = shard_counts(plan["slots"].to_numpy(), seed)
    first = np.cumsum(counts, axis=0) - counts
    shard, sid = np.nonzero(counts)
    table = pd.DataFrame({"sid": sid, "shard": shard, "first": first[shard, sid], "c": counts[shard, sid],
                          "n": plan["n"].to_numpy()[sid]}).astype(np.int64)
    drawn = spark.createDataFrame(table, "sid long, shard long, first long, c long, n long")
    slots = drawn.repartition(max(1, len(table) // 64), "sid", "shard").select(
        "sid", "shard", "n", F.explode(F.sequence("first", F.col("first") + F.col("c") - 1)).alias("k"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            k, n, s = (f[c].to_numpy(np.int64) for c in ("k", "n", "sid"))
            key = (s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((k // np.maximum(n, 1)).astype(np.uint64) << np.uint64(40)) ^ np.uint64(seed)
            yield pd.DataFrame({"sid": s, "block": permute(k % np.maximum(n, 1), n, key)})

    return slots.mapInPandas(run, "sid long, block long").groupBy("sid", "block").agg(F.count("*").alias("times"))


def _placed(rows: DataFrame, seed: int) -> tuple[DataFrame, pd.DataFrame]:
    """Rows (_row, doc_id, source, size, _h) with their blocks and uses: one row per document and block it touches."""
    spark = rows.sparkSession
    plan = sources(rows)
    known = spark.createDataFrame(
        [(int(a), b, int(c), float(d), int(e)) for a, b, c, d, e in plan[["sid", "source", "source_size", "target", "block"]].itertuples(index=False)],
        "sid long, src string, source_size long, target double, len long")
    # A running total per source in two levels, so that no task sees a whole source.
    chunks = max(1, rows.count() // CHUNK_ROWS)
    keyed = rows.join(known, F.col("source").eqNullSafe(F.col("src"))).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "_h", F.lit(seed)), F.lit(chunks)))
    sums = keyed.groupBy("sid", "chunk").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "chunk").orderBy("doc_id", "_h", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = keyed.join(offsets, ["sid", "chunk"]).withColumn("start", start)
    touched = F.when(F.col("size") > 0, F.sequence(F.expr("start div len"), F.expr("(start + size - 1) div len")))
    cut = placed.select("_row", "doc_id", "size", "source_size", "target", "sid", "start", "len", F.explode_outer(touched).alias("block"))
    # The use table grows with the corpus, though Spark sees only its small origin: a merge join, never a broadcast.
    used = cut.join(block_uses(spark, plan, seed).hint("merge"), ["sid", "block"], "left")
    lo = F.greatest(F.col("block") * F.col("len"), F.col("start")) - F.col("start")
    hi = F.least((F.col("block") + 1) * F.col("len"), F.col("start") + F.col("size")) - F.col("start")
    return used.select("_row", "doc_id", "size", "source_size", "target", lo.alias("lo"), hi.alias("hi"), F.coalesce("times", F.lit(0)).alias("times")), plan


def _sized(docs: DataFrame, text: str, id_col: str, source: str) -> DataFrame:
    return docs.select("_row", F.col(f"_doc.{id_col}").alias("doc_id"), F.col(f"_doc.{source}").alias("source"),
                       F.size(words(F.col(f"_doc.{text}"))).cast("long").alias("size"), F.xxhash64(f"_doc.{text}").alias("_h"))


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of the document, repeats counted) per row."""
    rows = cut_lineage(_sized(row_keyed(docs), text, id_col, source))
    cut, _ = _placed(rows, seed)
    taken = F.coalesce(F.sum((F.col("hi") - F.col("lo")) * F.col("times")), F.lit(0)).cast("long")
    return cut.groupBy("_row", "doc_id", "size", "source_size", "target").agg(taken.alias("taken")).drop("_row")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def taken_texts(text: str, pieces: list[tuple[int, int, int]]) -> list[str]:
    """The texts that the mix takes of a document, one per pass: its word ranges with that many uses, in order."""
    b = text.encode()
    spans = [m.span() for m in _WORD.finditer(b)]
    out = []
    for turn in range(max((t for _, _, t in pieces), default=0)):
        runs: list[list[int]] = []
        for lo, hi, times in pieces:
            if times > turn and hi > lo:
                if runs and runs[-1][1] == lo:
                    runs[-1][1] = hi
                else:
                    runs.append([lo, hi])
        out.append("\n".join(b[spans[lo][0] : spans[hi - 1][1]].decode() for lo, hi in runs))
    return [t for t in out if t]


def mixed_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", n_chars: str = "n_chars",
                    seed: int = 17) -> DataFrame:
    """The mix itself: for each pass a row of the document with the words taken then; the columns of ``docs``."""
    rows = row_keyed(docs)
    cut, _ = _placed(cut_lineage(_sized(rows, text, id_col, source)), seed)
    pieces = cut.where("times > 0").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "times"))).alias("_pieces"))

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, at, out = b.column("_doc"), [], []
            for i, (t, ps) in enumerate(zip(doc.field(text), b.column("_pieces").to_pylist())):
                for x in taken_texts(t.as_py(), [(p["lo"], p["hi"], p["times"]) for p in ps]):
                    at.append(i)
                    out.append(x)
            made = {text: out, n_chars: [len(x) for x in out]}
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(made[c], doc.field(c).type) if c in made else doc.field(c).take(rows) for c in names], names=names)

    return rows.join(pieces, "_row").select("_doc", "_pieces").mapInArrow(run, docs.schema)
