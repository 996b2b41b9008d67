"""Ranked lexical search with hashed max-sketches.

A document's sketch is an array of hashed coordinates. Every term falls on one, which holds the largest frequency of the
document's terms there; as a term's impact grows with its frequency in the document, that is the coordinatewise maximum
of the impacts. A query reads the coordinates of its terms: the sum of their impacts, each times the weight of the
query's term, is never below the exact score. Sketches have at least ``SPREAD`` coordinates for each distinct term, so
an absent term finds an impact there once in ``SPREAD`` times; only occupied coordinates are stored.

Search: (1) one pass over the texts counts documents, terms and the document frequencies of the queries' terms; one
builds the sketches. (2) Bounds of all documents are looked up for a batch of queries at a time, and the documents of
highest bound of each query are scored exactly, by descending bound: ``k`` of them first, then ``STEP`` times as many,
then all that are left. (3) The k-th best score so far is the threshold: a query is done as soon as the lowest bound that
was scored lies below it, and no document with a lower bound than it is ever scored. So results are exact.

Queries are taken in batches of bounded size; a batch of terms and weights is all that tasks receive. No task emits
more than the documents that it was given, for a query, and the k highest are kept in each task before any shuffle.

Edge cases: a null or empty text has no terms and is never found; a query without terms, or whose terms no document
holds, gives no rows; equal scores stand by ascending id, rows without an id last; repeated rows are documents each;
queries with equal ids are answered each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

K = 50
SPREAD = 1 << 18
#: Growth of the documents scored for a query between the first and the second round.
STEP = 20
#: Terms of a batch of queries, repeats between queries counted; a query with more is a batch of its own.
BATCH_TERMS = 16_384
#: Bounds that are looked up together.
BOUNDS = 1 << 18
#: Scale of a term's impact within a document, and the constants of its saturation.
SCALE, SATURATION, FLOOR, SLOPE, FULL = 1_000_000_000, 20, 100, 50, 1000
#: Term bytes are ASCII letters and digits and all bytes of other characters; letters are lower-cased, the rest separates.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Upper values of frequencies by code: exact up to 127, then in steps of a sixteenth, the last without bound.
_UPPER = [*range(128)]
while len(_UPPER) < 255:
    _UPPER.append(-(-_UPPER[-1] * 17 // 16))
_UPPER = np.array([*_UPPER, 2**40], np.int64)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return (text or b"").translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norm(n: int, n_docs: int, n_terms: int) -> int:
    """The length norm of a document with n terms."""
    return FLOOR - SLOPE + (SLOPE * n * n_docs) // n_terms


def impact(tf: int, m: int) -> int:
    return (SCALE * tf) // (FULL * tf + SATURATION * m)


class Batch:
    """Queries looked up together: their distinct terms, and for each query the numbers of its terms."""

    def __init__(self, queries: list[tuple[int, list[bytes]]]) -> None:
        self.names = list(dict.fromkeys(t for _, ts in queries for t in ts))
        number = {t: i for i, t in enumerate(self.names)}
        self.ids = np.array([i for i, _ in queries], np.int64)
        self.slots = np.array([number[t] for _, ts in queries for t in ts], np.int64)
        self.starts = np.cumsum([0, *(len(ts) for _, ts in queries)])[:-1]
        self.hashes = np.array([zlib.crc32(t) for t in self.names], np.int64)
        self.weights = np.zeros(len(self.names), np.int64)
        of = np.repeat(np.arange(len(queries)), [len(ts) for _, ts in queries])
        order = np.argsort(self.slots, kind="stable")
        self.holders, self.first = of[order], np.searchsorted(self.slots[order], np.arange(len(self.names) + 1))

    def coordinates(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The coordinates of the terms in sketches of that width, sorted, and the term of each."""
        at = self.hashes & (width - 1)
        order = np.argsort(at, kind="stable")
        return at[order].astype(np.uint32), order

    def terms_of(self, q: int) -> np.ndarray:
        end = self.starts[q + 1] if q + 1 < len(self.starts) else len(self.slots)
        return self.slots[self.starts[q] : end]


def batches(queries: DataFrame, text: str) -> Iterator[Batch]:
    """Queries (_q, text) with terms, some thousand terms at a time."""
    held, size = [], 0
    for r in queries.select("_q", F.col(text).cast("binary").alias("t")).toLocalIterator():
        ts = list(dict.fromkeys(terms(bytes(r["t"]) if r["t"] is not None else None)))
        if held and size + len(ts) > BATCH_TERMS:
            yield Batch(held)
            held, size = [], 0
        if ts:
            held.append((r["_q"], ts))
            size += len(ts)
    if held:
        yield Batch(held)


def statistics(docs: DataFrame, batch: Batch) -> tuple[int, int, list[int]]:
    """Documents with a term, terms of all, and the documents that hold each term of the batch."""
    asked = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(batch.names)})
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n_docs, n_terms = Counter(), 0, 0
        for f in frames:
            for t in f.column(0):
                ts = terms(t.as_py())
                n_docs, n_terms = n_docs + bool(ts), n_terms + len(ts)
                found.update(asked.value.keys() & set(ts))
        rows = [*((asked.value[t], n) for t, n in found.items()), (-1, n_docs), (-2, n_terms)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], schema=schema)

    counts = docs.select("_t").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counts.collect()}
    return found.get(-1, 0), found.get(-2, 0), [found.get(i, 0) for i in range(len(batch.names))]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, width, at, code): the occupied coordinates of each document's sketch; documents with a term only."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("width", pa.int64()), ("at", pa.binary()), ("code", pa.binary())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            keep, cols = [], ([], [], [], [])
            for row, t in enumerate(f.column(2)):
                counts = Counter(terms(t.as_py()))
                if not counts:
                    continue
                width = min(1 << (SPREAD * len(counts) - 1).bit_length(), 1 << 32)
                at = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) & (width - 1)
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                code = np.searchsorted(_UPPER, tf).astype(np.uint8)
                order = np.lexsort((code, at))
                at, code = at[order], code[order]
                last = np.append(at[1:] != at[:-1], True)  # the largest of each coordinate
                keep.append(row)
                for c, v in zip(cols, (int(tf.sum()), width, at[last].astype(np.uint32).tobytes(), code[last].tobytes())):
                    c.append(v)
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [f.column(0).take(rows), f.column(1).take(rows), *(pa.array(c, t.type) for c, t in zip(cols, list(schema)[2:]))], schema=schema)

    return docs.select("doc_id", "h", "_t").mapInArrow(run, "doc_id long, h long, n long, width long, at binary, code binary")


def _bounds(batch: Batch, n_docs: int, n_terms: int, n: list[int], width: int, at: list[bytes], code: list[bytes]) -> np.ndarray:
    """Upper bounds of documents of one sketch width (rows) for the queries of a batch (columns)."""
    at_terms, terms_there = batch.coordinates(width)
    row = np.repeat(np.arange(len(n)), [len(c) for c in code])
    cells = np.frombuffer(b"".join(at), np.uint32)
    lo, hi = (np.searchsorted(at_terms, cells, side) for side in ("left", "right"))
    met = np.flatnonzero(hi > lo)
    m = np.array([min(norm(x, n_docs, n_terms), 2**50) for x in n], np.int64)
    tf = _UPPER[np.frombuffer(b"".join(code), np.uint8)[met]].astype(np.float64)
    # Rounded up in doubles: never below the integer quotient.
    value = np.minimum(np.ceil(SCALE * tf / (FULL * tf + SATURATION * m[row[met]]) * (1 + 1e-12)), SCALE // FULL)
    # Each occupied coordinate meets the batch's terms there, and each of these the queries that hold it.
    cell, of = _ranges(lo[met], hi[met])
    number = terms_there[of]
    term, spot = _ranges(batch.first[number], batch.first[number + 1])
    spent = np.bincount(row[met][cell][term] * len(batch.ids) + batch.holders[spot], (value[cell] * batch.weights[number])[term], len(n) * len(batch.ids))
    return spent.reshape(len(n), -1)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of each range [lo, hi), one after another, and the number of the range that each is of."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[which]


def _looked_up(index: DataFrame, batch: Batch, n_docs: int, n_terms: int, least: np.ndarray, k: int | None) -> DataFrame:
    """(q, doc_id, h, bound): the bounds of each query that reach ``least``, the ``k`` highest in each task if given."""
    shared = index.sparkSession.sparkContext.broadcast((batch, least))
    schema = pa.schema([("q", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("bound", pa.float64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, least = shared.value
        top = schema.empty_table()
        for f in frames:
            widths = f.column("width").to_numpy()
            found = []
            for width in np.unique(widths):
                mine = np.flatnonzero(widths == width)
                step = max(1, BOUNDS // len(batch.ids))
                for lo in range(0, len(mine), step):
                    part = f.take(pa.array(mine[lo : lo + step]))
                    b = _bounds(batch, n_docs, n_terms, part.column("n").to_pylist(), int(width), part.column("at").to_pylist(), part.column("code").to_pylist())
                    d, q = np.nonzero(b >= least)
                    ids = pa.array(d)
                    found.append(pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), part.column("doc_id").take(ids), part.column("h").take(ids), pa.array(b[d, q])], schema=schema))
            if k is None:
                yield from found
                continue
            top = pa.Table.from_batches([*top.to_batches(), *found], schema=schema)
            q = top.column("q").to_numpy()
            order = np.lexsort((-top.column("bound").to_numpy(), q))
            q = q[order]
            top = top.take(pa.array(order[np.arange(len(q)) - np.searchsorted(q, q) < k])).combine_chunks()
        yield from top.to_batches()

    return index.mapInArrow(run, "q int, doc_id long, h long, bound double")


def _scored(docs: DataFrame, asked: DataFrame, batch: Batch, n_docs: int, n_terms: int) -> DataFrame:
    """(q, doc_id, h, score): exact scores above 0 of the documents that ``asked`` (q, doc_id, h) names."""
    shared = docs.sparkSession.sparkContext.broadcast(batch)
    schema = pa.schema([("q", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("score", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = shared.value
        number = {t: i for i, t in enumerate(batch.names)}
        mine: dict[int, list[int]] = {}
        weights = batch.weights.tolist()
        for f in frames:
            at, qs, scores = [], [], []
            for row, (t, asked) in enumerate(zip(f.column("_t"), f.column("qs"))):
                ts = terms(t.as_py())
                m = norm(len(ts), n_docs, n_terms)
                part = {number[t]: weights[number[t]] * impact(tf, m) for t, tf in Counter(ts).items() if t in number}
                for q in asked.as_py():
                    if q not in mine:
                        mine[q] = batch.terms_of(q).tolist()
                    score = sum(part.get(i, 0) for i in mine[q])
                    if score > 0:
                        at.append(row)
                        qs.append(q)
                        scores.append(score)
            ids = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(qs, pa.int32()), f.column("doc_id").take(ids), f.column("h").take(ids), pa.array(scores, pa.int64())], schema=schema)

    # Of one document, at most the queries of a batch.
    lists = cut_lineage(asked.groupBy(F.col("doc_id").alias("i"), F.col("h").alias("j")).agg(F.collect_set("q").alias("qs")))
    met = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")))
    return met.select("doc_id", "h", "_t", "qs").mapInArrow(run, "q int, doc_id long, h long, score long")


def _best(rows: DataFrame, by: str, k: int, name: str = "rank") -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc(by), F.asc_nulls_last("doc_id"), "h")
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = K, text: str = "text", id_col: str = "doc_id", query_text: str = "text",
           query_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` highest-scoring documents with a score above 0, for each query."""
    asked = cut_lineage(queries.select(F.col(query_id).alias("item_id"), F.col(query_text).alias("text"), F.monotonically_increasing_id().alias("_q")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("_t"))
    index, out = None, None
    for batch in batches(asked, "text"):
        n_docs, n_terms, df = statistics(rows, batch)
        if not n_docs:
            break
        batch.weights = np.array([weight(n_docs, n) if n else 0 for n in df], np.int64)
        if index is None:
            index = cut_lineage(sketches(rows))
        found, least = None, np.ones(len(batch.ids))
        for most in (k, STEP * k, None):
            high = _looked_up(index, batch, n_docs, n_terms, least, most)
            high = cut_lineage(high if most is None else _best(high, "bound", most))
            scores = _scored(rows, high, batch, n_docs, n_terms)
            # The highest of earlier rounds are among the highest of this one, for each query that is still open.
            found = cut_lineage(_best(scores if found is None else scores.union(found.join(high.select("q").distinct(), "q", "left_anti").drop("rank")), "score", k))
            if most is None:
                break
            # One row per query of the batch.
            last = {r["q"]: r["score"] for r in found.where(F.col("rank") == k).select("q", "score").collect()}
            seen = {r["q"]: (r["n"], r["low"]) for r in high.groupBy("q").agg(F.count("*").alias("n"), F.min("bound").alias("low")).collect()}
            for q in range(len(least)):
                n, low = seen.get(q, (0, 0))
                least[q] = np.inf if n < most or low < last.get(q, 0) else max(least[q], last.get(q, 0))
            if np.isinf(least).all():
                break
        ids = queries.sparkSession.createDataFrame([(i, int(q)) for i, q in enumerate(batch.ids)], "q int, _q long")
        part = cut_lineage(found.join(F.broadcast(ids), "q").join(asked.select("_q", "item_id"), "_q").select("item_id", "rank", "doc_id", "score"))
        out = part if out is None else out.union(part)
    if out is None:
        none = queries.where(F.lit(False))
        return none.select(F.col(query_id).alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out
