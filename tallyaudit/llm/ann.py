"""Approximate nearest neighbours by a permutation index.

A bounded set of pivots is drawn from the vectors. Each vector is represented by the order of the pivots by nearness
and posted, with that order, in the inverted files of its ``post`` nearest pivots. A query visits the files of its
``visit`` nearest pivots and looks at each vector once, in the first file that holds it; there the footrule distance
between the orders ranks the members, the best ``share`` of them are reranked by true distance, and the nearest of all
files form the answer. Files are dealt to parts and queries to blocks of bounded size; only each part's nearest few
leave it, so no pairs are emitted. A query that finds too few is answered by a scan of all vectors in the same blocks.

The long orders carry the recall, the short postings the work: with 256 pivots, 6 postings and 40 visits a query
compares the orders of a little over half of the vectors and computes true distances to a share that falls with their
number (figures in the README). Vectors that spread evenly in many dimensions, as in the test tables, leave no index of
this kind less to look at; clustered ones do.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; distances exist
between vectors of one dimension only, so those of another than the most frequent (the smaller, if tied) take none
either; equal distances go to the smaller id; a repeated id stands for its smallest vector, and asks if one of its rows
does; rows without an id are neither queries nor answers; with few candidates all are returned; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from .common import cut_lineage

PIVOTS, POST, VISIT, SHARE = 256, 6, 40, 0.1
PART, QUERIES = 4096, 1024


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def pivot_orders(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivot numbers by nearness for each row, ties to the smaller number."""
    d = ((rows**2).sum(axis=1)[:, None] - 2 * rows @ pivots.T) + (pivots**2).sum(axis=1)
    return np.argsort(d, axis=1, kind="stable").astype(np.int16)


def _rank_type(pivots: int) -> type:
    return np.uint8 if pivots <= 256 else np.uint16


def _post(vectors: DataFrame, pivots: np.ndarray, files: int) -> DataFrame:
    """(file, id, v, ranks): one row for each of the ``files`` nearest pivots of a vector."""
    kind = _rank_type(len(pivots))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            rows = np.stack(f["v"])
            order = pivot_orders(rows.astype(np.float64), pivots)
            ranks = np.argsort(order, axis=1).astype(kind)
            out = pd.DataFrame({"file": list(order[:, :files].astype(np.int32)), "id": f["id"].to_numpy(),
                                "v": [r.tobytes() for r in rows], "ranks": [r.tobytes() for r in ranks]})
            out = out.explode("file", ignore_index=True)
            yield out.astype({"file": np.int32})

    return vectors.mapInPandas(run, "file int, id long, v binary, ranks binary")


def _search(members: DataFrame, queries: DataFrame, k: int, pivots: int, post: int, share: float, kind: type) -> DataFrame:
    """(query_id, vec_id, score): the nearest k of each part of the files that a query visits.

    A member belongs, for a query, to the file of the query's nearest pivot among those it is posted under.
    """
    ranked = _rank_type(pivots)
    sizes = members.groupBy("file").agg(F.count("*").alias("m")).join(queries.groupBy("file").agg(F.count("*").alias("q")), "file")
    # One row per file: bounded by the number of pivots.
    split = F.broadcast(sizes.select("file", F.ceil(F.col("m") / PART).cast("int").alias("parts"), F.ceil(F.col("q") / QUERIES).cast("int").alias("blocks")))
    part, block = F.pmod(F.xxhash64("id"), "parts").cast("int"), F.pmod(F.xxhash64("id"), "blocks").cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    m = members.join(split, "file").select("file", part.alias("part"), every("blocks").alias("block"), F.lit(False).alias("asks"), "id", "v", "ranks")
    q = queries.join(split, "file").select("file", every("parts").alias("part"), block.alias("block"), F.lit(True).alias("asks"), "id", "v", "ranks")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        found = []
        m, q = f[~f["asks"]].sort_values("id"), f[f["asks"]]
        if len(m) and len(q):
            file, ids = int(f["file"].iloc[0]), m["id"].to_numpy()
            v = np.frombuffer(b"".join(m["v"]), kind).reshape(len(m), -1)
            r = np.frombuffer(b"".join(m["ranks"]), ranked).reshape(len(m), -1).astype(np.int16)
            posted = np.argsort(r, axis=1, kind="stable")[:, :post]
            for i, qv, qr in zip(q["id"], q["v"], q["ranks"]):
                qr = np.frombuffer(qr, ranked).astype(np.int16)
                here = np.flatnonzero((qr[posted].min(axis=1) == qr[file]) & (ids != i))
                foot = np.abs(r[here] - qr).sum(axis=1, dtype=np.int64)
                best = max(2 * k, int(np.ceil(share * len(here))))
                near = here[np.argsort(foot, kind="stable")[:best]]  # members stand by id: ties to the smaller
                d = np.sqrt(((v[near].astype(np.float64) - np.frombuffer(qv, kind)) ** 2).sum(axis=1))
                top = np.lexsort((ids[near], d))[:k]
                found.append(pd.DataFrame({"query_id": i, "vec_id": ids[near][top], "score": d[top]}))
        if not found:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        return pd.concat(found, ignore_index=True)

    return m.union(q).groupBy("file", "part", "block").applyInPandas(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS,
            post: int = POST, visit: int = VISIT, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest other vectors of each row for which ``queries`` holds."""
    kind = np.float32 if vectors.schema[vec_col].dataType.elementType == FloatType() else np.float64
    kept = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>" if kind is np.float32 else "array<double>").alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = cut_lineage(kept.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (dims["d"], dims["count"]) if dims else (1, 0)
    rows = rows.where(F.size("v") == dim)
    drawn = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(4 * pivots).collect()
    chosen = list(dict.fromkeys(tuple(r["v"]) for r in drawn))[:pivots]
    table = np.array(chosen, np.float64).reshape(-1, dim)
    asking = rows.where("asks").select("id", "v")
    members = cut_lineage(_post(rows.select("id", "v"), table, post))
    found = cut_lineage(_search(members, _post(asking, table, visit), k, len(table), post, share, kind))
    counts = found.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= min(k, n - 1)).select(F.col("query_id").alias("id"))
    short = asking.join(counts, "id", "left_anti")
    if not short.isEmpty():
        whole = [_post(x, table[:1], 1) for x in (rows.select("id", "v"), short)]
        found = found.union(_search(whole[0], whole[1], k, 1, 1, 1.0, kind)).distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
