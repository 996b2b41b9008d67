"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's character 1- to 3-grams (lower case, letters only, with word ends) are hashed to buckets; the text is the
average of its buckets' embeddings, and a linear softmax names the language. Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows (at most ``per_lang`` documents of each
language, those of smallest hash). Each text of the sample appears a second time with its vowels and its consonants
permuted, as an example of no learned language: that class takes probability from the languages, is never predicted,
and its being the likeliest, or a score below a limit, marks a prediction as rejected. Temperature and limit come from
predictions of parts of the sample by models fitted on the other parts. Since the model is linear, it is applied as one
small table of bucket scores (buckets x languages), whatever the size of the corpus.

Edge cases: a null text or one without a letter is ``und`` with score 0; without labelled rows every text is ``und``;
repeated rows are predicted alike; rows without an id are predicted, never learned from, and their held_out is null; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import per_text

BUCKETS = 4096
DIM = 16
PER_LANG = 600
FOLDS = 3
VOWELS = "aeiouyäöüàâéèêëîïôùûáíóúœæ"
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter; built once per Python worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def bucket_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams of a whole text; None without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    c = np.where(letters()[c], c, 0).astype(np.uint32)
    inside = c != 0
    if not inside.any():
        return None
    c = np.concatenate((np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)))
    inside = np.concatenate(([False], inside, [False]))
    a, b, d = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
    one = c * a
    two = (one[:-1] ^ (c[1:] * b)) * d
    three = (two[:-1] ^ (c[2:] * a)) * b
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    out = np.bincount((one[inside] ^ (one[inside] << np.uint32(7))) >> shift, minlength=BUCKETS)
    out += np.bincount(two[inside[:-1] | inside[1:]] >> shift, minlength=BUCKETS)
    return out + np.bincount(three[inside[1:-1]] >> shift, minlength=BUCKETS)


def disguised(text: str) -> str:
    """The text with its vowels and its other letters permuted, by a permutation that follows from the text."""
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    low = text.lower()
    used = sorted({c for c in low if c.isalpha()})
    swap = {}
    for group in ([c for c in used if c in VOWELS], [c for c in used if c not in VOWELS]):
        swap.update(zip(map(ord, group), [group[i] for i in rng.permutation(len(group))]))
    return low.translate(swap)


def is_training(id_col: Column) -> Column:
    """Documents outside the held-out quarter."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) != 2


def train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 30, rate: float = 30.0, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(bucket scores, biases) after SGD over embeddings and softmax. Rows of ``x`` are averages (they sum to 1)."""
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.3, (x.shape[1], DIM)), rng.normal(0, 0.3, (DIM, classes)), np.zeros(classes)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 16)):
            h = x[rows] @ emb
            g = softmax(h @ out + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = x[rows].T @ (g @ out.T)
            out -= step / 30 * (h.T @ g)
            emb -= step * back
            bias -= step / 30 * g.sum(axis=0)
    return emb @ out, bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", per_lang: int = PER_LANG) -> dict:
    """Model from labelled training rows: languages, bucket scores, biases, temperature and rejection limit."""
    ids = docs.where(F.col(lang).isNotNull() & is_training(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(lang).alias("_lang"))
    ids = ids.withColumn("_h", F.xxhash64("_id") / float(2**64) + 0.5)
    # Few rows of each language, however many there are, lie below its limit; the smallest hashes are among them.
    sizes = ids.groupBy("_lang").agg(F.count("*").alias("_c")).withColumnRenamed("_lang", "_of")
    # One row per language, of which the model keeps a column each; joined by shuffle, a frequent one would be one task.
    near = ids.join(F.broadcast(sizes), F.col("_lang") == F.col("_of")).where(F.col("_h") * F.col("_c") <= 8.0 * per_lang).select("_lang", "_h", "_id").distinct()
    order = Window.partitionBy("_lang").orderBy("_h", "_id")
    chosen = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_lang).select("_id").distinct()
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"], "left_semi").where(F.col(lang).isNotNull())

    def run(texts: list) -> tuple[list, list[list]]:
        both = [(i, own, bucket_counts(t if own else disguised(t))) for i, t in enumerate(texts) if t for own in (True, False)]
        kept = [(i, own, c, np.flatnonzero(c)) for i, own, c in both if c is not None]
        return [k[0] for k in kept], [[k[1] for k in kept], [k[3].tolist() for k in kept], [k[2][k[3]].tolist() for k in kept]]

    found = per_text(rows, [F.col(id_col).alias("i"), F.col(lang).alias("k")], F.col(text), run,
                     {"own": pa.bool_(), "at": pa.list_(pa.int64()), "n": pa.list_(pa.int64())})
    sample = found.groupBy("i", "k", "own").agg(F.min(F.struct("at", "n")).alias("c")).toPandas().sort_values(["i", "k", "own"], ignore_index=True)
    langs = sorted(set(sample["k"]))
    if not langs:
        return {"langs": langs, "table": np.zeros((BUCKETS, 0)), "bias": np.zeros(0), "temperature": 1.0, "limit": 0.0}
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for r, c in enumerate(sample["c"]):
        x[r, c["at"]] = np.asarray(c["n"], np.float32) / np.sum(c["n"])
    y = np.array([langs.index(k) if own else len(langs) for k, own in zip(sample["k"], sample["own"])], np.int64)
    classes = len(langs) + 1
    # Both forms of a text fall into the same fold.
    fold = np.unique(sample["i"].to_numpy(), return_inverse=True)[1] % FOLDS
    z = np.zeros((len(x), classes))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            table, bias = train(x[fold != k], y[fold != k], classes)
            z[fold == k] = x[fold == k] @ table + bias
    # Smoothed targets: certainty is not claimed beyond what a sample of this size can show.
    goal = np.full((len(x), classes), 1 / (len(x) + classes))
    goal[np.arange(len(x)), y] += len(x) / (len(x) + classes)
    grid = np.geomspace(0.05, 20, 121)
    temperature = float(grid[int(np.argmin([-(goal * np.log(softmax(z / t) + 1e-300)).sum(axis=1).mean() for t in grid]))])
    p = softmax(z / temperature)[y < len(langs), :-1]
    right = p.max(axis=1)[p.argmax(axis=1) == y[y < len(langs)]]
    limit = float(np.quantile(right, 0.005)) if len(right) else 0.0
    table, bias = train(x, y, classes)
    return {"langs": langs, "table": table, "bias": bias, "temperature": temperature, "limit": limit}


def predict(docs: DataFrame, model: dict, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability of it) and rejected (no learned language, or a score below the limit)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(texts: list) -> tuple[None, list[list]]:
        m, rows = shared.value, []
        for t in texts:
            c = bucket_counts(t)
            if c is None or not m["langs"]:
                rows.append((UNKNOWN, 0.0, True))
                continue
            z = (c @ m["table"]) / c.sum() + m["bias"]
            p = softmax(z[None] / m["temperature"])[0]
            best = int(p[:-1].argmax())
            rows.append((m["langs"][best], float(p[best]), bool(p[best] < max(m["limit"], p[-1]))))
        return None, [[r[c] for r in rows] for c in range(3)]

    return per_text(docs, [F.col(id_col).alias("doc_id")], F.col(text), run, {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()})


def identify(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Fit on the training rows and predict all: doc_id, held_out, lang_pred, score, rejected."""
    out = predict(docs, fit(docs, text, id_col, lang), text, id_col)
    return out.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")
