"""Near-duplicate documents by b-bit MinHash, with every link confirmed on full shingle sets.

1. One pass over the texts makes a document's distinct 5-word shingles (64-bit hashes), their minima under K
   permutations, band keys from the minima, and the b-bit signature: the low bits of each minimum, packed into words.
2. Documents with the same words are one representative from here on.
3. Representatives that share a band key are candidates. Equal bits of two signatures are counted; with
   C = 2^-b for bits that agree by chance, (E - C) / (1 - C) estimates the similarity. Estimates far below the
   limit (five standard deviations) are dropped; the others are confirmed on the full sets of both texts.
4. Candidates are proposed in rounds. First each document meets one centre of its buckets that its component does not
   hold yet; after a few such rounds only buckets with several components are left, and there every pair across
   components is compared. So copies of one text by the thousand cost a few comparisons each, never all pairs, and
   no candidate link between components goes unseen.
5. Components are found by label propagation with pointer jumping over the confirmed links.

Word sequences are told apart by 128 bits of a cryptographic hash; everything else is compared in full.

Edge cases: a null or empty text, or one of white space only, has no shingles and stays alone; with fewer than five
words the whole sequence is the one shingle; repeated rows (same id, same text) give equal result rows, and rows that
share an id but not a text are documents each; ids may be of any ordered type; a row without an id takes part, its
component is named by the ids of the others, or null if they have none either, and is kept then; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, per_text

WIDTH = 5
BANDS, ROWS, BITS = 25, 5, 4
#: Minima of the signature of every document, and of the long one that full comparisons of a bucket use.
K, K_LONG = 128, 1024
PER_WORD = 64 // BITS
#: Five standard deviations of the estimates at similarity 0.85.
SLACK, SLACK_LONG = 0.17, 0.06


def slack(limit: int, k: int, least: float) -> float:
    """Five standard deviations of an estimate from k minima at similarity ``limit`` / 100, and ``least`` at least."""
    c = 2.0**-BITS
    p = c + (1 - c) * limit / 100
    return max(least, 5 * (p * (1 - p) / k) ** 0.5 / (1 - c))


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MUL = _rng.integers(1, 2**32, K_LONG, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, K_LONG, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalising 64-bit mix of each value."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each ASCII-lowered word of a UTF-8 text, in order.

    Each byte is mixed with its place in the word on its own; a word's hash is the mixed sum of these and of its length.
    """
    b = np.frombuffer(text, np.uint8)
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    inside = (b != 32) & ((b < 9) | (b > 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(b), dtype=np.uint64)
    place[: starts[0]] = 0
    for_word = np.diff(np.append(starts, len(b)))
    place[starts[0] :] -= np.repeat(starts.astype(np.uint64), for_word)
    x = _BYTE[b] + place * _BASE
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(29)), dtype=np.uint64)))
    return _mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * _STEP)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_digest(text: bytes) -> tuple[int, int]:
    """128 bits of a cryptographic hash of the ASCII-lowered word sequence, as two numbers."""
    d = hashlib.blake2b(b" ".join(text.translate(_LOWER).split()), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return shingle_set(word_hashes(text or b""))


def shingle_set(w: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the WIDTH-word windows of a word sequence; of the whole where it is shorter."""
    if not len(w):
        return w
    k = min(WIDTH, len(w))
    n = len(w) - k + 1
    total = np.zeros(n, np.uint64)
    for p, c in zip(range(k), _powers(_STEP, k)):
        total += w[p : p + n] * c
    return np.unique(_mix(total + np.uint64(k)))


def minima(sh: np.ndarray, k: int = K) -> np.ndarray:
    """k minima of a non-empty shingle set under multiply-add permutations of 32 bits; the set is taken in blocks."""
    x = (sh >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        h = _MUL[:k, None] * x[None, at : at + 1024]
        h += _ADD[:k, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS minima."""
    bands = m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((bands * _powers(_STEP, ROWS)).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _BASE).astype(np.int64)


def pack(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, PER_WORD to a 64-bit word."""
    low = (m & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(-1, PER_WORD)
    return (low << (np.arange(PER_WORD, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures, by bit counts."""
    x = a ^ b
    any_bit = x.copy()
    for s in range(1, BITS):
        any_bit |= x >> np.uint64(s)
    ones = np.uint64(sum(1 << (BITS * j) for j in range(PER_WORD)))
    equal = 1 - np.bitwise_count(any_bit & ones).sum(axis=-1) / (PER_WORD * x.shape[-1])
    c = 2.0**-BITS
    return (equal - c) / (1 - c)


def signatures(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, h (hash of the text), d1 and d2 (digest of the word sequence), n_shingles, sig (packed) and bands (keys); no sig without shingles."""
    def run(texts: list) -> tuple[None, list[list]]:
        out = []
        for t in texts:
            sh = shingles(t)
            m = minima(sh) if len(sh) else None
            out.append((*word_digest(t or b""), len(sh), *((None, None) if m is None else (pack(m).astype(np.int64), band_keys(m)))))
        return None, [[r[c] for r in out] for c in range(5)]

    longs = pa.list_(pa.int64())
    carry = [F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h")]
    return per_text(docs, carry, F.col(text).cast("binary"), run, {"d1": pa.int64(), "d2": pa.int64(), "n_shingles": pa.int64(), "sig": longs, "bands": longs})


def _similar(pairs: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose estimate is not far below the limit."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                e = estimate(np.stack(f["sig_a"]).astype(np.int64).view(np.uint64), np.stack(f["sig_b"]).astype(np.int64).view(np.uint64))
                f = f[e >= limit / 100 - slack(limit, K, SLACK)]
            yield f[["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets satisfy 100 * intersection >= limit * union. ``texts``: doc_id, t."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, np.empty(0, np.uint64)
        for f in frames:
            ok = np.zeros(len(f), bool)
            for i, (b, ta, tb) in enumerate(zip(f["b"], f["ta"], f["tb"])):
                if b != last:
                    last, kept = b, shingles(tb)
                s = shingles(ta)
                both = len(np.intersect1d(s, kept, assume_unique=True))
                ok[i] = both > 0 and 100 * both >= limit * (len(s) + len(kept) - both)
            yield f.loc[ok, ["a", "b"]]

    both = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("t").alias("ta")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("t").alias("tb")), "b")
    )
    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def components(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, comp): smallest id reachable over ``links`` (a, b), for every id of ``ids``.

    Each round takes the smallest label among the neighbours and then jumps to the label of that label; it ends when no
    label changes. Labels and links stay distributed.
    """
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.select(F.col("a").alias("doc_id")).distinct().withColumn("comp", F.col("doc_id")))
    while True:
        near = (
            both.join(labels.select(F.col("doc_id").alias("b"), F.col("comp").alias("c")), "b")
            .groupBy(F.col("a").alias("doc_id")).agg(F.min("c").alias("c"))
        )
        step = labels.join(near, "doc_id").select("doc_id", F.col("comp").alias("old"), F.least("comp", "c").alias("c"))
        # The target of a label may have found a smaller one itself; take the smaller of the two.
        jump = step.select(F.col("doc_id").alias("c"), F.col("c").alias("c2"))
        new = cut_lineage(step.join(jump, "c", "left").select("doc_id", "old", F.least("c", F.coalesce("c2", "c")).alias("comp")))
        changed = new.where("comp <> old").limit(1).count()
        labels = new.select("doc_id", "comp")
        if not changed:
            break
    return ids.join(labels, "doc_id", "left").select("doc_id", F.coalesce("comp", "doc_id").alias("comp"))


def _proposals(buckets: DataFrame, comps: DataFrame, turn: int, first: bool) -> DataFrame:
    """One candidate centre for each document that shares a bucket with another component: (a, b).

    A bucket offers the member of smallest hash (the hash differs by round) and the first of another component, so each
    member finds one outside its own; a document takes the best offer of its buckets. Aggregates combine before the
    shuffle, and a bucket is one row on the small side of each join.
    """
    order = F.col("doc_id") if first else F.xxhash64("doc_id", F.lit(turn))
    rows = buckets.join(comps, "doc_id") if not first else buckets.withColumn("comp", F.col("doc_id"))
    rows = rows.withColumn("_h", order)
    one = rows.groupBy("key").agg(F.min(F.struct("_h", "doc_id", "comp")).alias("x"))
    far = rows.join(one, "key").where(F.col("comp") != F.col("x.comp"))
    two = far.groupBy("key").agg(F.min(F.struct("_h", "doc_id", "comp")).alias("y"))
    if first:
        picked = far.select("doc_id", F.col("x").alias("o"))
    else:
        met = rows.join(one.join(two, "key"), "key")
        picked = met.select("doc_id", F.when(F.col("comp") != F.col("x.comp"), F.col("x")).otherwise(F.col("y")).alias("o"))
    return picked.groupBy("doc_id").agg(F.min("o").alias("o")).select(
        F.least("doc_id", "o.doc_id").alias("a"), F.greatest("doc_id", "o.doc_id").alias("b")).distinct()


def _across(buckets: DataFrame, comps: DataFrame, texts: DataFrame, limit: int, block: int = 2048) -> DataFrame:
    """All pairs across components within a bucket whose estimate is not far below the limit: (a, b), distinct.

    Every such pair has a member outside the bucket's largest component; these members probe all members. Members are
    dealt to parts and probes to shares of about ``block`` rows; one group is one part and one share, so a large bucket
    is spread over many tasks and no task holds more than two blocks. The largest component is repeated once per share
    of probes, which is once unless thousands of members are still outside it. Only pairs that pass the estimate from
    long signatures, which are made for the members of these buckets alone, are emitted.
    """
    rows = buckets.join(comps, "doc_id")
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = (
        sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("c"))
        .where("c > 1").select(
            "key", F.col("top.comp").alias("top"), F.ceil(F.col("all") / block).cast("int").alias("parts"),
            F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("shares"))
    )
    rows = cut_lineage(rows.join(mixed, "key"))
    dealt = rows.join(_long_signatures(texts.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")), "doc_id")
    h = F.xxhash64("doc_id", F.lit(1))
    part, share = F.pmod(h, "parts").cast("int"), F.pmod(F.shiftright(h, 20), "shares").cast("int")
    members = dealt.select("key", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
                           F.lit(False).alias("probe"), "doc_id", "comp", (F.col("comp") != F.col("top")).alias("out"), "sig", "bands")
    probes = dealt.where("comp <> top").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), share.alias("share"),
        F.lit(True).alias("probe"), "doc_id", "comp", F.lit(True).alias("out"), "sig", "bands")
    group, far = ["key", "part", "share"], slack(limit, K_LONG, SLACK_LONG)

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        k = f[group].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1), [True])))
        ids, comp, probe, out = f["doc_id"].to_numpy(), f["comp"].to_numpy(), f["probe"].to_numpy(bool), f["out"].to_numpy(bool)
        bands = np.frombuffer(b"".join(f["bands"]), np.int64).reshape(len(f), -1)
        sig = np.frombuffer(b"".join(f["sig"]), np.uint64).reshape(len(f), -1)
        a, b = [], []
        for lo, hi in zip(edges, edges[1:]):
            m = lo + np.flatnonzero(~probe[lo:hi])
            for i in lo + np.flatnonzero(probe[lo:hi]):
                # Of two probes the smaller id asks, and a pair is asked in the first band that both share.
                other = m[(comp[m] != comp[i]) & ~(out[m] & (ids[m] < ids[i]))]
                if len(other):
                    first = (bands[other] == bands[i]).argmax(axis=1)
                    other = other[bands[i][first] == k[i, 0]]
                    hit = ids[other[estimate(sig[i], sig[other]) >= limit / 100 - far]]
                    a.append(np.minimum(hit, ids[i]))
                    b.append(np.maximum(hit, ids[i]))
        none = np.empty(0, np.int64)
        return pd.DataFrame({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole groups of a sorted partition at a time; at most one group waits for its rest."""
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            same = (f[group] == f[group].iloc[-1]).all(axis=1).to_numpy()
            cut = len(f) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = f.iloc[cut:]
            if cut:
                yield compare(f.iloc[:cut])
        if held is not None and len(held):
            yield compare(held)

    return members.union(probes).repartition(*group).sortWithinPartitions(*group).mapInPandas(run, "a long, b long").distinct()


def _long_signatures(texts: DataFrame) -> DataFrame:
    """(doc_id, sig, bands): packed signature of K_LONG minima and the band keys, as bytes."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = [minima(shingles(t), K_LONG) for t in f["t"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "sig": [pack(x).tobytes() for x in m], "bands": [band_keys(x).tobytes() for x in m]})

    return texts.select("doc_id", "t").mapInPandas(run, "doc_id long, sig binary, bands binary")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", limit: int = 85, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Documents with 100 * intersection >= ``limit`` * union are linked; ``component_id`` is the smallest id reachable and
    ``kept`` marks it. ``rounds``: rounds of single proposals before the rest is compared in full.
    """
    # Every row is a document of its own, by a number that is never null; ids come back at the end.
    sigs = cut_lineage(signatures(docs, text, id_col).withColumn("row", F.monotonically_increasing_id()))
    # Copies: one row for each word sequence.
    seq = ["d1", "d2"]
    reps = sigs.where("n_shingles > 0").groupBy(*seq).agg(F.min("row").alias("rep"), F.min("doc_id").alias("low"))
    copies = cut_lineage(sigs.join(reps, seq, "left").select(F.col("doc_id").alias("id"), "h", "row", "n_shingles", F.coalesce("rep", "row").alias("rep"), F.coalesce("low", "doc_id").alias("low")))
    own = copies.where("n_shingles > 0 AND row = rep").select("row", "id", "h", "low")
    first = sigs.join(own.select("row"), "row", "left_semi").withColumn("doc_id", F.col("row"))
    keys = first.select("doc_id", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = cut_lineage(keys.join(full, "key"))
    members = buckets.select("doc_id").distinct()
    sig = cut_lineage(first.join(members, "doc_id").select("doc_id", "sig"))
    wanted = cut_lineage(own.join(members, own["row"] == members["doc_id"], "left_semi").select("row", F.col("id").alias("_i"), F.col("h").alias("_h")))
    found = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_x"), F.col(text).cast("binary").alias("t"))
    # The wanted rows grow with the corpus: a merge join at every size, never a broadcast.
    texts = cut_lineage(
        found.join(wanted.hint("merge"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_x") == F.col("_h")))
        .select(F.col("row").alias("doc_id"), "t").dropDuplicates(["doc_id"]))
    links, comps, tested = None, None, None
    for turn in range(rounds + 1):
        if turn < rounds:
            pairs = _proposals(buckets, comps, turn, first=comps is None)
            sa, sb = (sig.select(F.col("doc_id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
            pairs = _similar(pairs.join(sa, "a").join(sb, "b").select("a", "b", "sig_a", "sig_b"), limit)
        else:
            pairs = _across(buckets, comps, texts, limit)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        found = cut_lineage(confirm(pairs, texts, limit))
        tested = pairs if tested is None else tested.union(pairs)
        if links is None:
            links = found
        elif not found.isEmpty():
            links = links.union(found)
        elif comps is not None:
            continue
        comps = cut_lineage(components(links, members))
    # The smallest id of each component, over its word sequences.
    rep_of = comps.select(F.col("doc_id").alias("rep"), "comp")
    lows = rep_of.join(own.select(F.col("row").alias("rep"), "low"), "rep")
    least = rep_of.join(lows.groupBy("comp").agg(F.min("low").alias("least")), "comp").select("rep", "least")
    return (
        copies.join(least, "rep", "left")
        .select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("least", "low").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
