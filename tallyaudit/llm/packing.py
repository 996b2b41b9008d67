"""Packing tokenised documents into windows by best-fit decreasing.

Each text is tokenised once, in the partition where it is read, and cut into full windows and a rest. From there only
the pieces' places and checksums move. Pieces are dealt evenly, by a hash of their row, to shards of a bounded number;
a shard packs its pieces in order of decreasing length, each into the open window with the least room that holds it,
which a segment tree indexed by remaining capacity finds. Windows never span shards, so a shard's only loss is its
last few windows.

Edge cases: a null or empty text is the closing id alone; repeated rows are packed each; one very long document gives
many full windows, which shards share; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, per_text

WINDOW = 2048
CLOSING = (1).to_bytes(4, "little")
SHARD_PIECES = 32_768
#: Chunks between blanks whose ids a Python worker remembers, across its tasks; it starts anew beyond that.
MEMO = 1_200_000
MEMO_CHARS = 48


class CapacityTree:
    """Open windows by remaining capacity 0..top; a segment tree over the capacities tells which are present."""

    def __init__(self, top: int) -> None:
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the least capacity >= need."""
        i = need + self.leaves
        while not self.count[i]:
            while i & 1:  # a right child: nothing larger below its parent
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # passed the right end of the level
                return None
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) for each length, none above ``window``."""
    tree, out, windows = CapacityTree(window), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found, windows = (window, windows), windows + 1
        room, w = found
        out[i] = (w, window - room)
        if room > lengths[i]:
            tree.add(room - lengths[i], w)
    return out


@lru_cache(maxsize=2)
def _loaded(tokenizer: str) -> tuple[Callable, dict[str, bytes]]:
    """The batch encoder and the memory of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).encode_batch_fast, {}


def _remember(new: set[str], memo: dict[str, bytes], encode: Callable) -> list[str]:
    """Add the ids of ``new`` chunks to ``memo``; returns those too long to stay there.

    The tokenizer lower-cases, never joins ids across a blank or line end, and separates letters from punctuation. So
    chunks are coded on their own, a full stop or comma after a Latin letter apart from the rest, and ASCII in lower
    case. A dotted capital I ends in a combining mark once it is lower-cased, which is no letter; other scripts stay whole.
    """
    parts = {c: (c[:-1], c[-1]) if len(c) > 1 and c[-1] in ".," and c[-2] < "\u0250" and c[-2] != "\u0130" and c[-2].isalpha() else (c, "") for c in new}
    cores = {c: core.lower() if core.isascii() and "<|" not in core else core for c, (core, _) in parts.items()}
    missing = [c for c in {*cores.values(), *(end for _, end in parts.values())} if c not in memo]
    for c, e in zip(missing, encode(missing, add_special_tokens=False)):
        memo[c] = array("I", e.ids).tobytes() if sys.byteorder == "little" else b"".join(x.to_bytes(4, "little") for x in e.ids)
    for c, (_, end) in parts.items():
        memo[c] = memo[cores[c]] + memo[end]
    return [c for c in {*missing, *new} if len(c) > MEMO_CHARS]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of the full windows and the rest of each document's ids."""
    def run(texts: list) -> tuple[list, list[list]]:
        encode, memo = _loaded(tokenizer)
        at, rows = [], []
        for i, t in enumerate(texts):
            chunks = (t or "").replace("\n", " ").split(" ")
            if len(memo) > MEMO:
                memo.clear()
            long = _remember({c for c in chunks if c not in memo}, memo, encode)
            ids = b"".join([memo[c] for c in chunks]) + CLOSING
            for c in long:
                memo.pop(c, None)
            n = len(ids) // 4
            for s in range(0, n, window):
                part = ids[4 * s : 4 * (s + window)]
                at.append(i)
                rows.append((s, len(part) // 4, zlib.crc32(part), n))
        return at, [[r[c] for r in rows] for c in range(4)]

    return per_text(docs, [F.col(id_col).alias("doc_id")], F.col(text), run, dict.fromkeys(("start", "length", "ids_crc32", "doc_tokens"), pa.int64()))


def pack(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset`` in windows of at most ``window`` ids."""
    cut = cut_lineage(pieces(docs, tokenizer, text, id_col, window).withColumn("_row", F.monotonically_increasing_id()))
    shards = max(1, -(-cut.count() // SHARD_PIECES))

    def run(f: pa.Table) -> pa.Table:
        f = f.sort_by([("_row", "ascending")])
        places = best_fit_decreasing(f.column("length").to_pylist(), window)
        shard = f.column("_shard")[0].as_py()
        f = f.drop_columns(["_row", "_shard"]).append_column("sequence_id", pa.array([(shard << 32) + w for w, _ in places], pa.int64()))
        return f.append_column("offset", pa.array([o for _, o in places], pa.int64()))

    dealt = cut.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    id_type = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("_shard").applyInArrow(
        run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
