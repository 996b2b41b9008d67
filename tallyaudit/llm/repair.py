"""Conversation structure repair by weighted interval parsing.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. The repair grammar is in Chomsky normal
form: a nonterminal N(p, q) derives the spans of turns that lead the form from place p to place q (at the start, after
the system turn, after a user turn, after a whole pair), by N(p, q) -> N(p, r) N(r, q) and, for a single turn, by one of
its edits: keep, rerole, delete. Inserted turns derive the empty span; their closure stands on both sides of every
single turn, so longer spans need no rule for them. A cell of the table holds, for each N(p, q) over its span, the least
(cost, audit); the audit lists the initials of the edits in order. Of two audits of one span at equal cost neither is a
prefix of the other, so least parts make least wholes, and as concatenation is associative one split of a span is
enough: spans are combined bottom-up, by doubling lengths.

Turns are range-partitioned by conversation and turn, so a conversation that holds a third of all rows is parsed by many
tasks; each gives one cell per conversation and batch. The cells of a conversation then precede its turns in one sorted
stream that joins the cells, walks the chosen audit along the turns and hashes the repaired conversation. That last walk
is sequential by definition of the hash and holds one batch of turns, the audit and no more.

Edge cases: nulls read as one space, but a null turn stands before all others and counts for no gap, and a null
conversation id is a conversation of its own; turns with equal number stand in the order of the input; an empty role has
no fitting initial; a conversation whose turns are all gone gives zeros and the empty audit; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut_lineage

#: Least (cost, audit) by place before and after a span.
Cell = dict[tuple[int, int], tuple[int, str]]

INSERT, REROLE, DELETE, CUT_OFF = 5, 1, 2, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
START, SYSTEM, USER, PAIR = range(4)
MOVES = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (PAIR, USER)), "a": ((USER, PAIR),)}
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}


def _offer(cell: Cell, key: tuple[int, int], value: tuple[int, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def join(left: Cell, right: Cell) -> Cell:
    """N(p, q) over two adjacent spans: the least over all places r between them."""
    out: Cell = {}
    by_start: dict[int, list] = {}
    for (r, q), value in right.items():
        by_start.setdefault(r, []).append((q, *value))
    for (p, r), (cost, audit) in left.items():
        for q, c, a in by_start.get(r, ()):
            _offer(out, (p, q), (cost + c, audit + a))
    return out


@lru_cache(maxsize=1)
def insertions() -> Cell:
    """The closure of inserted user and assistant turns over the empty span."""
    out: Cell = {(p, p): (0, "") for p in range(4)}
    step = {**out}
    for moves in (MOVES["u"], MOVES["a"]):
        for move in moves:
            _offer(step, move, (INSERT, "I"))
    while True:
        wider = join(out, step)
        if wider == out:
            return out
        out = wider


@lru_cache(maxsize=256)
def leaf(initial: str, fault: int) -> Cell:
    """The cell of a single turn: its edits, with insertions on both sides."""
    out: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in (BLANK, DUPLICATE):
        extra = CUT_OFF if fault == TRUNCATED else 0
        for move in MOVES.get(initial, ()):
            _offer(out, move, (extra, "K"))
        for role in "ua":
            for move in MOVES[role]:
                _offer(out, move, (extra + REROLE, "R"))
    return join(join(insertions(), out), insertions())


def parse(cells: list[Cell]) -> Cell:
    """The cell of a run of adjacent spans, bottom-up."""
    while len(cells) > 1:
        joined = [join(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = joined + cells[len(joined) * 2 :]
    return cells[0]


def best(cell: Cell) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    return min(cell[START, q] for q in (START, PAIR) if (START, q) in cell)


class Walk:
    """Applies an audit to turns in order; yields the repaired turns."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place = audit, 0, START

    def _put(self, initial: str) -> None:
        self.place = next(q for p, q in MOVES[initial] if p == self.place)

    def _next(self) -> str:
        initial = "a" if self.place == USER else "u"
        self._put(initial)
        return ROLES[initial]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._next(), "", "I"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role[0])
            yield role, text, edit
        elif edit == "R":
            yield self._next(), text, edit


def damage(turns: DataFrame) -> DataFrame:
    """The turns with faults put in by crc32 of ``conv_id:turn``: dropped, emptied, cut off, repeated or given to the user."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text, role = shown("text"), shown("role")
    return (
        turns.select("conv_id", "turn", fault.alias("fault"), role.alias("role"), text.alias("text")).where("fault <> 0")
        .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
        .drop("_copy")
    )


def _key(c: str) -> Column:
    """A conversation id as text that keeps null apart."""
    return F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(c).cast("string")))


def _prepared(turns: DataFrame) -> DataFrame:
    """Turns with ``id`` (in the order of the input), initial and the marks of blank and cut-off text, written once."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    last = F.regexp_extract(text, rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return cut_lineage(turns.select(
        _key("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.monotonically_increasing_id().alias("id"), F.substring(role, 1, 1).alias("initial"), fault.alias("fault")))


def _segments(rows: DataFrame) -> DataFrame:
    """One row per conversation, range partition and batch: counts, outer turns and initials, and the cell."""
    first = rows.where(F.col("fault") != BLANK).groupBy("key", "role", F.md5(F.col("text").cast("binary"))).agg(F.min(F.struct("turn", "id")).alias("f"))
    seen = first.select(F.col("f.id").alias("id"), F.lit(True).alias("new"))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("new").isNull(), DUPLICATE).otherwise(F.col("fault"))
    light = rows.select("key", "turn", "id", "initial", "fault").join(seen, "id", "left").select("key", "turn", "id", "initial", fault.alias("fault"))
    order = ["key", F.asc_nulls_first("turn"), "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            keys, out = d["key"], []
            lo = 0
            for hi in range(1, len(keys) + 1):
                if hi < len(keys) and keys[hi] == keys[lo]:
                    continue
                turns, marks, faults = d["turn"][lo:hi], d["initial"][lo:hi], d["fault"][lo:hi]
                known = [t for t in turns if t is not None]
                cell = parse([leaf(i, f) for i, f in zip(marks, faults)])
                out.append({
                    "key": keys[lo], "turn": turns[0], "id": d["id"][lo], "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
                    "turns": sum(a != b for a, b in zip(known, known[1:])) + bool(known), "first": marks[0], "last": marks[-1],
                    "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                    "illegal": sum(a + b not in LEGAL for a, b in zip(marks, marks[1:])),
                    "cell": [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]})
                lo = hi
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return light.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _SEGMENT)


_SEGMENT = ("key string, turn long, id long, first_turn long, last_turn long, turns long, first string, last string, blank long, duplicate long, "
            "truncated long, illegal long, cell array<struct<p:int,q:int,cost:long,audit:string>>")
_ARROW = pa.schema([
    *[(n, pa.string() if n in ("key", "first", "last") else pa.int64()) for n in
      "key turn id first_turn last_turn turns first last blank duplicate truncated illegal".split()],
    ("cell", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What the stream holds of the conversation that it is at."""

    def __init__(self, key: str) -> None:
        self.key, self.cell, self.walk = key, None, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.last, self.turns, self.low, self.high = None, 0, None, None
        self.hash, self.rows = hashlib.sha256(), 0
        self.cost, self.audit = 0, ""

    def add(self, s: dict) -> None:
        for c in self.counts:
            self.counts[c] += s[c]
        self.counts["illegal"] += self.last is not None and self.last + s["first"] not in LEGAL
        self.last = s["last"]
        if s["turns"]:
            self.turns += s["turns"] - (self.high == s["first_turn"])
            self.low = s["first_turn"] if self.low is None else self.low
            self.high = s["last_turn"]
        cell = {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in s["cell"]}
        self.cell = cell if self.cell is None else join(self.cell, cell)

    def start(self) -> Walk:
        if self.walk is None:
            if self.cell is not None:
                self.cost, self.audit = best(self.cell)
            self.walk = Walk(self.audit)
        return self.walk

    def took(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.rows else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.rows += 1

    def result(self) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"key": self.key, "gaps": gaps, **self.counts, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.hash.hexdigest()}


def _stream(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, list]:
    """Conversation marks, cells and turns, sorted so that each conversation follows its mark and its cells."""
    rows = _prepared(turns)
    wide = rows.select("key", F.lit(2).alias("part"), "turn", "id", "role", "text", F.lit(None).cast(_segment_type(turns)).alias("s"))
    cells = _segments(rows).select("key", F.lit(1).alias("part"), "turn", "id", F.lit(None).alias("role"), F.lit(None).alias("text"),
                                   F.struct(*[c.split()[0] for c in _SEGMENT.split(", ")]).alias("s"))
    marks = ids.select(_key("conv_id").alias("key")).distinct().select(
        "key", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("id"), F.lit(None).alias("role"), F.lit(None).alias("text"),
        F.lit(None).cast(_segment_type(turns)).alias("s"))
    order = ["key", "part", F.asc_nulls_first("turn"), "id"]
    return marks.union(cells).union(wide).repartition("key").sortWithinPartitions(*order)


def _segment_type(df: DataFrame) -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in (c.split(" ", 1) for c in _SEGMENT.split(", "))) + ">"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, list, bool]]:
    """For each conversation of a sorted stream: its state, the repaired turns of a batch, and whether it ends there."""
    now, out = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if now is not None and r["key"] != now.key:
                out += [(x, e, t) for x, t, e in now.start().inserted()]
                yield now, out, True
                now, out = None, []
            if now is None:
                now = _Conversation(r["key"])
            if r["part"] == 1:
                now.add(r["s"])
            elif r["part"] == 2:
                out += [(x, e, t) for x, t, e in now.start().turn(r["role"], r["text"])]
        if now is not None and out:
            yield now, out, False
            out = []
    if now is not None:
        yield now, [(x, e, t) for x, t, e in now.start().inserted()], True


def _id(turns: DataFrame) -> Column:
    return F.when(F.col("key") != "n", F.expr("substring(key, 2)")).cast(turns.schema["conv_id"].dataType).alias("conv_id")


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: gaps, faults, the cost and audit of its cheapest repair, and the hash of the result.

    ``turns``: conv_id, turn, role, text. ``ids``: the conversations to report; those without turns give zeros.
    """
    schema = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in FIGURES], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for now, rows, ended in _conversations(batches):
            for role, _, text in rows:
                now.took(role, text)
            if ended:
                done.append(now.result())
            if len(done) >= 4096:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    figures = ", ".join(f"{c} long" for c in FIGURES)
    out = _stream(turns, turns if ids is None else ids).mapInArrow(run, f"key string, {figures}, audit string, repaired_sha256 string")
    return out.select(_id(turns), *FIGURES, "audit", "repaired_sha256")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, pos (from 0), role, text and edit (K, R or I)."""
    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, rows, _ in _conversations(batches):
            if rows:
                yield pa.RecordBatch.from_pylist([{"key": now.key, "pos": now.rows + i, "role": x, "text": t, "edit": e} for i, (x, e, t) in enumerate(rows)], schema=schema)
                now.rows += len(rows)

    out = _stream(turns, turns).mapInArrow(run, "key string, pos long, role string, text string, edit string")
    return out.select(_id(turns), "pos", "role", "text", "edit")
