"""Conversation repair against a search over all edit scripts' costs and plain statements of the counts."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from tallyaudit.llm import queries, repair

SF = "/root/testdata/sf0.001"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FORM = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        out += [(c, t, "user" if h == 4 else r, x)] * {0: 0, 3: 2}.get(h, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        last = x.strip(SPACE)[-1:]
        out.append("b" if not last else "d" if (r, x) in seen else "t" if last not in ".!?" else "")
        seen.add((r, x))
    return out


def shortest(rows, marks):
    """Least (cost, audit, roles) by dynamic programming along the turns, one automaton place at a time."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("p", "u"): "u", ("u", "a"): "p"}

    def inserted(best):
        todo = list(best.items())
        while todo:
            p, (c, a, rs) = todo.pop()
            for role, name in (("u", "user"), ("a", "assistant")):
                q = step.get((p, role))
                new = (c + 5, a + "I", (*rs, (None, name)))
                if q and (q not in best or new[:2] < best[q][:2]):
                    best[q] = new
                    todo.append((q, new))
        return best

    best = inserted({"": (0, "", ())})
    for i, ((_, _, role, _), m) in enumerate(zip(rows, marks)):
        new = {}

        def offer(q, value):
            if q not in new or value[:2] < new[q][:2]:
                new[q] = value

        for p, (c, a, rs) in best.items():
            offer(p, (c + 2, a + "D", rs))
            if m not in ("b", "d"):
                extra = 5 if m == "t" else 0
                if (p, role[:1]) in step:
                    offer(step[p, role[:1]], (c + extra, a + "K", (*rs, (i, role))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (p, r) in step:
                        offer(step[p, r], (c + extra + 1, a + "R", (*rs, (i, name))))
        best = inserted(new)
    return min((best[q] for q in ("", "p") if q in best), key=lambda v: v[:2])


def plain(rows, damaged=True):
    """Result of every conversation of rows (conv_id, turn, role, text)."""
    ids = list(dict.fromkeys(r[0] for r in rows))
    groups = collections.defaultdict(list)
    for r in plain_damage(rows) if damaged else rows:
        groups[r[0]].append(r)
    out = {}
    for i in ids:
        g = sorted(groups[i], key=lambda r: (r[1] is not None, r[1] or 0))
        f = faults(g)
        turns = [r[1] for r in g if r[1] is not None]
        cost, audit, roles = shortest(g, f) if g else (0, "", ())
        text = "\n".join(f"{name}:{'' if j is None else g[j][3]}" for j, name in roles)
        out[i] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("b"), f.count("d"), f.count("t"),
                  sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(g, g[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def result(df):
    rows = [tuple(r) for r in df.select("conv_id", *repair.FIGURES, "audit", "repaired_sha256").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_whole_table(spark):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pd.read_parquet(f"{SF}/conversations.parquet").itertuples(index=False)]
    assert result(queries.QUERIES["op13_conversation_repair"](spark, SF)) == plain(rows)


def random_rows(seed, n, ids):
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "No!", "cut off", "", " \t\n", None, "é. ", "x.\n"]
    rows = []
    for i in ids:
        for t in range(int(rng.integers(1, n))):
            turn = None if rng.random() < 0.05 else int(rng.integers(0, 40)) if rng.random() < 0.1 else t
            role = roles[int(rng.choice(7, p=[0.35, 0.35, 0.1, 0.05, 0.05, 0.05, 0.05]))]
            rows.append((i, turn, role, (f"Turn {t}." if rng.random() < 0.6 else texts[int(rng.integers(0, 8))])))
    return list({(r[0], r[1]): r for r in rows}.values())  # one row per turn: no ties


def test_odd_conversations(spark):
    rows = random_rows(1, 14, [*range(60), None, 2**53 + 1, -5])
    df = table(spark, rows)
    assert result(repair.repair(repair.damage(df), df)) == plain(rows)
    assert result(repair.repair(df)) == plain([(c, t, r or ("" if r == "" else " "), " " if x is None else x) for c, t, r, x in rows], damaged=False)


def test_one_conversation_over_many_tasks(spark):
    rows = [(7, t, ["user", "assistant", "system"][t * t % 7 % 3], f"Line {t % 900}" + ".?,"[t % 3]) for t in range(2500)]
    rows += [(8, 1, "user", "Hi."), (8, 2, "assistant", "Yes.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        assert result(repair.repair(table(spark, rows))) == plain(rows, damaged=False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_scripts():
    """The cell agrees with every possible edit script on short conversations."""
    for marks in itertools.product(["u", "a", "s", "x"], repeat=3):
        for f in ((0, 0, 0), (3, 0, 2), (0, 1, 3)):
            found = []
            for script in itertools.product(["", "u", "a", "ua", "au"], ["K", "Ru", "Ra", "D"], repeat=3):
                for tail in ("", "u", "a"):
                    cost, audit, form = 0, "", ""
                    for j, (ins, edit) in enumerate(zip(script[::2], script[1::2])):
                        cost, audit, form = cost + 5 * len(ins), audit + "I" * len(ins), form + ins
                        if f[j] in (1, 2) and edit != "D":
                            cost = 999
                        cost += {"K": 0, "R": 1, "D": 2}[edit[0]] + (5 if f[j] == 3 and edit != "D" else 0)
                        audit += edit[0]
                        form += {"K": marks[j], "D": ""}.get(edit, edit[-1])
                    if FORM.fullmatch(form + tail):
                        found.append((cost + 5 * len(tail), audit + "I" * len(tail)))
            assert repair.best(repair.parse([repair.leaf(m, x) for m, x in zip(marks, f)])) == min(found)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U."), (1, 3, "assistant", "B."), (2, 0, "user", "")]
    out = sorted(tuple(r) for r in repair.repaired_turns(table(spark, rows)).collect())
    assert out == [(1, 0, "user", "S.", "R"), (1, 1, "assistant", "A.", "K"), (1, 2, "user", "U.", "K"), (1, 3, "assistant", "B.", "K")]


@pytest.mark.parametrize("n", [0, 1])
def test_nothing_left(spark, n):
    rows = [(3, 5, None, None)][:n]
    df = table(spark, rows)
    out = result(repair.repair(df.limit(0), df))
    assert out == ({3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} if n else {})


def test_other_columns_and_repeated_rows(spark):
    rows = [(1, 0, "user", "Hi.", "a", 1), (1, 0, "user", "Hi.", "a", 1), (1, 1, "assistant", "Yo.", "b", 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, id int")
    assert result(repair.repair(df)) == plain([r[:4] for r in rows], damaged=False)
