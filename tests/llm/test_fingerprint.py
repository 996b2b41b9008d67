"""Fingerprints against plain sets of paragraphs, and peeling at every size."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyaudit.llm import fingerprint as fp

WORD = re.compile(r"[^\x20\x09-\x0D]")


def digests(t):
    return {int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in (t or "").split("\n") if WORD.search(x)}


def alike(a, b):
    a, b = digests(a), digests(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    """Expected (doc_id, n_chars, edited_sha256, near_edited, near_next) of rows (doc_id, text) with distinct ids or equal texts."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for j, (i, t) in enumerate(rows):
        nxt = rows[(j + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), alike(t, e), alike(t, nxt)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next").collect()), key=str)


def page(rng, n):
    return "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(0, 6)))) for _ in range(n))


ROWS = [(5, "a b\nc d\n\ne"), (1, "a b\nc d\ne"), (9, None), (3, ""), (2, " \t\n "), (4, "é漢😀\nsecond one 😀😀"), (2**53 + 1, "x"), (-3, "one\none\ntwo")]


@pytest.mark.parametrize("run", [4096, 3])
def test_matches_plain_sets(spark, monkeypatch, run):
    monkeypatch.setattr(fp, "RUN", run)
    rng = np.random.default_rng(1)
    rows = ROWS + [(100 + 7 * i, page(rng, int(rng.integers(1, 40)))) for i in range(60)] + [(None, "no id\nat all")]
    rows += [(1000, page(rng, 900)), (1001, page(rng, 700)), (1002, "z " * 40000)] + [(2000, "again\nand again")] * 9
    df = spark.createDataFrame([(i, t, 1, "x", False) for i, t in rows], "doc_id long, text string, _row int, run string, guest boolean")
    assert result(fp.fingerprints(df.repartition(5))) == plain(rows)


def test_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(fp, "REPEATED", 20)
    monkeypatch.setattr(fp, "RUN", 2)
    rows = ROWS + [(50, "same\nrow")] * 300 + [(51, "other\nrow")] * 90 + [(52, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(fp.fingerprints(df)) == plain(rows)


def test_one_row_and_none(spark):
    for rows in ([(1, "a\nb c d")], []):
        assert result(fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_equal_texts_have_equal_fingerprints(spark):
    rng = np.random.default_rng(2)
    texts = [page(rng, 12) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[::-1])], "doc_id long, text string")
    out = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(df).collect()}
    assert [out[i] for i in range(20)] == [out[39 - i] for i in range(20)] and len({out[i] for i in range(20)}) == len(set(texts))


@pytest.mark.parametrize("level", [0, 1, 3])
def test_peeling_recovers_what_differs(spark, level):
    rng = np.random.default_rng(level)
    rows, want = [], []
    for i in range(120):
        both, a, b = (set(map(int, rng.integers(0, 2**60, n))) for n in rng.integers(0, 14, 3))
        rows.append((i, sorted(both | a), sorted(both | b)))
        want.append((sorted(a), sorted(b)))
    df = spark.createDataFrame(rows, "i long, a array<long>, b array<long>")
    got = df.select("i", fp.peel(fp.sketch(F.col("a"), level), fp.sketch(F.col("b"), level), level).alias("p")).select("i", "p.*").collect()
    right = sum(r["ok"] for r in got)
    assert all((sorted(r["only_a"]), sorted(r["only_b"])) == want[r["i"]] for r in got if r["ok"]) and right > 110


def test_larger_sketches_recover_all(spark):
    rng = np.random.default_rng(9)
    sets = [(set(map(int, rng.integers(0, 2**60, n))), set(map(int, rng.integers(0, 2**60, m)))) for n, m in ((0, 0), (30, 1), (400, 500), (3000, 0))]
    df = spark.createDataFrame([(i, sorted(a), sorted(b)) for i, (a, b) in enumerate(sets)], "i long, a array<long>, b array<long>")
    got = fp.differing(df, ["i"]).collect()
    assert sorted((r["i"], sorted(r["only_a"]), sorted(r["only_b"])) for r in got) == [(i, sorted(a), sorted(b)) for i, (a, b) in enumerate(sets)]
