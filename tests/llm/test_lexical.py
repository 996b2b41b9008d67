"""Ranked lexical search against exact scores of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tallyaudit.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, score int, h string"


def plain_terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(docs, items, k=50):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            if c:
                m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if c[t])
                if s > 0:
                    scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in lexical.search(d, q, **how).collect()), key=str)


def prose(rng, n):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 400)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BATCH_TERMS", 60)
    rng = np.random.default_rng(3)
    docs = [(i, prose(rng, int(rng.integers(1, 120)))) for i in range(300)]
    docs += [(None, prose(rng, 40)), (2**53 + 1, docs[5][1]), (400, None), (401, ""), (402, "... --"), (403, "w1 " * 5000), (404, prose(rng, 20000))]
    docs += [docs[7], docs[7], (None, docs[7][1])] + [(500 + i, docs[9][1]) for i in range(80)]  # repeated rows; ties beyond k
    items = [(i, prose(rng, 25)) for i in range(10)] + [(3, "W1! Éa W2"), (None, "w1 w3"), (11, docs[9][1]), (12, None), (13, "unheard of"), (14, "?")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_terms_are_split_alike(spark):
    texts = ["A-Z a_z é'É ÀB1", "İstanbulİ ß", "tab\tnul\x00x~y\x7fz", " nbsp line", "漢字 かな"]
    assert [[x.decode() for x in lexical.terms(t.encode())] for t in texts] == [plain_terms(t) for t in texts]


def test_bounds_hold():
    """No lookup lies below the exact score, and without collisions they agree for small frequencies."""
    rng = np.random.default_rng(5)
    docs = [Counter(plain_terms(prose(rng, n))) for n in (5, 60, 500, 5000)]
    docs.append(Counter({"w1": 300_000, "w2": 1}))
    batch = lexical.Batch([(i, [f"w{x}".encode() for x in rng.choice(400, 30, replace=False)]) for i in range(20)])
    batch.weights = rng.integers(0, 9000, len(batch.names))
    n_terms = sum(sum(c.values()) for c in docs)
    import zlib
    for c in docs:
        for width in (16, 1024):
            cell = {}
            for t, tf in c.items():
                at = zlib.crc32(t.encode()) % width
                cell[at] = max(cell.get(at, 0), int(np.searchsorted(lexical._UPPER, tf)))
            at, code = np.array(sorted(cell), np.uint32).tobytes(), bytes(cell[a] for a in sorted(cell))
            got = lexical._bounds(batch, 5, n_terms, [sum(c.values())], width, [at], [code])[0]
            m = lexical.norm(sum(c.values()), 5, n_terms)
            for q in range(20):
                exact = sum(int(batch.weights[i]) * lexical.impact(c[batch.names[i].decode()], m) for i in batch.terms_of(q) if batch.names[i].decode() in c)
                assert got[q] >= exact


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a b")], []), ([(1, None)], [(1, "a")]), ([(1, "a b")], [(1, None)])])
def test_nothing_to_find(spark, docs, items):
    assert found(spark, docs, items) == brute(docs, items)


def test_result_types(spark):
    out = lexical.search(spark.createDataFrame([(1, "a", 0, "")], SCHEMA), spark.createDataFrame([], "item_id long, text string"))
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "bigint"]
