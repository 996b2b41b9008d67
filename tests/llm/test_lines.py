"""Line deduplication against its SQL on random lines, and on names that clash."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallyaudit.llm import lines, quality, queries

NAMES = ("_doc", "_k", "_d", "_gone", "_id", "_cls", "_w", "_v0", "_n_lines", "_lines", "_t", "text_")


def random_docs(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" if i % 4 else f"v{i}x" for i in range(12)] + ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta"]
    plain = [w for w in words if not any(c.isdigit() for c in w)]
    pool = [" ".join(rng.choice(words if rng.random() < 0.5 else plain, int(rng.integers(1, 30)))) for _ in range(40)]
    docs = []
    for i in range(70):
        own = [" ".join(f"{a}{i}q" if rng.random() < 0.3 else a for a in rng.choice(plain, int(rng.integers(1, 30)))) for _ in range(int(rng.integers(0, 6)))]
        shared = [str(x) for x in rng.choice(pool, int(rng.integers(0, 8)))]
        rows = own + shared + ["", "  \t"][: int(rng.integers(0, 3))]
        rng.shuffle(rows)
        docs.append("\n".join(rows))
    for i in range(10):  # copies and near copies
        t = docs[i * 5].split("\n")
        docs.append("\n".join(t if i % 2 else ["changed start", *t[1:]]))
    long = ["\n".join(" ".join(rng.choice(plain, 25)) for _ in range(30)) for _ in range(4)]
    docs += long + [t.replace("alpha", "omega", 1) for t in long]
    return [(int(i), t) for i, t in enumerate([*docs, None, ""])]


@pytest.mark.parametrize("seed", range(4))
def test_random_lines_match_sql(spark, seed):
    rows = random_docs(seed)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, text FROM ({queries.ORACLE['op3_line_dedup']})").fetchall())
    out = lines.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == want and sum(r[2] for r in got) > 20


def test_scattered_changes_are_no_copy(spark):
    """Eighteen of twenty lines recur, but the shingles agree by less than document deduplication asks for."""
    rng = np.random.default_rng(1)
    ls = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(20)) for _ in range(22)]
    a, b = ls[:20], ls[:5] + [ls[20]] + ls[6:12] + [ls[21]] + ls[13:20]
    out = lines.drop_templates(spark.createDataFrame([(0, "\n".join(a)), (1, "\n".join(b))], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_dropped"] for r in out.collect()} == {0: 0, 1: 18}


def test_near_copies_stay_whole(spark):
    rng = np.random.default_rng(2)
    ls = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(20)) for _ in range(31)]
    out = lines.drop_templates(spark.createDataFrame([(0, "\n".join(ls[:30])), (1, "\n".join([*ls[:29], ls[30]]))], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_dropped"] for r in out.collect()} == {0: 0, 1: 0}


def test_clashing_names(spark):
    rows = random_docs(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = docs.selectExpr("*", *[f"doc_id AS {c}" for c in NAMES])
    out = lines.drop_templates(wide)
    assert out.columns == [*wide.columns, "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.select("doc_id", "n_dropped").collect())) == sorted(map(tuple, lines.drop_templates(docs).select("doc_id", "n_dropped").collect()))
    assert all(r[c] == r["doc_id"] for r in out.collect() for c in NAMES)
    good = quality.assess(wide)
    assert all(r[c] == r["doc_id"] for r in good.collect() for c in NAMES) and good.count() == len(rows)
