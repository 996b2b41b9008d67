"""Stored documents read from files, and the scores of a saved model."""

import hashlib

import numpy as np

from tallyaudit.operators import model
from tallyaudit.plans import forensic_queries
from tallyaudit.sources import documents

FILES = {
    "a/acta_000123_e10.pdf": b"%PDF-1.7\n" + b"x" * 2000 + b"\n%%EOF\nstartxref\n%%EOF\n",
    "a/b/acta_004567_e15.pdf": b"%PDF-1.4\n%%EOF\n",
    "acta_9_e10.pdf": b"no document" + bytes(range(256)) * 8,
    "empty.pdf": b"",
    "notes.txt": b"%PDF-1.4 but of another kind",
}


def test_scan_of_stored_files(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r["path"].split(f"{tmp_path}/")[1]: r for r in documents.scan_documents(documents.read_documents(spark, str(tmp_path))).collect()}
    assert set(rows) == {n for n, content in FILES.items() if n.endswith(".pdf") and content}
    for name, r in rows.items():
        content = FILES[name]
        assert r["sha256"] == hashlib.sha256(content).hexdigest() and r["md5"] == hashlib.md5(content).hexdigest()
        assert r["size_bytes"] == len(content) and r["is_pdf"] == content.startswith(b"%PDF-") and r["reusable"] == (len(content) > 1024)
        assert r["file"] == name.split("/")[-1]
    assert (rows["a/acta_000123_e10.pdf"]["station"], rows["a/acta_000123_e10.pdf"]["contest_id"]) == ("000123", 10)
    assert rows["acta_9_e10.pdf"]["station"] is None and rows["acta_9_e10.pdf"]["contest_id"] is None


def test_scan_reads_no_content_it_does_not_need(spark, tmp_path):
    (tmp_path / "acta_000001_e10.pdf").write_bytes(b"%PDF-1.7")
    files = documents.read_documents(spark, str(tmp_path)).select("path", "length")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1] and files.first()["length"] == 8


def test_saved_model_scores_alike(spark, tmp_path):
    given = forensic_queries._given()
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 50, (40, len(model.FEATURES)))
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["sheet_id", *model.FEATURES])
    model.save_model(spark, given, str(tmp_path / "model"))
    want = {r["sheet_id"]: r["score"] for r in model.score(table, given).collect()}
    got = {r["sheet_id"]: r["score"] for r in model.score(table, model.load_model(spark, str(tmp_path / "model"))).collect()}
    assert got == want and np.allclose([want[i] for i in range(40)], given.decision(x))
