"""Ids keep every bit beside null ids, in every operator that passes rows through Python."""

import collections

import public_tokenizers
import pytest

import corpus_pipeline
from tallyaudit.llm import html, langid, mixing, near_dedup, packing, pii, secrets

BIG = 2**53 + 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TEXT = "The quick brown fox jumps over the lazy dog near the old river bank today."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG, TEXT, "en", "a", len(TEXT)), (None, TEXT + " Once more.", "en", "a", 0), (BIG + 2, None, None, None, None), (None, None, "en", "b", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


@pytest.mark.parametrize("run", [
    near_dedup.near_duplicates, pii.find_personal_data, secrets.find_secrets, langid.identify, mixing.mix, lambda d: packing.pack(d, TOKENIZER),
    lambda d: html.extract(d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"}), labelled=40).withColumnRenamed("page_id", "doc_id"),
])
def test_null_beside_large_ids(docs, run):
    out = run(docs)
    assert out.schema["doc_id"].dataType.simpleString() == "bigint"
    assert collections.Counter(r["doc_id"] for r in out.collect()) == {BIG: 1, BIG + 2: 1, None: 2}


def test_mix_itself(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {BIG, None}


def test_near_duplicates_name_components_by_ids(spark):
    rows = [(None, TEXT), (BIG, TEXT), (5, "other " + TEXT[4:]), (None, "alone in the world"), (None, "alone in the world"), (5, TEXT.upper())]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in out) == {
        (None, 5, False): 1, (BIG, 5, False): 1, (5, 5, True): 2, (None, None, True): 2}


def test_copies_are_confirmed(spark):
    """Two texts whose polynomial hashes agree for every odd base have no shingle in common and stay apart."""
    turn = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = (" ".join(f"u{i} {'ab'[t ^ flip]}" for i, t in enumerate(turn)) for flip in (0, 1))
    words = [" ".join("".join("ab"[t ^ flip] for t in turn[:1024]) + str(i) for i in range(9)) for flip in (0, 1)]
    rows = list(enumerate([a, b, *words]))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] for r in out)


def test_clashing_names(spark, docs):
    names = ("_row", "_doc", "_key", "_pieces", "_text_of_the_row")
    wide = docs.selectExpr("*", *[f"1 AS {c}" for c in names])
    assert mixing.mixed_documents(wide).columns == wide.columns
    kept = corpus_pipeline.keep_one(spark, wide, "")
    assert kept.columns == wide.columns and kept.count() == 3  # two of them are near copies


def test_packing_equals_the_tokenizer(spark):
    import numpy as np
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    parts = ["BELEDİYESİ,", "TÜRKİYE'DEKİ.", "İ", "i̇", ",", ".", " ", "\n", "é", "é", "É.", "ß,", "Σ", "ΣΑΣ.", "ж.", "漢", "a", "Z", "'s", "...", "<|endoftext|>", "ŉ.", "ǆ,", "ſ.", "K.", "Å,", "1.", "​", "़,", "가."]
    texts = ["BELEDİYESİ, ankara", "TÜRKİYE'DEKİ."] + ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(100_000)]
    tok = Tokenizer.from_file(TOKENIZER)
    encode, memo = packing._loaded(TOKENIZER)
    for t, e in zip(texts, tok.encode_batch_fast(texts, add_special_tokens=False)):
        chunks = t.replace("\n", " ").split(" ")
        packing._remember({c for c in chunks if c not in memo}, memo, encode)
        assert list(np.frombuffer(b"".join(memo[c] for c in chunks), "<u4")) == e.ids, t
