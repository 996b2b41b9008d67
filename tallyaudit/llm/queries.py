"""One registered query for each corpus operator, over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fingerprint, html, langid, lexical, lines, mixing, near_dedup, packing, pii, quality, repair, secrets
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), carry=["doc_id"])


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query
def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_templates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


@query
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(turns), turns)


#: The template tree in SQL, on the lines and texts themselves where the operator has hashes of them.
ORACLE["op3_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, text AS cls, pos, list_filter(regexp_split_to_array(arr[pos], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS raw
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS arr FROM documents), unnest(range(1, len(arr) + 1)) AS u(pos)
), masked AS (
    SELECT doc_id, cls, pos, raw, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS mask
    FROM lines WHERE len(raw) > 0
), fielded AS (
    SELECT *, CASE WHEN len(raw) < 5 AND len(list_filter(mask, lambda t: t <> '<*>')) = 0 THEN raw ELSE mask END AS tokens FROM masked
), leafed AS (
    SELECT doc_id, cls, pos, tokens, (len(tokens), CASE WHEN len(tokens) < 5 THEN tokens ELSE mask[1:3] END) AS leaf FROM fielded
), seen AS (
    SELECT leaf, tokens, cls, min(doc_id) AS doc_id FROM leafed GROUP BY ALL
), distinct_lines AS (
    SELECT leaf, tokens, count(*) AS n FROM seen GROUP BY ALL
), exploded AS (
    SELECT leaf, tokens, n, i, tokens[i] AS token FROM distinct_lines, unnest(range(1, len(tokens) + 1)) AS u(i)
), frequent AS (
    SELECT leaf, i, token FROM exploded WHERE token <> '<*>' GROUP BY ALL HAVING sum(n) >= 3
), forms AS (
    SELECT e.leaf, e.tokens, count(*) FILTER (e.token <> '<*>') AS words, CASE WHEN count(f.token) >= 0.7 * count(*)
        THEN list(coalesce(f.token, '<*>') ORDER BY e.i) ELSE list_prepend('=', e.tokens) END AS tpl
    FROM exploded e LEFT JOIN frequent f USING (leaf, i, token) GROUP BY e.leaf, e.tokens
), per_doc AS (
    SELECT leaf, tpl, cls, min(doc_id) AS doc_id, max(len(tokens)) AS n FROM seen JOIN forms USING (leaf, tokens) GROUP BY ALL
), recurring AS (
    SELECT leaf, tpl, arg_min(cls, doc_id) AS owner FROM per_doc GROUP BY ALL HAVING count(*) >= 3 * greatest(1, 6 - max(n))
), twice AS (
    SELECT leaf, tokens, arg_min(cls, doc_id) AS owner FROM seen GROUP BY ALL HAVING count(*) > 1
), owned AS (
    SELECT leaf, tokens, owner FROM forms JOIN recurring USING (leaf, tpl)
    UNION ALL
    SELECT leaf, tokens, owner FROM forms ANTI JOIN recurring USING (leaf, tpl) JOIN twice USING (leaf, tokens) WHERE words >= 20
), gone AS (
    SELECT doc_id, cls, list(pos) AS gone, sum(len(tokens)) AS lost, min(owner) AS owner, count(DISTINCT owner) AS owners
    FROM leafed JOIN owned USING (leaf, tokens) WHERE cls <> owner GROUP BY doc_id, cls
), lengths AS (
    SELECT doc_id, text, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents WHERE text IS NOT NULL
), pairs AS (
    SELECT g.doc_id, a.w AS wa, b.w AS wb FROM gone g JOIN lengths a ON a.doc_id = g.doc_id JOIN (SELECT text, any_value(w) AS w FROM lengths GROUP BY text) b ON b.text = g.owner
    WHERE owners = 1 AND lost >= 0.8 * len(a.w) AND lost >= 0.8 * (len(a.w) + len(b.w) - lost) AND g.owner NOT IN (SELECT cls FROM gone)
), shingled AS (
    SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(wa) - 4) + 1), lambda i: wa[i:i + 4])) AS sa,
        list_distinct(list_transform(range(1, greatest(1, len(wb) - 4) + 1), lambda i: wb[i:i + 4])) AS sb FROM pairs
), copies AS (
    SELECT doc_id FROM shingled WHERE 100 * len(list_intersect(sa, sb)) >= 80 * (len(sa) + len(sb) - len(list_intersect(sa, sb)))
), judged AS (
    SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS arr, CASE WHEN c.doc_id IS NULL THEN coalesce(gone, []) ELSE [] END AS gone
    FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id LEFT JOIN copies c ON c.doc_id = d.doc_id
)
SELECT doc_id, coalesce(len(arr), 0)::BIGINT AS n_lines, len(gone)::BIGINT AS n_dropped,
    CASE WHEN len(gone) = 0 THEN text
         ELSE array_to_string(list_transform(list_filter(range(1, len(arr) + 1), lambda i: NOT list_contains(gone, i)), lambda i: arr[i]), chr(10)) END AS text
FROM judged
"""

#: Scores of all documents for all items in exact arithmetic.
ORACLE["op12_ranked_search"] = r"""
WITH terms AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), counted AS (
    SELECT doc_id, t, count(*) AS tf, any_value(len(ts)) AS n FROM terms, unnest(ts) AS u(t) GROUP BY doc_id, t
), whole AS (
    SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM terms WHERE len(ts) > 0
), weights AS (
    SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole GROUP BY t, n_docs
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN weights USING (t) JOIN counted USING (t), whole GROUP BY item_id, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


#: Sketches cell by cell; likeness from the sets of digests themselves, where the operator recovers what differs.
ORACLE["op11_fingerprints"] = r"""
WITH ordered AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id), '') AS next_text FROM documents
), texts AS (
    SELECT doc_id, length(text) AS n_chars, text, next_text,
        concat(substr(text, 1, length(text) - length(text) // 2), substr(next_text, 1, length(text) // 2)) AS edited FROM ordered
), sides AS (
    SELECT doc_id, 'a' AS side, text AS t FROM texts UNION ALL SELECT doc_id, 'e', edited FROM texts UNION ALL SELECT doc_id, 'b', next_text FROM texts
), digests AS (
    SELECT DISTINCT doc_id, side, ('0x' || substr(md5(line), 1, 15))::BIGINT AS k
    FROM sides, unnest(string_split(t, chr(10))) AS u(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), filled AS (
    SELECT doc_id, side, t, (k >> (4 * t)) & 15 AS i, count(*) AS n, bit_xor(k) AS k, bit_xor(((k % 2147483647) * 1103515245 + 12345) % 4294967291) AS c
    FROM digests, range(3) AS r(t) GROUP BY ALL
), shown AS (
    SELECT s.doc_id, s.side, string_agg(coalesce(n::VARCHAR || ',' || printf('%x', f.k) || ',' || printf('%x', f.c), ''), ';' ORDER BY p.t, p.i) AS cells
    FROM (SELECT doc_id, side FROM sides) s CROSS JOIN (SELECT t, i FROM range(3) AS a(t), range(16) AS b(i)) p
    LEFT JOIN filled f ON f.doc_id = s.doc_id AND f.side = s.side AND f.t = p.t AND f.i = p.i GROUP BY ALL
), sizes AS (
    SELECT doc_id, side, count(*) AS n FROM digests GROUP BY ALL
), both_ AS (
    SELECT x.doc_id, y.side, count(*) AS common FROM digests x JOIN digests y ON x.doc_id = y.doc_id AND x.k = y.k AND x.side = 'a' AND y.side <> 'a' GROUP BY ALL
), likes AS (
    SELECT s.doc_id, s.side, CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) = 0 THEN 1.0::DOUBLE
        ELSE coalesce(c.common, 0)::DOUBLE / (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(c.common, 0)) END AS near
    FROM (SELECT doc_id, side FROM sides WHERE side <> 'a') s LEFT JOIN sizes a ON a.doc_id = s.doc_id AND a.side = 'a'
    LEFT JOIN sizes b ON b.doc_id = s.doc_id AND b.side = s.side LEFT JOIN both_ c ON c.doc_id = s.doc_id AND c.side = s.side
)
SELECT t.doc_id, t.n_chars, sha256(t.edited) AS edited_sha256,
    concat(coalesce(a.n, 0)::VARCHAR, ':', f.cells) AS fingerprint, concat(coalesce(e.n, 0)::VARCHAR, ':', g.cells) AS edited_fingerprint,
    le.near AS near_edited, ln.near AS near_next
FROM texts t JOIN shown f ON f.doc_id = t.doc_id AND f.side = 'a' JOIN shown g ON g.doc_id = t.doc_id AND g.side = 'e'
LEFT JOIN sizes a ON a.doc_id = t.doc_id AND a.side = 'a' LEFT JOIN sizes e ON e.doc_id = t.doc_id AND e.side = 'e'
JOIN likes le ON le.doc_id = t.doc_id AND le.side = 'e' JOIN likes ln ON ln.doc_id = t.doc_id AND ln.side = 'b'
"""
