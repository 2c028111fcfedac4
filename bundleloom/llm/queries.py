"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bundleloom.llm import ann, embed_dedup, license, mixing, pii, sentencepiece, simhash, substring, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark, sf_dir):
    return pii.digest(_table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark, sf_dir):
    return sentencepiece.digest(_table(spark, sf_dir, "documents"))


def op4_nearest(spark, sf_dir):
    return ann.digest(_table(spark, sf_dir, "embeddings"))


def op5_simhash(spark, sf_dir):
    return simhash.digest(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark, sf_dir):
    return embed_dedup.digest(_table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark, sf_dir):
    return substring.digest(_table(spark, sf_dir, "documents"))


def op7_license(spark, sf_dir):
    return license.digest(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark, sf_dir):
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_mixing, op3_sentencepiece, op4_nearest, op5_simhash, op6_embedding_dedup, op7_license, op8_url_filter, op9_substring_dedup, op10_toxicity)}
_OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT c.node AS vec_id, coalesce(n.k, 0) AS n_links, c.root AS component_id, c.node = c.root AS kept FROM c LEFT JOIN n ON c.node = n.a"""

_OP9_SQL = """
WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS r FROM p),
g AS (SELECT DISTINCT doc_id, s + i AS at FROM f, (SELECT unnest(generate_series(0, 19)) AS i) WHERE r > 1),
o AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS at FROM w),
k AS (SELECT o.doc_id, string_agg(o.ws[o.at], ' ' ORDER BY o.at) AS kept, count(*) AS n FROM o ANTI JOIN g ON o.doc_id = g.doc_id AND o.at = g.at GROUP BY o.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""

#: Where SQL can express a query's whole result.
SQL: dict[str, str] = {"op6_embedding_dedup": _OP6_SQL, "op7_license": license.SQL, "op9_substring_dedup": _OP9_SQL}
