"""The queries of this subpackage and their SQL; each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, editprint, html, langid, neardup, quality, secrets, sharding, toxicity
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.fingerprinted(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_html_extraction, op3_fingerprints, op4_quality, op5_toxicity, op6_bpe, op7_near_dedup, op8_secret_scan, op9_language_id, op10_sharding)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(5, len(w)) AS m FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(list_transform(range(0, len(w) - least(5, len(w)) + 1), lambda i: array_to_string(w[i + 1:i + least(5, len(w))], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
x AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(0, len(w) - m + 1)), lambda i: array_to_string(w[i + 1:i + m], ' '))) AS s FROM d, lengths)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM x JOIN q USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""

OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(1, len(w) - 3)), lambda i: array_to_string(w[i + 1:i + 4], ' '))) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM common c JOIN n na ON c.a = na.doc_id JOIN n nb ON c.b = nb.doc_id WHERE 100 * k >= 80 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN least_of ON documents.doc_id = least_of.a LEFT JOIN n ON documents.doc_id = n.doc_id
"""

OP10_SQL = f"""
WITH r AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
p AS (SELECT doc_id, n_bytes, depth, h >> ({sharding.BITS} - depth) AS prefix FROM r, (SELECT unnest(range(0, 31)) AS depth)),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY depth, prefix),
f AS (SELECT p.*, s.shard_bytes, s.shard_rows, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM p JOIN s USING (depth, prefix) WHERE s.shard_bytes <= {sharding.LIMIT})
SELECT doc_id, n_bytes, depth::INTEGER AS depth, 'b' || CASE WHEN depth > 0 THEN lpad(bin(prefix), depth::INTEGER, '0') ELSE '' END AS shard_id, shard_bytes, shard_rows, FALSE AS oversize FROM f WHERE k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op7_near_dedup": OP7_SQL, "op10_sharding": OP10_SQL}
