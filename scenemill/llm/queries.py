"""Queries of the corpus operators, bound to the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scenemill.llm.exact_dedup import exact_dedup
from scenemill.llm.language_id import identify_languages
from scenemill.llm.license_scan import scan_licenses
from scenemill.llm.order_minhash import compare_with_edits
from scenemill.llm.pareto_mix import pareto_mix
from scenemill.llm.pattern_packing import pack_documents
from scenemill.llm.secrets import secret_report
from scenemill.llm.simhash import simhash_near_duplicates
from scenemill.llm.token_output import token_output
from scenemill.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(_table(spark, sf_dir, "documents"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(_table(spark, sf_dir, "documents"))


#: The draw without bins: a running sum over each whole source.
OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
classed AS (SELECT *, length(bin(size)) AS class FROM sized),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n
  FROM sized GROUP BY source),
caps AS (
  SELECT source, source_size, 1.0::DOUBLE + n % 3 AS weight, source_size * 3.0::DOUBLE AS cap,
         sum(source_size) OVER ()::DOUBLE AS total FROM named),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM caps WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
levels AS (SELECT *, max(CASE WHEN (total - capped) / open * weight <= cap THEN (total - capped) / open END) OVER () AS level FROM filled),
targets AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM levels),
classes AS (SELECT source, class, sum(size)::BIGINT AS words FROM classed GROUP BY source, class),
ratios AS (
  SELECT c.*, t.source_size, t.target, floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS copies
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
rests AS (
  SELECT *, target - copies * source_size AS lacking,
         coalesce(sum(words) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure,
         sum(words * class) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM ratios WINDOW d AS (PARTITION BY source ORDER BY class DESC)),
ks AS (SELECT *, CASE WHEN rest > 0 THEN (lacking - sure) / rest END AS k FROM rests),
inclusion AS (
  SELECT source, class, copies, lacking, least(1.0::DOUBLE, coalesce(
    max(CASE WHEN k >= 0 AND k * class <= 1 THEN k END) OVER (PARTITION BY source) * class, 1.0::DOUBLE)) AS p FROM ks),
uniform AS (
  SELECT *, (('0x' || substr(md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
            / 4503599627370496.0::DOUBLE AS u FROM classed),
scored AS (
  SELECT u.doc_id, u.source, u.size, i.copies, i.lacking,
         CASE WHEN p >= 1 THEN 0.0::DOUBLE WHEN p <= 0 THEN 1.0::DOUBLE
              ELSE (u / (1.0::DOUBLE - u)) / ((u / (1.0::DOUBLE - u)) + p / (1.0::DOUBLE - p)) END AS score
  FROM uniform u JOIN inclusion i ON u.source IS NOT DISTINCT FROM i.source AND u.class = i.class),
ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY score, doc_id IS NULL, doc_id, size ROWS UNBOUNDED PRECEDING) AS words FROM scored)
SELECT r.doc_id, r.size, t.source_size, t.target,
       ((r.copies + CASE WHEN r.size > 0 AND lacking > 0 AND words - size + size / 2.0 <= lacking THEN 1 ELSE 0 END) * r.size)::BIGINT AS taken
FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
"""


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_bundles": op1_warc_bundles,
    "op2_order_minhash": op2_order_minhash,
    "op3_pareto_mix": op3_pareto_mix,
    "op4_simhash_neardup": op4_simhash_neardup,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_pattern_packing": op7_pattern_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_output": op9_token_output,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_pareto_mix": OP3_SQL,
    "op10_exact_dedup": OP10_SQL,
}
