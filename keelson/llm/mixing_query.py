"""op1: all documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.arrow_text import table
from keelson.llm.order_sample import mix


def op1_order_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_order_sample": op1_order_sample}

ORACLE = {"op1_order_sample": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
filled AS (  -- in the order in which a rising level fills them
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS pool,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM src),
level AS (SELECT max((pool - held) / w_left) AS lvl FROM filled),
planned AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, lvl * w) AS target FROM filled, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM planned),
keys AS (
  SELECT p.source, u, sum(size) AS words, any_value(target - whole * source_size) AS rest
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source GROUP BY p.source, u),
through AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY u) AS upto FROM keys),
cut AS (SELECT source, max(u) AS last FROM through WHERE rest > 0 AND upto - words / 2.0::DOUBLE <= rest GROUP BY source)
SELECT s.doc_id, s.size, p.source_size, p.target,
       (s.size * (whole + CASE WHEN s.u <= c.last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN cut c ON s.source IS NOT DISTINCT FROM c.source
"""}
