"""op8: every page judged by URL rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.arrow_text import table
from keelson.llm.url_filter import judge

# fixed values: the rules of the query
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def rules(spark: SparkSession) -> DataFrame:
    values = ", ".join(str(r) for r in RULES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules(spark))


QUERIES = {"op8_url_filter": op8_url_filter}

ORACLE = {"op8_url_filter": """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, regexp_extract(coalesce(r, ''), '^[^/?#]*', 0) AS raw,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
seen AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
sites AS (SELECT DISTINCT host, path FROM seen),
best AS (
  SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM sites JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, seen.host, seen.path, rule, coalesce(verdict, 'allow') AS verdict
FROM seen LEFT JOIN best ON seen.host = best.host AND seen.path = best.path
"""}
