"""op9: every document without the passages that a smaller document has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.arrow_text import table
from keelson.llm.recompression import without_repeats


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), keep_text=False)


QUERIES = {"op9_recompression": op9_recompression}

ORACLE = {"op9_recompression": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT k, doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
windows AS (SELECT k, doc_id, p, hash(array_to_string(w[p:p + 12], ' ')) AS h FROM starts),
least AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h),
gone AS (SELECT DISTINCT k, q FROM (
  SELECT k, unnest(range(p, p + 13)) AS q FROM windows JOIN least USING (h) WHERE doc_id > m)),
n AS (SELECT k, list(q) AS qs, count(*) AS n_removed FROM gone GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n_removed IS NULL THEN array_to_string(w, ' ')
         ELSE array_to_string(list_where(w, [NOT list_contains(qs, i) for i in range(1, len(w) + 1)]), ' ') END) AS kept_sha256
FROM d LEFT JOIN n USING (k)
"""}
