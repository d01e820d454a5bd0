"""op11: the cluster of every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.arrow_text import table
from keelson.llm.distance_matrix import clustered, with_inertia

ROUNDS = 5


def op11_incremental_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(table(spark, sf_dir, "embeddings"), rounds=ROUNDS)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {"op11_incremental_distance": op11_incremental_distance}


def _assign(r: int) -> str:
    return f"""
n{r} AS (
  SELECT v.k, c.cluster, list_inner_product(c.w, c.w) - 2 * list_inner_product(v.w, c.w) + v.vv AS distance
  FROM v, c{r} c),
a{r} AS (SELECT k, cluster, distance FROM n{r} QUALIFY row_number() OVER (PARTITION BY k ORDER BY distance, cluster) = 1)"""


def _move(r: int) -> str:
    return f"""
s{r} AS (
  SELECT cluster, i, sum(x::BIGINT) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(w) AS x, unnest(range(64)) AS i FROM a{r} JOIN v USING (k)) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS w FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT c{r}.cluster, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (cluster))"""


ORACLE = {"op11_incremental_distance": f"""
WITH kept AS (
  SELECT row_number() OVER () AS k, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS w FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (SELECT *, list_inner_product(w, w) AS vv FROM kept),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), w) - 1)::INT AS cluster, w
  FROM v QUALIFY cluster < 40),
{",".join(_assign(r) + "," + _move(r) for r in range(ROUNDS))},{_assign(ROUNDS)},
i AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY cluster)
SELECT v.vec_id, cluster, distance::BIGINT AS distance, cluster_inertia,
  (SELECT sum(distance)::BIGINT FROM a{ROUNDS}) AS inertia,
  sha256(array_to_string([x::BIGINT for x in c{ROUNDS}.w], ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (k) JOIN c{ROUNDS} USING (cluster) JOIN i USING (cluster)
"""}
