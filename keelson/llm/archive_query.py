"""op2: pages written to WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.archive import page_of, round_trip
from keelson.llm.arrow_text import table


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select(
        page_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        "record_type", page_of("refers_to").alias("refers_to"))


QUERIES = {"op2_warc": op2_warc}

ORACLE = {"op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
w AS (SELECT hex, max(page_id) AS winner FROM p GROUP BY hex)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex || '00', (5 * i) // 4 + 1, 3))::INT >> (7 - (5 * i) % 4)) & 31)::INT + 1, 1)
         for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM p JOIN w USING (hex)
"""}
