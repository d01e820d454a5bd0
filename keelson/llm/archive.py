"""Pages to WARC records: one response for each payload, revisits for its copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.arrow_text import arrow_batches
from keelson.llm.warc import register
from keelson.session import fresh_path

URN = "urn:x-page:"


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            least_bytes: int = 0) -> DataFrame:
    """The record of every page: of equal payloads of ``least_bytes`` or more the largest page id is
    the response and the others revisit it; smaller payloads are responses.

    A null payload is empty.  A row without page id is never referred to, and is a response if no
    copy has an id.  Repeated rows of the winning id are responses all.  Only digests that occur
    more than once are joined back; AQE splits the partition of a digest with very many copies.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("_id"), F.col(url).alias("target_uri"),
                        F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumn("_digest", F.sha1("payload"))
    repeated = (rows.filter(F.octet_length("payload") >= least_bytes).groupBy("_digest")
                .agg(F.max("_id").alias("_winner"), F.count(F.lit(1)).alias("_n"))
                .filter((F.col("_n") > 1) & F.col("_winner").isNotNull()).drop("_n"))
    revisit = F.coalesce(~F.col("_id").eqNullSafe(F.col("_winner")) & F.col("_winner").isNotNull(), F.lit(False))
    return rows.join(repeated, "_digest", "left").select(
        F.concat(F.lit(URN), F.coalesce(F.col("_id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, F.concat(F.lit(URN), F.col("_winner").cast("string"))).alias("refers_to"), "payload")


def round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write the archive of ``pages`` (to the shared folder unless a path is given) and read it back
    with every payload checked against its digest."""
    spark = pages.sparkSession
    arrow_batches(spark)
    register(spark)
    path = path or fresh_path(spark, "warc")
    records(pages, **columns).write.format("warc").option("path", path).mode("append").save()
    return spark.read.format("warc").option("path", path).option("payload", "verify").load()


def page_of(urn: str) -> Column:
    return F.nullif(F.substring(urn, len(URN) + 1, 40), F.lit("")).cast("long")
