"""Live count of new leads per owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources import filed


def new_lead_counts(leads: DataFrame, owner: str = "broker_id", status: str = "status") -> DataFrame:
    """Works on a stream or a table."""
    return leads.groupBy(owner).agg(
        F.count_if(F.col(status) == "NEW").alias("new_leads"), F.count(F.lit(1)).alias("total_leads"))


def store_counts(batch: DataFrame, batch_id: int, path: str, owner: str = "broker_id", buckets: int = filed.BUCKETS) -> None:
    """Fold the changed owners of one batch into the table; a repeated batch changes nothing."""
    spark = batch.sparkSession
    rows = batch.persist()
    try:
        if filed.exists(spark, path):
            filed.upsert(spark, path, rows, mark=batch_id)
        else:
            filed.create(rows, path, owner, buckets, mark=batch_id)
    finally:
        rows.unpersist()


def counter_stream(leads: DataFrame, path: str, checkpoint: str, owner: str = "broker_id",
                   buckets: int = filed.BUCKETS) -> DataStreamWriter:
    """Every batch rewrites the buckets of the owners whose counts changed: one row an owner, and at most two
    folders a bucket, however long the stream runs."""
    def run(batch: DataFrame, batch_id: int) -> None:
        store_counts(batch, batch_id, path, owner, buckets)

    return new_lead_counts(leads, owner).writeStream.outputMode("update").foreachBatch(run).option(
        "checkpointLocation", checkpoint)


def current(spark, path: str) -> DataFrame:
    """Latest counts of every owner."""
    return filed.read(spark, path)
