"""Streaming jobs over the supplied tables, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.attempts import latest
from ..session import fresh_path
from ..sources import batchlog, filed
from ..streaming import counter, intake, lifecycle
from . import attempts as AW
from . import leads as LW
from . import roles
from .roles import table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def stream(spark, sf, name):
    """A supplied table as a file stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def folders(spark):
    base = fresh_path(spark, "stream")
    return f"{base}/out", f"{base}/checkpoint"


def finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


@query("stream_counter", f"""
SELECT user_id AS broker_id, count(*) FILTER (WHERE event_type = 'signup') AS new_leads, count(*) AS total_leads FROM events GROUP BY user_id""")
def stream_counter(spark, sf):
    out, checkpoint = folders(spark)
    leads = stream(spark, sf, "events").selectExpr(
        "user_id AS broker_id", "CASE WHEN event_type = 'signup' THEN 'NEW' ELSE 'CONTACTED' END AS status")
    finish(counter.counter_stream(leads, out, checkpoint))
    return counter.current(spark, out)


_DOC = """to_json(named_struct('lead', named_struct('id', CASE WHEN event_id % 31 = 0 THEN '' ELSE CAST(event_id - event_id % 5 AS STRING) END, 'source', event_type),
  'contact', named_struct('name', named_struct('display', concat('User ', CAST(user_id AS STRING))), 'email', CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('u', CAST(user_id AS STRING), '@x.example') END),
  'recipient', named_struct('officeName', 'O', 'officeId', '1', 'contactName', concat('nation_', CAST(user_id % 30 AS STRING)))))"""


@query("stream_intake", """
WITH v AS (SELECT event_id, user_id, event_type, event_id - event_id % 5 AS id FROM events WHERE event_id % 31 <> 0),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id) = 1)
SELECT CAST(id AS VARCHAR) AS source_lead_id, n_nationkey AS broker_id, concat('User ', user_id) AS contact,
  CASE WHEN user_id % 3 = 0 THEN 'insufficient_data' ELSE 'pending' END AS attempt_status
FROM f LEFT JOIN nation ON lower(n_name) = concat('nation_', user_id % 30)""")
def stream_intake(spark, sf):
    out, checkpoint = folders(spark)
    docs = stream(spark, sf, "events").selectExpr("event_id AS ordinal", f"{_DOC} AS value")
    aliases = table(spark, sf, "nation").selectExpr("'no alias' AS alias_key", "'none@one.example' AS email")
    now = F.lit(LW.NOW).cast("timestamp")
    finish(intake.intake_stream(docs, out, checkpoint, roles.brokers(spark, sf), aliases, now))
    leads = batchlog.read(spark, f"{out}/leads")
    attempts = batchlog.read(spark, f"{out}/attempts").select(
        F.col("lead_id").alias("source_lead_id"), F.col("status").alias("attempt_status"))
    return leads.join(attempts, "source_lead_id", "left").select(
        "source_lead_id", "broker_id", F.col("contact_display_name").alias("contact"), "attempt_status")


@query("stream_lifecycle", AW.ORACLE["attempt_lifecycle"])
def stream_lifecycle(spark, sf):
    out, checkpoint = folders(spark)
    events = stream(spark, sf, "events").selectExpr(
        "concat(CAST(user_id AS STRING), '-', CAST(event_id % 4 AS STRING)) AS id", "event_id AS ordinal", f"{AW.ACTION} AS action")
    finish(lifecycle.lifecycle_table(events, out, checkpoint))
    return filed.read(spark, out)


def changes_of(spark, states, out, checkpoint):
    """The last of the rows a stream of changing states gave for every attempt."""
    def run(batch, batch_id):
        batchlog.append(batch.withColumn("batch_id", F.lit(batch_id)), out, batch_id)

    finish(states.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint))
    return latest(batchlog.read(spark, out), "id", "batch_id", "events", report=None)


STALE_MINUTES = 1440


# a running attempt without an event for a day is recovered: before its next event, or by the last watermark
@query("stream_recovery", f"""
WITH RECURSIVE e AS (
  SELECT concat(CAST(user_id AS VARCHAR), '-', CAST(event_id % 4 AS VARCHAR)) AS id, {AW.ACTION} AS a, epoch_ms(ts) AS t,
    row_number() OVER w AS rn, coalesce(epoch_ms(ts) - lag(epoch_ms(ts)) OVER w > {STALE_MINUTES * 60_000}, false) AS stale
  FROM events WINDOW w AS (PARTITION BY user_id, event_id % 4 ORDER BY epoch_ms(ts), event_id)),
s AS (
  SELECT DISTINCT id, CAST(0 AS BIGINT) AS rn, 'pending' AS st, 0 AS r, CAST(0 AS BIGINT) AS t FROM e
  UNION ALL
  SELECT id, rn,
    CASE WHEN a = 'claim' AND st = 'pending' THEN 'running' WHEN a = 'complete' AND st = 'running' THEN 'completed'
      WHEN a = 'fail' AND st = 'running' THEN CASE WHEN r < 3 THEN 'pending' ELSE 'failed' END ELSE st END,
    CASE WHEN a = 'claim' AND st = 'pending' THEN r + 1 ELSE r END, t
  FROM (SELECT s.id, e.rn, a, r, e.t,
      CASE WHEN stale AND st = 'running' THEN CASE WHEN r < 3 THEN 'pending' ELSE 'failed' END ELSE st END AS st
    FROM s JOIN e ON e.id = s.id AND e.rn = s.rn + 1)),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY rn DESC) = 1),
m AS (SELECT max(epoch_ms(ts)) AS mark FROM events)
SELECT id, rn AS events, r AS retry_count,
  CASE WHEN st = 'running' AND t + {STALE_MINUTES * 60_000} < mark THEN CASE WHEN r < 3 THEN 'pending' ELSE 'failed' END ELSE st END AS status
FROM l, m""")
def stream_recovery(spark, sf):
    out, checkpoint = folders(spark)
    events = stream(spark, sf, "events").selectExpr(
        "concat(CAST(user_id AS STRING), '-', CAST(event_id % 4 AS STRING)) AS id", "event_id AS ordinal", f"{AW.ACTION} AS action",
        "CAST(ts AS TIMESTAMP) AS ts")
    states = lifecycle.recovery_stream(events, STALE_MINUTES)
    return changes_of(spark, states, out, checkpoint).select("id", "events", "retry_count", "status")
