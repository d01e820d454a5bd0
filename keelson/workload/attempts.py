"""Screening-attempt jobs on events (lead = user_id), orders and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import attempts as A
from ..operators.leads import with_latest_screening
from .roles import CUSTOMER_EMAIL, table

QUERIES, ORACLE = {}, {}
NOW = "2024-02-01 00:00:00"

STATUS = (
    "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'completed' "
    "WHEN 'error' THEN 'failed' ELSE 'insufficient_data' END")


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def attempts(spark, sf):
    """Events as attempts with a report made of their props."""
    return table(spark, sf, "events").selectExpr(
        "event_id AS id", "user_id AS lead_id", f"{STATUS} AS status", "ts AS created_at", "ts AS requested_at",
        "CAST(event_id % 5 AS INT) AS retry_count",
        "concat('{\"identity_resolution\": {\"status\": \"', event_type, '\", \"confidence_score\": ', get_json_object(props, '$.k'), "
        "'}, \"kyc_assessment\": {\"overall_risk\": \"low\", \"recommended_review\": \"', event_type, '\", \"key_reasons\": [\"r\"]}, "
        "\"sources\": [', CASE WHEN event_id % 2 = 0 THEN '{\"url\": \"a\"}, {\"url\": \"b\"}' ELSE '' END, ']}') AS report")


@query("latest_attempt", f"""
WITH l AS (SELECT *, CAST(props->>'$.k' AS DOUBLE) AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c_custkey AS id, {STATUS} AS kyc_status, event_type AS identity_status, k AS confidence_score,
  CASE WHEN event_id IS NOT NULL THEN 'low' END AS overall_risk, event_type AS recommended_review,
  CASE WHEN event_id IS NOT NULL THEN 'r' END AS reasons,
  CASE WHEN event_id % 2 = 0 THEN 2 WHEN event_id IS NOT NULL THEN 0 END AS source_count
FROM customer LEFT JOIN l ON user_id = c_custkey""".replace(
    STATUS + " AS kyc_status", "CASE WHEN event_id IS NOT NULL THEN " + STATUS + " END AS kyc_status"))
def latest_attempt(spark, sf):
    latest = A.latest(attempts(spark, sf))
    leads = table(spark, sf, "customer").selectExpr("c_custkey AS id")
    return with_latest_screening(leads, latest).withColumn("reasons", F.array_join("key_reasons", "|")).drop("key_reasons")


@query("one_active_guard", f"""
WITH active AS (SELECT DISTINCT user_id FROM events WHERE {STATUS} IN ('pending', 'running'))
SELECT o_custkey AS lead_id, min(o_orderkey) AS ordinal FROM orders
WHERE o_custkey NOT IN (SELECT user_id FROM active) GROUP BY o_custkey""")
def one_active_guard(spark, sf):
    requests = table(spark, sf, "orders").selectExpr("o_custkey AS lead_id", "o_orderkey AS ordinal")
    return A.guard_one_active(requests, attempts(spark, sf), "ordinal")


@query("queue_head", """
SELECT event_id AS id, user_id AS lead_id FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 10""")
def queue_head(spark, sf):
    return A.queue_head(attempts(spark, sf)).select("id", "lead_id")


_PATCHED = f"({STATUS} = 'running' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 MINUTE)"


@query("stale_recovery", f"""
SELECT event_id AS id, CASE WHEN NOT {_PATCHED} THEN {STATUS} WHEN event_id % 5 < 3 THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN NOT {_PATCHED} THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS started_at,
  CASE WHEN {_PATCHED} AND event_id % 5 >= 3 THEN '2024-01-20 00:00:00' END AS completed_at,
  CASE WHEN {_PATCHED} THEN 'STALE_WORKER_RECOVERY' END AS error_code,
  CASE WHEN {_PATCHED} THEN '{V.STALE_MESSAGE}' END AS error_message, {_PATCHED} AS recovered FROM events""")
def stale_recovery(spark, sf):
    rows = attempts(spark, sf).selectExpr(
        "id", "status", "retry_count", "CAST(requested_at AS TIMESTAMP) AS started_at",
        "CAST(NULL AS TIMESTAMP) AS completed_at", "CAST(NULL AS STRING) AS error_code", "CAST(NULL AS STRING) AS error_message")
    out = A.recover_stale(rows, F.lit("2024-01-20 00:00:00").cast("timestamp"), 30, 3)
    return out.select("id", "status", ts("started_at").alias("started_at"), ts("completed_at").alias("completed_at"),
                      "error_code", "error_message", "recovered")


ACTION = ("CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'fail' WHEN 'error' THEN 'fail' "
          "WHEN 'purchase' THEN (CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'noop' END) ELSE 'noop' END")


# four attempts per user, so that attempts of one user end differently
@query("attempt_lifecycle", f"""
WITH RECURSIVE e AS (
  SELECT concat(CAST(user_id AS VARCHAR), '-', CAST(event_id % 4 AS VARCHAR)) AS id, event_id, {ACTION} AS a,
    row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) AS rn FROM events),
s AS (
  SELECT DISTINCT id, CAST(0 AS BIGINT) AS rn, 'pending' AS st, 0 AS r FROM e
  UNION ALL
  SELECT s.id, e.rn,
    CASE WHEN a = 'claim' AND st = 'pending' THEN 'running' WHEN a = 'complete' AND st = 'running' THEN 'completed'
      WHEN a = 'fail' AND st = 'running' THEN CASE WHEN r < 3 THEN 'pending' ELSE 'failed' END ELSE st END,
    CASE WHEN a = 'claim' AND st = 'pending' THEN r + 1 ELSE r END
  FROM s JOIN e ON e.id = s.id AND e.rn = s.rn + 1)
SELECT id, rn AS events, st AS status, r AS retry_count FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY rn DESC) = 1""")
def attempt_lifecycle(spark, sf):
    events = table(spark, sf, "events").selectExpr(
        "concat(CAST(user_id AS STRING), '-', CAST(event_id % 4 AS STRING)) AS id", "event_id", f"{ACTION} AS action")
    return A.lifecycle(events, "id", "event_id", "action")


@query("backfill_missing", f"""
SELECT c_custkey AS lead_id, CASE WHEN trim({CUSTOMER_EMAIL}) <> '' THEN 'pending' ELSE 'insufficient_data' END AS status,
  'manual' AS trigger_source, c_name AS full_name, {CUSTOMER_EMAIL} AS email, CAST(c_nationkey AS VARCHAR) AS country,
  CASE WHEN trim({CUSTOMER_EMAIL}) <> '' THEN NULL ELSE '{NOW}' END AS completed_at
FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def backfill_missing(spark, sf):
    leads = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "c_name AS contact_display_name", f"{CUSTOMER_EMAIL} AS contact_email",
        "CAST(c_nationkey AS STRING) AS contact_country")
    out = A.backfill(leads, attempts(spark, sf), F.lit(NOW).cast("timestamp"))
    return out.select("lead_id", "status", "trigger_source", F.col("query_input.full_name").alias("full_name"),
                      F.col("query_input.email").alias("email"), F.col("query_input.country").alias("country"),
                      ts("completed_at").alias("completed_at"))


@query("claim_attempts", f"""
WITH head AS (SELECT event_id FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 10)
SELECT event_id AS id, CASE WHEN event_id IN (SELECT event_id FROM head) THEN 'running' ELSE {STATUS} END AS status,
  CASE WHEN event_id IN (SELECT event_id FROM head) THEN CAST(event_id % 5 AS INT) + 1 ELSE CAST(event_id % 5 AS INT) END AS retry_count FROM events""")
def claim_attempts(spark, sf):
    rows = attempts(spark, sf)
    full = rows.selectExpr("*", "CAST(NULL AS TIMESTAMP) AS started_at", "CAST(NULL AS TIMESTAMP) AS completed_at",
                           "CAST(NULL AS STRING) AS error_code", "CAST(NULL AS STRING) AS error_message")
    return A.claim(full, A.queue_head(rows), F.lit(NOW).cast("timestamp")).select("id", "status", "retry_count")


@query("outcome_counts", f"SELECT {STATUS} AS status, count(*) AS n FROM events GROUP BY 1")
def outcome_counts(spark, sf):
    from ..operators.validation import outcome_counts as counts
    return counts(attempts(spark, sf), "status")
