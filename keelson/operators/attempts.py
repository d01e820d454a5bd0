"""Screening attempts: enqueue, guard, queue, recovery, latest view and lifecycle."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import blank_to_null
from ..plans.ordering import first_per_key, keys_of

# report column -> JSON path of the latest-attempt view
REPORT_PATHS = {
    "identity_status": "$.identity_resolution.status",
    "confidence_score": "$.identity_resolution.confidence_score",
    "overall_risk": "$.kyc_assessment.overall_risk",
    "recommended_review": "$.kyc_assessment.recommended_review",
    "sanctions_status": "$.risk_screening.sanctions.status",
    "pep_status": "$.risk_screening.pep.status",
}


def with_report_paths(df: DataFrame, report: str = "report", paths: dict | None = None) -> DataFrame:
    """Add columns extracted from the report JSON."""
    return df.withColumns({
        out: F.get_json_object(F.col(report), path) for out, path in (paths or REPORT_PATHS).items()})


def latest(attempts: DataFrame, key: str = "lead_id", created: str = "created_at", tiebreak: str = "id",
           report: str | None = "report", paths: dict | None = None) -> DataFrame:
    """Latest attempt per lead; the paths are read from the surviving rows only."""
    out = first_per_key(attempts, [key], [F.col(created).desc(), F.col(tiebreak).desc()])
    return with_report_paths(out, report, paths) if report else out


def enqueue(leads: DataFrame, now: Column, trigger: str = "new_lead", key: str = "id",
            name: str = "contact_display_name", email: str = "contact_email",
            country: str = "contact_country") -> DataFrame:
    """One attempt per lead: pending when name and e-mail are filled, else insufficient_data."""
    ready = blank_to_null(F.col(name)).isNotNull() & blank_to_null(F.col(email)).isNotNull()

    def text(c):
        return F.coalesce(F.col(c), F.lit(""))

    return leads.select(
        F.col(key).alias("lead_id"),
        F.when(ready, "pending").otherwise("insufficient_data").alias("status"),
        F.lit(trigger).alias("trigger_source"),
        F.struct(
            text(name).alias("full_name"), text(email).alias("email"), F.lit("").alias("company_name"),
            text(country).alias("country"), F.lit("").alias("city")).alias("query_input"),
        F.lit(0).alias("retry_count"),
        now.alias("requested_at"),
        F.when(~ready, now).alias("completed_at"),
    )


def backfill(leads: DataFrame, attempts: DataFrame, now: Column, key: str = "id", **columns) -> DataFrame:
    """Attempts for the leads that have none."""
    screened = keys_of(attempts, ["lead_id"]).withColumnRenamed("lead_id", key)
    missing = leads.join(screened, key, "left_anti")
    return enqueue(missing, now, "manual", key, **columns)


def guard_one_active(requests: DataFrame, attempts: DataFrame, ordinal: str, key: str = "lead_id",
                     status: str = "status") -> DataFrame:
    """First request per lead, none for a lead with a pending or running attempt."""
    active = keys_of(attempts.filter(F.col(status).isin(*V.ACTIVE_STATUSES)), [key])
    # one request per lead before the join, so a lead asked for many times is no hot key
    return first_per_key(requests, [key], [F.col(ordinal)]).join(active, key, "left_anti")


def queue_head(attempts: DataFrame, n: int = 10, status: str = "status",
               requested: str = "requested_at", tiebreak: str = "id") -> DataFrame:
    """Oldest pending attempts."""
    return attempts.filter(F.col(status) == "pending").orderBy(requested, tiebreak).limit(n)


def claim(attempts: DataFrame, claimed: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Pending attempts named by ``claimed`` become running; everything else is unchanged."""
    marks = claimed.select(key).distinct().withColumn("_claimed", F.lit(True))
    df = attempts.join(marks, key, "left")
    hit = F.col("_claimed") & (F.col("status") == "pending")
    null = F.lit(None)
    return df.select(*[
        {
            "status": F.when(hit, "running").otherwise(F.col("status")),
            "started_at": F.when(hit, now).otherwise(F.col("started_at")),
            "completed_at": F.when(hit, null).otherwise(F.col("completed_at")),
            "error_code": F.when(hit, null).otherwise(F.col("error_code")),
            "error_message": F.when(hit, null).otherwise(F.col("error_message")),
            "retry_count": F.when(hit, F.coalesce(F.col("retry_count"), F.lit(0)) + 1)
            .otherwise(F.col("retry_count")),
        }.get(c, F.col(c)).alias(c)
        for c in attempts.columns
    ])


def recover_stale(attempts: DataFrame, now: Column, minutes: int = 30, max_retries: int = 3) -> DataFrame:
    """Running attempts older than the cut-off go back to pending while retries are left,
    else they fail; both carry the recovery error."""
    stale = F.coalesce(
        (F.col("status") == "running")
        & (F.col("started_at") < now - F.make_interval(mins=F.lit(minutes))), F.lit(False))
    retry = F.coalesce(F.col("retry_count"), F.lit(0)) < max_retries
    changed = {
        "status": F.when(retry, "pending").otherwise("failed"),
        "started_at": F.lit(None).cast("timestamp"),
        "completed_at": F.when(~retry, now),
        "error_code": F.lit(V.STALE_ERROR),
        "error_message": F.lit(V.STALE_MESSAGE),
    }
    return attempts.withColumn("_stale", stale).withColumns({
        c: F.when(F.col("_stale"), new).otherwise(F.col(c))
        for c, new in changed.items() if c in attempts.columns
    }).withColumnRenamed("_stale", "recovered")


# --- lifecycle -------------------------------------------------------------
# A transition maps each state to the next one, and maps compose.  So a long event
# sequence is cut into blocks of ordinals, every block folded to one small map, and the
# maps folded level by level, so that no task sees more than one block of an attempt's
# events or maps, however sparse its ordinals are.

ACTIONS = ("claim", "complete", "insufficient", "fail", "cancel")


@lru_cache(maxsize=None)
def lifecycle_states(max_retries: int) -> tuple[tuple[str, int], ...]:
    """All (status, retry_count) an attempt can be in."""
    states = [("pending", r) for r in range(max_retries + 1)]
    for status in ("running", "completed", "insufficient_data", "failed", "cancelled"):
        states += [(status, r) for r in range(max_retries + 1)]
    return tuple(states)


def next_state(state: tuple[str, int], action: str, max_retries: int) -> tuple[str, int]:
    """Conditional update: an action that does not fit the status changes nothing."""
    status, retries = state
    if action == "claim" and status == "pending" and retries < max_retries:
        return "running", retries + 1
    if status == "running":
        if action == "complete":
            return "completed", retries
        if action == "insufficient":
            return "insufficient_data", retries
        if action == "fail":
            return ("pending" if retries < max_retries else "failed"), retries
    if action == "cancel" and status in V.ACTIVE_STATUSES:
        return "cancelled", retries
    return state


@lru_cache(maxsize=None)
def _transition_table(max_retries: int) -> tuple[tuple[int, ...], ...]:
    states = lifecycle_states(max_retries)
    index = {s: i + 1 for i, s in enumerate(states)}
    return tuple(
        tuple(index[next_state(s, action, max_retries)] for s in states) for action in ACTIONS)


def lifecycle_maps(events: DataFrame, key: str, ordinal: str, action: str, max_retries: int = 3,
                   block: int = 4096) -> DataFrame:
    """(key, events, _map): number of events of every attempt, and where they lead from each state.

    ``ordinal`` is an integer, unique per attempt; unknown actions change nothing.
    """
    states = lifecycle_states(max_retries)
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in _transition_table(max_retries)])
    identity = F.array(*[F.lit(i + 1) for i in range(len(states))])
    code = F.coalesce(*[F.when(F.col(action) == a, F.lit(i + 1)) for i, a in enumerate(ACTIONS)])

    def compose(first: Column, second: Column) -> Column:
        return F.transform(first, lambda s: F.element_at(second, s))

    def fold(ordered: Column, as_map) -> Column:
        return F.aggregate(ordered, identity, lambda acc, item: compose(acc, as_map(item)))

    span = events.agg(F.min(ordinal).alias("low"), F.max(ordinal).alias("high")).first()
    low = span["low"] or 0
    blocks = (
        events.withColumn("_code", code)
        .withColumn("_block", F.floor((F.col(ordinal) - F.lit(low)) / F.lit(block)))
        .groupBy(key, "_block")
        .agg(F.count(F.lit(1)).alias("_events"),
             F.array_sort(F.collect_list(F.when(
                 F.col("_code").isNotNull(), F.struct(F.col(ordinal).alias("o"), F.col("_code").alias("c"))
             ))).alias("_list"))
        .withColumn("_map", fold(F.col("_list"), lambda e: F.element_at(table, e["c"])))
        .drop("_list")
    )

    def joined(maps: DataFrame, *keys: str) -> DataFrame:
        """One map for the blocks that share the keys, at most ``block`` of them."""
        return maps.groupBy(*keys).agg(
            F.sum("_events").alias("_events"),
            F.array_sort(F.collect_list(F.struct("_at", "_map"))).alias("_maps")
        ).withColumn("_map", fold(F.col("_maps"), lambda m: m["_map"])).drop("_maps")

    left = ((span["high"] or 0) - low) // block + 1
    while left > block:
        blocks = joined(blocks.withColumnRenamed("_block", "_at").withColumn(
            "_block", F.floor(F.col("_at") / F.lit(block))), key, "_block")
        left = -(-left // block)
    return joined(blocks.withColumnRenamed("_block", "_at"), key).withColumnRenamed("_events", "events")


def _state_columns(number: Column, max_retries: int) -> list[Column]:
    states = lifecycle_states(max_retries)
    return [F.element_at(F.array(*[F.lit(s) for s, _ in states]), number).alias("status"),
            F.element_at(F.array(*[F.lit(r) for _, r in states]), number).alias("retry_count")]


def lifecycle(events: DataFrame, key: str, ordinal: str, action: str, max_retries: int = 3,
              block: int = 4096) -> DataFrame:
    """Final (status, retry_count) of every attempt after its ordered events."""
    maps = lifecycle_maps(events, key, ordinal, action, max_retries, block)
    return maps.select(key, "events", *_state_columns(F.element_at("_map", 1), max_retries))


def advanced(states: DataFrame, maps: DataFrame, key: str, max_retries: int = 3) -> DataFrame:
    """(key, events, status, retry_count) of stored attempts after further events, given as maps; an attempt that is not
    stored begins as pending.  Attempts without further events stay as they are."""
    known = F.array(*[F.lit(f"{s}/{r}") for s, r in lifecycle_states(max_retries)])
    old = states.select(F.col(key).alias("_old"), F.col("events").alias("_before"), F.concat_ws(
        "/", "status", F.col("retry_count").cast("string")).alias("_state"), F.lit(True).alias("_there"))
    both = old.join(maps, F.col("_old").eqNullSafe(F.col(key)), "full")
    at = F.greatest(F.coalesce(F.array_position(known, F.col("_state")), F.lit(1)), F.lit(1)).cast("int")
    end = F.when(F.col("_map").isNull(), at).otherwise(F.element_at("_map", at))
    return both.select(
        F.when(F.col("_there"), F.col("_old")).otherwise(F.col(key)).alias(key),
        (F.coalesce("_before", F.lit(0)) + F.coalesce("events", F.lit(0))).alias("events"), *_state_columns(end, max_retries))


def job_status(review: Column, full_name: Column) -> Column:
    """Stored status of a finished attempt."""
    return F.when(F.coalesce(full_name, F.lit("")) == "", "insufficient_data").when(
        review == "insufficient_data", "insufficient_data").otherwise("completed")
