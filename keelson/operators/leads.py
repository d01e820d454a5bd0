"""Leads: parsing, flattening, routing, new-only insert, filters and the status funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V
from ..functions.text import display_name, fold, strip
from ..plans.barrier import fenced
from ..plans.ordering import first_per_key, keys_of
from ..schemas import LEAD_DOCUMENT
from .catalogue import contains_ci, unique_names


def parse_documents(raw: DataFrame, text: str = "value") -> DataFrame:
    """JSON lead documents to a nested column ``doc``; the original text is retained as
    ``raw_payload`` and an unreadable document ends up in ``corrupt``."""
    schema = T.StructType([*LEAD_DOCUMENT.fields, T.StructField("corrupt", T.StringType())])
    parsed = raw.withColumn("doc", F.from_json(
        F.col(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}))
    parsed = parsed.withColumn("raw_payload", F.col(text))
    # streams take no fence; nothing filters between parsing and keyed state there
    return (parsed if raw.isStreaming else fenced(parsed)).withColumn("corrupt", F.col("doc.corrupt"))


# flat lead column -> path in the document
PAYLOAD_COLUMNS = {
    "source_lead_id": "lead.id", "source": "lead.source", "detailed_source": "lead.detailedSource",
    "detailed_source_summary": "lead.detailedSourceSummary", "request_type": "lead.requestType",
    "contact_first_name": "contact.name.first", "contact_last_name": "contact.name.last",
    "contact_email": "contact.email", "contact_phone": "contact.phone",
    "contact_country": "contact.country", "boat_make": "boat.make", "boat_model": "boat.model",
    "boat_year": "boat.year", "boat_condition": "boat.condition",
    "boat_length_value": "boat.length.measure", "boat_length_units": "boat.length.units",
    "boat_price_amount": "boat.price.amount", "boat_price_currency": "boat.price.currency",
    "boat_url": "boat.url", "customer_comments": "customerComments",
    "lead_comments": "leadComments", "recipient_office_name": "recipient.officeName",
    "recipient_office_id": "recipient.officeId",
}


def flatten_documents(parsed: DataFrame, now: Column, keep: tuple = ()) -> DataFrame:
    """Nested documents to the flat lead columns; a missing date becomes ``now``."""
    doc = F.col("doc")
    name = doc["contact"]["name"]
    columns = [F.col(k) for k in keep]
    columns += [F.col(f"doc.{path}").alias(out) for out, path in PAYLOAD_COLUMNS.items()]
    columns += [
        F.coalesce(F.try_to_timestamp(F.nullif(doc["lead"]["date"], F.lit(""))), now).alias("lead_date"),
        display_name(name["display"], name["first"], name["last"], V.UNKNOWN_CONTACT)
        .alias("contact_display_name"),
        F.nullif(doc["recipient"]["contactName"], F.lit("")).alias("recipient_contact_name"),
        F.lit("NEW").alias("status"),
        F.col("raw_payload"),
    ]
    return parsed.select(*columns)


def history(parsed: DataFrame, keep: tuple = ()) -> DataFrame:
    """One row per past enquiry of a contact; leads without history keep one empty row."""
    return parsed.select(
        *keep, F.col("doc.lead.id").alias("source_lead_id"),
        F.posexplode_outer("doc.leadSmart.leadHistory").alias("position", "past"),
    ).select(
        *keep, "source_lead_id", "position", "past.make", "past.model", "past.year",
        "past.dateOfLead", "past.portalName", F.col("past.location.country").alias("country"),
    )


def route(
    leads: DataFrame, brokers: DataFrame, aliases: DataFrame, now: Column,
    domains: tuple[str, str] | None = None, recipient: str = "recipient_contact_name",
    name: str = "broker_name", key: str = "id", out: str = "broker_id",
) -> DataFrame:
    """Assign an owner in order: alias or recipient as e-mail (either of two equivalent
    domains), then recipient as broker name.  Every step needs exactly one match;
    otherwise the lead stays unassigned.  ``aliases``: (alias_key, email)."""
    raw = F.coalesce(F.col(recipient), F.lit(""))
    df = leads.withColumn("_alias", fold(raw, "recipient"))
    alias = first_per_key(aliases.select("alias_key", "email"), ["alias_key"], [F.col("email")]) \
        .select(F.col("alias_key").alias("_ak"), F.col("email").alias("_alias_email"))
    # a null key matches nothing and is spread; blank texts would meet in one task
    df = df.withColumn("_alias", F.nullif(F.col("_alias"), F.lit("")))
    df = df.join(alias, df["_alias"] == alias["_ak"], "left")
    first = F.coalesce(F.nullif(F.col("_alias_email"), F.lit("")), strip(raw))
    df = df.withColumn("_mail1", F.nullif(first, F.lit("")))
    second = F.lit(None).cast("string")
    if domains:
        a, b = domains
        second = (
            F.when(F.endswith(first, F.lit("@" + a)),
                   F.regexp_replace(first, "@" + a.replace(".", "\\.") + "$", "@" + b))
            .when(F.endswith(first, F.lit("@" + b)),
                  F.regexp_replace(first, "@" + b.replace(".", "\\.") + "$", "@" + a)))
    df = df.withColumn("_mail2", second)
    # one row per address, so the joins never multiply leads
    by_mail = brokers.groupBy(F.col("email").alias("_e")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(key).alias("_id"))
    for i in ("1", "2"):
        side = by_mail.select(F.col("_e").alias("_e" + i), F.col("_n").alias("_n" + i),
                              F.col("_id").alias("_id" + i))
        df = df.join(side, df["_mail" + i] == side["_e" + i], "left")
    names = unique_names(brokers, name, key)
    df = df.withColumn("_raw", F.nullif(F.lower(raw), F.lit(""))).join(
        names.select(F.col("_name"), F.col("_id").alias("_id3")), F.col("_raw") == F.col("_name"), "left")
    matches = F.coalesce(F.col("_n1"), F.lit(0)) + F.coalesce(F.col("_n2"), F.lit(0))
    by_email = F.when(matches == 1, F.coalesce(F.col("_id1"), F.col("_id2")))
    owner = F.coalesce(by_email, F.col("_id3"))
    drop = [c for c in df.columns if c.startswith("_")]
    return df.withColumn(out, owner).withColumn(
        "processed_at", F.when(F.col(out).isNotNull(), now)).drop(*drop)


def first_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per business key, the first to arrive."""
    return first_per_key(df, [key], [F.col(ordinal)])


def new_only(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return incoming.join(keys_of(stored, [key]), key, "left_anti")


def intake(raw: DataFrame, stored: DataFrame, brokers: DataFrame, aliases: DataFrame, now: Column,
           domains: tuple[str, str] | None = None, text: str = "value",
           ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """Whole intake of a batch: (new leads with owner, rejected documents)."""
    from .validation import lead_document_rules, split, with_errors

    checked = with_errors(parse_documents(raw, text), lead_document_rules())
    good, bad = split(checked)
    flat = flatten_documents(good, now, keep=(ordinal,))
    fresh = new_only(first_wins(flat, "source_lead_id", ordinal), stored, "source_lead_id")
    return route(fresh, brokers, aliases, now, domains), bad


def without_test_rows(df: DataFrame, id_column: str, email: str, name: str) -> DataFrame:
    """Drop the test records (prefix compared without case; missing values are kept)."""
    def is_true(c):
        return F.coalesce(c, F.lit(False))

    test = (
        is_true(F.startswith(F.upper(F.col(id_column)), F.lit(V.TEST_ID_PREFIX)))
        | is_true(F.col(email) == V.TEST_EMAIL)
        | is_true(F.col(name) == V.TEST_NAME)
    )
    return df.filter(~test)


def filter_leads(
    df: DataFrame, *, owner=None, status: str | None = None, search: str | None = None,
    source: str | None = None, date_from: str | None = None, date_to: str | None = None,
    columns: dict | None = None,
) -> DataFrame:
    """Tenant, status, text, source and date-range filters (each one optional)."""
    c = {
        "owner": "broker_id", "status": "status", "source": "source",
        "summary": "detailed_source_summary", "date": "received_at",
        "search": ("contact_display_name", "contact_email", "boat_make", "boat_model"),
        **(columns or {}),
    }
    if owner is not None:
        df = df.filter(F.col(c["owner"]) == owner)
    if status:
        df = df.filter(F.col(c["status"]) == status)
    if search:
        hit = F.lit(False)
        for column in c["search"]:
            hit = hit | contains_ci(F.col(column), search)
        df = df.filter(hit)
    if source:
        df = df.filter((F.col(c["summary"]) == source) | (F.col(c["source"]) == source))
    if date_from:
        df = df.filter(F.col(c["date"]) >= F.lit(date_from).cast("timestamp"))
    if date_to:
        df = df.filter(F.col(c["date"]) < F.lit(date_to).cast("timestamp") + F.expr("interval 1 day"))
    return df


def newest_first(df: DataFrame, received: str = "received_at", tiebreak: str = "id") -> DataFrame:
    return df.orderBy(F.col(received).desc(), F.col(tiebreak).asc())


def funnel(leads: DataFrame, owner: str = "broker_id", status: str = "status",
           received: str = "received_at", statuses: tuple = V.LEAD_STATUSES) -> DataFrame:
    """Per-owner totals, one count per status and the latest lead; null owner is a group."""
    counts = [
        F.count_if(F.col(status) == s).alias(f"{s.lower()}_leads") for s in statuses]
    return leads.groupBy(owner).agg(
        F.count(F.lit(1)).alias("total_leads"), *counts, F.max(received).alias("latest_lead_date"))


def zero_filled(brokers: DataFrame, stats: DataFrame, key: str = "id", owner: str = "broker_id") -> DataFrame:
    """Every broker with its funnel; brokers without leads get zeros and no date."""
    dim = brokers.withColumnRenamed(key, owner) if key != owner else brokers
    joined = dim.join(stats, owner, "left")
    zero = [c for c in stats.columns if c not in (owner, "latest_lead_date")]
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def conversion_rate(converted: Column, total: Column) -> Column:
    """Percentage with one decimal; 0 without leads."""
    return F.when(total > 0, F.round(converted / total * 100, 1)).otherwise(F.lit(0.0))


def with_latest_screening(leads: DataFrame, latest: DataFrame, key: str = "id") -> DataFrame:
    """Left join of the latest screening summary: score as number or null, reasons
    defaulting to an empty list, number of sources."""
    summary = latest.select(
        F.col("lead_id").alias("_lead"),
        F.col("status").alias("kyc_status"), F.col("identity_status"),
        F.col("confidence_score").try_cast("double").alias("confidence_score"),
        "overall_risk", "recommended_review",
        F.coalesce(F.from_json(F.get_json_object("report", "$.kyc_assessment.key_reasons"), "array<string>"),
                   F.array().cast("array<string>")).alias("key_reasons"),
        F.coalesce(F.json_array_length(F.get_json_object("report", "$.sources")), F.lit(0))
        .alias("source_count"),
    )
    return leads.join(summary, leads[key] == summary["_lead"], "left").drop("_lead")


def merge_funnels(stats: DataFrame, owner: str) -> DataFrame:
    """Combine funnels counted on a finer key into one funnel per owner."""
    sums = [c for c in stats.columns if c.endswith("_leads")]
    return stats.groupBy(owner).agg(
        *[F.sum(c).alias(c) for c in sums], F.max("latest_lead_date").alias("latest_lead_date"))


def manual_leads(rows: DataFrame, owner: Column, now: Column, ordinal: str = "ordinal") -> DataFrame:
    """Leads entered by hand: a ``MANUAL-`` id, defaults for source and request type, and
    the entering broker as owner."""
    return rows.withColumns({
        "source_lead_id": F.concat(
            F.lit("MANUAL-"), F.unix_millis(now).cast("string"), F.lit("-"), F.col(ordinal).cast("string")),
        "lead_date": now,
        "source": F.coalesce(F.col("source"), F.lit("Manual")),
        "request_type": F.coalesce(F.col("request_type"), F.lit("Manual")),
        "broker_id": owner, "status": F.lit("NEW"), "processed_at": now,
    })
