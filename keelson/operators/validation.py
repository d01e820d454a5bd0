"""Validation rules as boolean columns; every failed rule is reported, bad rows are split off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, strip
from ..functions.vocab import LEAD_STATUSES
from ..plans.barrier import filter_computed

EMAIL = r"^[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+\-]@(?:[A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,}$"


def with_errors(df: DataFrame, rules: dict[str, Column], out: str = "errors") -> DataFrame:
    """Add the list of failed rule names.  A rule holds when it is true; null is a failure."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn(out, F.array_compact(F.array(*failed)))


def split(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); the rules stay above the filter, so their inputs are derived once."""
    good = F.size(errors) == 0
    return filter_computed(df, good).drop(errors), filter_computed(df, ~good)


def outcome_counts(df: DataFrame, outcome: str) -> DataFrame:
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def required(c: Column, longest: int | None = None) -> Column:
    ok = F.coalesce(F.length(c), F.lit(0)) >= 1
    return ok if longest is None else ok & (F.length(c) <= longest)


def optional(c: Column, longest: int) -> Column:
    """Missing, or within the cap.  Only for raw text fields."""
    return F.coalesce(F.length(c) <= longest, F.lit(True))


def optional_trimmed(c: Column, longest: int) -> Column:
    return optional(blank_to_null(c), longest)


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL) & ~F.startswith(c, F.lit(".")) & ~F.contains(c, F.lit(".."))


def optional_email(c: Column) -> Column:
    text = blank_to_null(c)
    return text.isNull() | is_email(text)


def listing_rules(this_year: Column | None = None) -> dict[str, Column]:
    c, year = F.col, this_year if this_year is not None else F.year(F.current_date())
    return {
        "nom_bateau": required(c("nom_bateau"), 100),
        "constructeur": required(c("constructeur"), 50),
        "longueur_m": (c("longueur_m") > 0) & (c("longueur_m") <= 200),
        "annee": (c("annee") >= 1900) & (c("annee") <= year + 2),
        "proprietaire": required(c("proprietaire"), 100),
        "capitaine": required(c("capitaine"), 100),
        "localisation": required(c("localisation")),
        "nombre_cabines": c("nombre_cabines").isNull() | (c("nombre_cabines") > 0),
        "prix_actuel": optional(c("prix_actuel"), 100),
        "prix_precedent": optional(c("prix_precedent"), 100),
        "dernier_message": optional(c("dernier_message"), 500),
        "commentaire": optional(c("commentaire"), 2000),
    }


def tracked_rules(this_year: Column | None = None) -> dict[str, Column]:
    c, year = F.col, this_year if this_year is not None else F.year(F.current_date())
    return {
        "nom_bateau": required(c("nom_bateau"), 100),
        "constructeur": optional_trimmed(c("constructeur"), 100),
        "longueur_m": c("longueur_m").isNull() | ((c("longueur_m") > 0) & (c("longueur_m") <= 200)),
        "annee": c("annee").isNull() | ((c("annee") >= 1900) & (c("annee") <= year + 2)),
        "localisation": optional_trimmed(c("localisation"), 100),
        "commentaire": optional_trimmed(c("commentaire"), 2000),
    }


# longest text of each optional field of a manual lead (fixed values)
MANUAL_LEAD_CAPS = {
    "contact_first_name": 60, "contact_last_name": 60, "contact_phone": 40, "contact_country": 80,
    "boat_make": 80, "boat_model": 120, "boat_year": 10, "boat_condition": 40,
    "boat_length_value": 20, "boat_length_units": 20, "boat_price_amount": 30,
    "boat_price_currency": 10, "boat_url": 500, "customer_comments": 2000, "lead_comments": 2000,
    "source": 80, "detailed_source": 120, "detailed_source_summary": 120, "request_type": 120,
    "recipient_office_name": 120, "recipient_office_id": 80, "recipient_contact_name": 120,
}


def manual_lead_rules(columns: list[str] | None = None) -> dict[str, Column]:
    rules = {
        "contact_display_name": required(strip(F.col("contact_display_name")), 120),
        "contact_email": optional_email(F.col("contact_email")),
    }
    for name, longest in MANUAL_LEAD_CAPS.items():
        if columns is None or name in columns:
            rules[name] = optional_trimmed(F.col(name), longest)
    return rules


def lead_document_rules(doc: str = "doc") -> dict[str, Column]:
    """Required parts of a lead document; the contact block must exist, e-mail and boat may not."""
    d = F.col(doc)
    return {
        "lead.id": required(d["lead"]["id"]),
        "lead.source": required(d["lead"]["source"]),
        "contact": d["contact"].isNotNull(),
        "recipient.officeName": required(d["recipient"]["officeName"]),
        "recipient.officeId": required(d["recipient"]["officeId"]),
    }


def lead_update_rules() -> dict[str, Column]:
    return {
        "status": F.col("status").isNull() | F.col("status").isin(*LEAD_STATUSES),
        "customer_comments": optional(F.col("customer_comments"), 2000),
        "lead_comments": optional(F.col("lead_comments"), 2000),
    }


def stored_listing_rules(this_year: Column | None = None) -> dict[str, Column]:
    """Checks of the listing table itself (missing values pass)."""
    year = this_year if this_year is not None else F.year(F.current_date())
    return {
        "longueur_m": F.coalesce(F.col("longueur_m") > 0, F.lit(True)),
        "annee": F.coalesce((F.col("annee") >= 1900) & (F.col("annee") <= year + 2), F.lit(True)),
    }


def attempt_rules() -> dict[str, Column]:
    """Checks of the attempt table."""
    from ..functions.vocab import ATTEMPT_STATUSES
    return {
        "status": F.col("status").isin(*ATTEMPT_STATUSES),
        "trigger_source": F.col("trigger_source").isin("new_lead", "manual", "recheck"),
        "retry_count": F.col("retry_count") >= 0,
        "completed_at": F.coalesce(F.col("completed_at") >= F.col("started_at"), F.lit(True)),
    }
