"""Identity resolution, risk levels, candidates and cited sources, one row per lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import clean, email_domain, fold
from ..functions.urls import is_profile_company, is_profile_person, parse_url, source_type_short
from ..plans.barrier import filter_computed
from ..plans.joins import with_group_facts
from ..plans.ordering import top_k
from .evidence import own_domain_first

IDENTIFIED = ("confirmed", "probable")


def document_facts(scored: DataFrame, leads: DataFrame, key: str = "lead_id") -> DataFrame:
    """Relevant documents with the flags the identity rules read.

    ``scored`` comes from :func:`evidence.score_evidence`; ``headline`` is optional, and with the
    terms it can keep the leads are not joined again.
    """
    df = filter_computed(scored, F.col("score") >= V.RELEVANCE_THRESHOLD)
    if "_name" not in scored.columns:
        side = leads.select(
            key, fold(clean(F.col("full_name"))).alias("_name"), email_domain(F.col("email")).alias("_domain"))
        df = with_group_facts(df, side, key, "ordinal", "left")
    df = parse_url(df, "url", "_u")
    u = F.col("_u")
    if "headline" not in df.columns:
        df = df.withColumn("headline", F.lit(""))
    named = F.col("has_exact_name") | F.col("has_all_tokens")
    df = df.withColumns({
        "is_named": named, "is_person": is_profile_person(u), "is_company_page": is_profile_company(u)})
    return df.withColumns({
        "is_company": F.col("source_type").isin("company_website", "official_registry")
        | F.col("is_company_page"),
        "is_candidate": F.col("is_named") & ~F.col("is_company_page")
        & ((F.col("source_type") != "company_website")
           | F.contains(fold(F.col("headline")), F.col("_name"))),
        "is_site": (F.col("_domain") != "")
        & ((u["host"] == F.col("_domain")) | (u["host"] == F.concat(F.lit("www."), F.col("_domain")))),
    }).drop("_u", "_name", "_domain")


def has_context(free_mail=V.FREE_MAIL_FULL) -> Column:
    """The lead carries a company, country, city or a professional mail domain."""
    domain = email_domain(F.col("email"))
    return (
        (clean(F.col("company_name")) != "") | (clean(F.col("country")) != "")
        | (clean(F.col("city")) != "") | ((domain != "") & ~domain.isin(*free_mail)))


# counts and flags of a lead, with their value for a lead without documents
COUNTS = {
    "relevant": 0, "named": 0, "any_email": False, "any_person": False, "any_company": False,
    "sanctions_docs": 0, "pep_docs": 0, "named_country": False, "named_city": False,
    "any_sector": False, "any_executive": False,
}


def count_columns() -> list[Column]:
    named = F.col("is_named")
    kind = F.col("source_type")
    columns = {
        "relevant": F.count(F.lit(1)),
        "named": F.count_if(named),
        "any_email": F.bool_or("has_email"),
        "any_person": F.bool_or(named & F.col("is_person")),
        "any_company": F.bool_or("is_company"),
        "sanctions_docs": F.count_if(named & (kind == "sanctions_db")),
        "pep_docs": F.count_if(named & (kind == "pep_db")),
        "named_country": F.bool_or(named & F.col("has_country")),
        "named_city": F.bool_or(named & F.col("has_city")),
        "any_sector": F.bool_or("has_sector"),
        "any_executive": F.bool_or("has_executive"),
    }
    return [c.alias(name) for name, c in columns.items()]


def identity_counts(facts: DataFrame, key: str = "lead_id") -> DataFrame:
    """Per-lead counts and flags; aggregated map-side, so a hot lead stays parallel."""
    return facts.groupBy(key).agg(*count_columns())


def identity_ladder(leads: DataFrame, counts: DataFrame, key: str = "lead_id") -> DataFrame:
    """Status and confidence of every lead; leads without relevant documents included."""
    df = leads.withColumn("has_context", has_context()).join(counts, key, "left")
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c, value in COUNTS.items()})
    status = (
        F.when(F.col("relevant") == 0, "unresolved")
        .when(F.col("any_email"), "confirmed")
        .when(F.col("has_context")
              & ((F.col("named") >= 2) | (F.col("any_person") & F.col("any_company"))), "probable")
        .when(F.col("named") > 0, "ambiguous")
        .otherwise("unresolved"))
    df = df.withColumn("identity_status", status)
    confidence = (
        F.when(F.col("relevant") == 0, 0)
        .when(F.col("identity_status") == "confirmed", 95)
        .when(F.col("identity_status") == "probable", 75)
        .when(F.col("identity_status") == "ambiguous", 45).otherwise(20))
    return df.withColumn("confidence_score", confidence)


def risk_levels(resolved: DataFrame) -> DataFrame:
    """Risk, review and economic level from the resolved identity."""
    identified = F.col("identity_status").isin(*IDENTIFIED)
    backed = F.col("any_company") | F.col("any_person")
    return resolved.withColumns({
        "overall_risk": F.when(identified & backed, "medium").otherwise("undetermined"),
        "recommended_review": F.when(F.col("identity_status") == "unresolved", "insufficient_data")
        .otherwise("manual_review"),
        "economic_level": F.when(identified & F.col("any_company"), "medium").otherwise("undetermined"),
        "sanctions_status": F.when(F.col("sanctions_docs") > 0, "possible_homonym").otherwise("not_enough_data"),
        "pep_status": F.when(F.col("pep_docs") > 0, "possible_homonym").otherwise("not_enough_data"),
    })


def top_sources(facts: DataFrame, k: int = 5, key: str = "lead_id") -> DataFrame:
    """Cited sources: profile persons, then profile companies, then others, by score."""
    kind = F.when(F.col("is_person"), 2).when(F.col("is_company_page"), 1).otherwise(0)
    out = top_k(facts.withColumn("_kind", kind), [key],
                [F.col("_kind").desc(), F.col("score").desc(), F.col("ordinal")], k, "rank")
    note = F.when(F.col("headline") != "", F.col("headline")).otherwise(
        F.concat(F.lit(V.TEXT["note_head"]), F.array_join("signals", ", "), F.lit(".")))
    return out.withColumn("note", F.left(note, F.lit(500))).drop("_kind")


def candidates(facts: DataFrame, k: int = 5, key: str = "lead_id") -> DataFrame:
    """Best person candidates of a lead."""
    return top_k(facts.filter("is_candidate"), [key], [F.col("score").desc(), F.col("ordinal")], k, "rank")


def screening_details(facts: DataFrame, kind: str, k: int = 3, key: str = "lead_id") -> DataFrame:
    """Textual matches in list sources, at most ``k`` detail lines per lead (a lead with
    more keeps the first by score)."""
    rows = facts.filter(F.col("is_named") & (F.col("source_type") == kind))
    out = top_k(rows, [key], [F.col("score").desc(), F.col("ordinal")], k, "rank")
    return out.withColumn("detail", F.concat(F.lit(V.TEXT["match_detail"]), F.col("url")))


def short_evidence(hits: DataFrame, leads: DataFrame, key: str = "lead_id", limit: int = 5) -> DataFrame:
    """Facts of the short rule set: the first ``limit`` sources of every lead (``_hits``) and what
    their joined texts hold."""
    mail = F.lower(clean(F.col("email")))
    after_at = F.coalesce(F.get(F.split(mail, "@"), F.lit(1)), F.lit(""))
    side = leads.select(
        key, fold(clean(F.col("full_name")), "builder").alias("_name"),
        fold(mail, "builder").alias("_email"), after_at.alias("_domain"), mail.alias("_mail"),
        ((clean(F.col("full_name")) != "") & (mail != "")).alias("_ready"))
    df = with_group_facts(hits, side.select(key, "_domain"), key, "ordinal")
    df = own_domain_first(df, [key], "url", F.col("_domain"), "ordinal", limit)
    df = parse_url(df, "url", "_u").withColumn("_type", source_type_short(F.col("_u"), F.col("_domain"))).drop("_u")
    title, snippet = F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))
    per_lead = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("sources"),
        F.array_sort(F.collect_list(F.struct(
            "rank", F.col("_type").alias("type"), "url", title.alias("title"), snippet.alias("snippet")))).alias("_hits"),
        F.bool_or((F.col("_domain") != "") & ~F.col("_domain").isin(*V.FREE_MAIL_SHORT) & F.col("is_own"))
        .alias("own_domain"))
    lines = F.transform("_hits", lambda h: F.concat_ws(" ", h["title"], h["snippet"], h["url"]))
    df = side.join(per_lead, key, "left").withColumn("_all", fold(F.array_join(lines, " "), "builder"))
    text = F.coalesce("_all", F.lit(""))
    return df.withColumns({
        "email_found": (F.col("_email") != "") & F.contains(text, F.col("_email")),
        "name_found": (F.length("_name") > 2) & F.contains(text, F.col("_name")),
        "own_domain": F.coalesce("own_domain", F.lit(False)),
        "sources": F.coalesce("sources", F.lit(0)),
    }).drop("_all")


def with_short_status(df: DataFrame) -> DataFrame:
    """Add status, score and review of the short rule set."""
    email, name, own, ready = (F.col(c) for c in ("email_found", "name_found", "own_domain", "_ready"))
    return df.withColumns({
        "identity_status": F.when(ready & ((email & name) | (name & own)), "probable")
        .when(ready & (email | name), "ambiguous").otherwise("unresolved"),
        "confidence_score": F.when(~ready, 0).when(email & name & own, 70).when(email & name, 60)
        .when(name & own, 55).when(email, 45).when(name, 30).otherwise(0),
        "recommended_review": F.when(ready & (F.col("sources") > 0), "manual_review").otherwise("insufficient_data"),
    })


def identity_short(hits: DataFrame, leads: DataFrame, key: str = "lead_id", limit: int = 5) -> DataFrame:
    """Rule set on the concatenated evidence of the first ``limit`` sources of a lead."""
    return with_short_status(short_evidence(hits, leads, key, limit)).select(
        key, "sources", "email_found", "name_found", "own_domain", "identity_status", "confidence_score",
        "recommended_review")
