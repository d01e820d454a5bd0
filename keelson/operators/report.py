"""Screening reports of all leads in one plan: evidence scored, identity resolved, parts assembled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import clean
from ..plans.barrier import filter_computed
from ..plans.ordering import top_k
from ..schemas import REPORT
from ..session import materialise
from .contract import blank_report, enforce_screening, settle
from .evidence import score_evidence, with_fields
from .identity import (
    COUNTS, IDENTIFIED, count_columns, document_facts, identity_ladder, short_evidence, with_short_status,
)

TEXT = V.TEXT


def evidence_facts(docs: DataFrame, leads: DataFrame, key: str = "lead_id") -> DataFrame:
    """Relevant documents with score, signals, lines and flags, without their text."""
    scored = score_evidence(docs, leads, key, keep_text=True, keep_terms=True)
    scored = filter_computed(scored, F.col("score") >= V.RELEVANCE_THRESHOLD)
    return document_facts(with_fields(scored).drop("text"), leads, key)


def _first(value: Column, when: Column | None = None) -> Column:
    """First non-empty value in rank order (score descending, then ordinal)."""
    ok = value != ""
    ok = ok if when is None else ok & when
    return F.coalesce(
        F.min_by(F.when(ok, value), F.when(ok, F.struct(-F.col("score"), F.col("ordinal")))), F.lit(""))


def lead_summary(facts: DataFrame, key: str = "lead_id") -> DataFrame:
    """Everything the report needs once per lead, in one aggregation."""
    named, person, company = F.col("is_named"), F.col("is_person"), F.col("is_company")
    registered = F.col("source_type").isin("company_website", "official_registry")
    best = F.max_by(
        F.when(named, F.struct("headline", "has_city", "has_company", "has_sector", "has_executive")),
        F.when(named, F.struct(F.col("score"), -F.col("ordinal"))))
    extra = [
        best.alias("primary"),
        _first(F.col("statement"), person).alias("person_statement"),
        _first(F.col("statement"), registered).alias("company_statement"),
        _first(F.col("statement")).alias("any_statement"),
        *[_first(F.col("field_" + n)).alias("field_" + n) for n in ("metier", "entreprise", "missions", "location", "about")],
        _first(F.col("field_entreprise"), named).alias("named_entreprise"),
        _first(F.col("field_location"), named).alias("named_location"),
        _first(F.col("url"), named & person).alias("profile_url"),
        _first(F.col("url"), company & F.col("is_site")).alias("site_url"),
    ]
    return facts.groupBy(key).agg(*count_columns(), *extra)


def list_parts(facts: DataFrame, key: str = "lead_id") -> DataFrame:
    """The bounded lists of a report.  A document enters one row per list it belongs to;
    the rank filter cuts every list to its length before the rows meet."""
    kind = F.when(F.col("is_person"), 2).when(F.col("is_company_page"), 1).otherwise(0)
    lists = F.array_compact(F.array(
        F.struct(F.lit("source").alias("list"), kind.alias("class")),
        F.when(F.col("is_named"), F.struct(F.lit("named").alias("list"), F.lit(0).alias("class"))),
        F.when(F.col("is_candidate"), F.struct(F.lit("candidate").alias("list"), F.lit(0).alias("class"))),
        F.when(F.col("is_named") & (F.col("source_type") == "sanctions_db"),
               F.struct(F.lit("sanctions").alias("list"), F.lit(0).alias("class"))),
        F.when(F.col("is_named") & (F.col("source_type") == "pep_db"),
               F.struct(F.lit("pep").alias("list"), F.lit(0).alias("class"))),
    ))
    rows = facts.select(
        key, "score", "ordinal", "url", "source_type", "headline", "signals", F.explode(lists).alias("_l")
    ).select("*", "_l.list", "_l.class").drop("_l")
    rows = top_k(rows, [key, "list"],
                 [F.col("class").desc(), F.col("score").desc(), F.col("ordinal")], 5, "rank")
    note = F.when(F.col("headline") != "", F.col("headline")).otherwise(
        F.concat(F.lit(TEXT["note_head"]), F.array_join("signals", ", "), F.lit(".")))

    def gathered(name, longest=5):
        mine = (F.col("list") == name) & (F.col("rank") <= longest)
        return F.array_sort(F.collect_list(F.when(mine, F.struct(
            "rank", "url", F.col("source_type").alias("type"), F.left(note, F.lit(500)).alias("note"), "headline"))))

    return rows.groupBy(key).agg(
        gathered("source").alias("source_list"), gathered("named").alias("named_list"),
        gathered("candidate").alias("candidate_list"),
        gathered("sanctions", 3).alias("sanctions_list"), gathered("pep", 3).alias("pep_list"))


def _sentence(label: str, value: Column) -> Column:
    end = F.when(F.right(value, F.lit(1)).isin(".", "!", "?", "…"), "").otherwise(".")
    return F.when(value != "", F.concat(F.lit(label + " : "), F.rtrim(value), end))


def executive_summary(name: Column, status: Column, sanctions: Column, pep: Column) -> Column:
    """Ordered sentences from the status, the profile fields, the signals and the screening."""
    identity = F.concat(
        F.lit(TEXT["client"]), name,
        F.when(status == "confirmed", TEXT["line_confirmed"]).when(status == "probable", TEXT["line_probable"])
        .when(status == "ambiguous", TEXT["line_ambiguous"]).otherwise(TEXT["line_unresolved"]))
    statement = F.when(F.col("person_statement") != "", F.col("person_statement")).when(
        F.col("company_statement") != "", F.col("company_statement")).otherwise(F.col("any_statement"))
    role = F.when(F.col("field_missions") != "", F.col("field_missions")).otherwise(F.col("field_about"))
    excerpt = F.concat(F.rtrim(F.left(role, F.lit(280))), F.when(F.length(role) > 280, "…").otherwise(""))
    metier = F.coalesce(_sentence(V.LABELS["metier"], F.col("field_metier")), _sentence(V.LABELS["statement"], statement))
    company = _sentence(V.LABELS["company"], F.col("field_entreprise"))
    mission = F.when(role != "", F.concat(F.lit(V.LABELS["mission"]), excerpt))
    place = _sentence(V.LABELS["place"], F.col("field_location"))
    nothing = F.when(F.coalesce(metier, company, mission, place).isNull(), TEXT["no_fields"])
    relevance = F.when(F.col("any_sector"), TEXT["rel_sector"]).when(
        F.col("any_executive"), TEXT["rel_economic"]).otherwise(TEXT["rel_none"])
    screening = F.when((sanctions == "hit") | (pep == "hit"), TEXT["sum_hit"]).when(
        (sanctions == "possible_homonym") | (pep == "possible_homonym"), TEXT["sum_homonym"])
    return F.array_compact(F.array(identity, metier, company, mission, place, nothing, relevance, screening))


def assemble(docs: DataFrame, leads: DataFrame, key: str = "lead_id", reuse: bool = True) -> DataFrame:
    """One report per lead from its collected documents (one per canonical URL and lead).

    The per-document facts feed two aggregations.  With ``reuse`` they are written once
    to the session's checkpoint folder instead of scoring every text twice.
    """
    facts = evidence_facts(docs, leads, key)
    if reuse:
        facts = materialise(facts)
    summary, lists = lead_summary(facts, key), list_parts(facts, key)
    query_names = REPORT["query_input"].dataType.names
    tidy = leads.select(key, *[clean(F.col(n)).alias(n) for n in query_names])
    df = identity_ladder(tidy, summary, key).join(lists, key, "left")
    df = df.withColumns({
        c: F.coalesce(c, F.lit("")) for c in summary.columns if c not in (key, "primary", *COUNTS)})
    status, primary = F.col("identity_status"), F.col("primary")
    identified = status.isin(*IDENTIFIED)

    strings = "array<string>"

    def strs(*items):
        return F.array(*items).cast(strings)

    def when_list(condition, value):
        return F.when(condition, value).otherwise(F.array().cast(strings))

    def text_if(condition, value):
        return F.when(condition, value).otherwise(F.lit(""))

    base = (
        F.when(status == "confirmed", TEXT["confirmed"]).when(status == "probable", TEXT["probable"])
        .when(status == "ambiguous", TEXT["ambiguous"]).otherwise(TEXT["unresolved"]))
    sector = F.when(primary["has_sector"], V.SIGNALS["sector"])
    executive = F.when(primary["has_executive"], V.SIGNALS["executive"])
    priority = F.concat_ws(" et ", sector, executive)
    rationale = F.concat(base, F.when(priority != "", F.concat(
        F.lit(TEXT["priority_head"]), priority, F.lit(TEXT["priority_tail"]))).otherwise(""))
    sanctions, pep = F.col("sanctions_docs") > 0, F.col("pep_docs") > 0
    sanction_status = F.when(sanctions, "possible_homonym").otherwise("not_enough_data")
    pep_status = F.when(pep, "possible_homonym").otherwise("not_enough_data")
    df = df.withColumns({"_rationale": rationale, "_sanctions": sanction_status, "_pep": pep_status})

    person_type = REPORT["identity_resolution"].dataType["matched_persons"].dataType
    separate = F.transform("candidate_list", lambda x: F.struct(
        F.col("full_name").alias("name"), x["headline"].alias("headline"), F.lit("").alias("location"),
        F.lit("").alias("company"), F.array(x["url"]).alias("evidence")))
    together = F.array(F.struct(
        F.col("full_name").alias("name"), primary["headline"].alias("headline"),
        text_if(primary["has_city"], F.col("city")).alias("location"),
        text_if(primary["has_company"], F.col("company_name")).alias("company"),
        F.col("named_list.url").alias("evidence")))
    matched = F.when(primary.isNull(), F.array().cast(person_type)).when(
        (status == "ambiguous") & ~F.col("has_context"), separate).otherwise(together)

    work = F.when(F.col("any_company") & (F.col("company_name") != ""), F.col("company_name")).otherwise(
        F.col("named_entreprise"))
    home = F.when(F.col("named_city") & (F.col("city") != ""), F.col("city")).otherwise(F.col("named_location"))
    title = F.when(F.col("field_metier") != "", F.col("field_metier")).otherwise(F.col("any_statement"))

    def screening(name, state):
        detail = F.transform(name + "_list", lambda x: F.concat(F.lit(TEXT["match_detail"]), x["url"]))
        return F.struct(state.alias("status"),
                        F.when(state == "possible_homonym", detail).otherwise(F.array().cast(strings))
                        .alias("details"))

    query = F.struct(*[F.col(n) for n in query_names])
    blank = blank_report(query, F.when(
        F.col("full_name") == "", TEXT["no_input"]).otherwise(TEXT["no_relevant"]))
    report = blank_report(query, F.lit(""), {
        "identity_resolution": F.struct(
            status.alias("status"), F.col("confidence_score").alias("confidence_score"),
            matched.cast(person_type).alias("matched_persons"),
            F.col("_rationale").alias("selected_profile_rationale")),
        "person_profile.full_name": text_if(identified, F.col("full_name")),
        "person_profile.current_company": text_if(identified, work),
        "person_profile.country": text_if(identified & F.col("named_country"), F.col("country")),
        "person_profile.location": text_if(identified, home),
        "person_profile.current_title": text_if(identified, title),
        "person_profile.emails": when_list(F.col("any_email"), strs(F.col("email"))),
        "person_profile.profiles.linkedin": F.col("profile_url"),
        "person_profile.profiles.company_profile": F.col("site_url"),
        "company_profile.website": F.col("site_url"),
        "company_profile.company_name": text_if(F.col("any_company"), F.col("company_name")),
        "risk_screening.sanctions": screening("sanctions", F.col("_sanctions")),
        "risk_screening.pep": screening("pep", F.col("_pep")),
        "economic_coherence": F.struct(
            F.when(identified & F.col("any_company"), "medium").otherwise("undetermined").alias("level"),
            when_list(identified & F.col("any_company"), strs(F.lit(TEXT["economic"]))).alias("indicators")),
        "kyc_assessment.overall_risk": F.when(
            identified & (F.col("any_company") | F.col("any_person")), "medium").otherwise("undetermined"),
        "kyc_assessment.recommended_review": F.when(status == "unresolved", "insufficient_data")
        .otherwise("manual_review"),
        "kyc_assessment.key_reasons": strs(
            F.concat(F.col("relevant").cast("string"), F.lit(TEXT["sources_tail"])), F.col("_rationale"),
            F.when(sanctions | pep, TEXT["screening_match"]).otherwise(TEXT["screening_none"])),
        "kyc_assessment.executive_summary": F.transform(
            F.slice(executive_summary(F.col("full_name"), status, F.col("_sanctions"), F.col("_pep")), 1, 8),
            lambda s: F.left(s, F.lit(600))),
        "sources": F.transform("source_list", lambda x: F.struct(
            x["type"].alias("type"), x["url"].alias("url"), x["note"].alias("note"))),
    })
    usable = (F.col("relevant") > 0) & (F.col("full_name") != "")
    df = df.select(key, F.when(usable, report.cast(REPORT)).otherwise(blank.cast(REPORT)).alias("report"),
                   usable.alias("_usable"))
    done = settle(enforce_screening(df.withColumn("_plain", F.col("report"))))
    return done.select(key, F.when(F.col("_usable"), F.col("report")).otherwise(F.col("_plain")).alias("report"))


def short_report(hits: DataFrame, leads: DataFrame, key: str = "lead_id", limit: int = 5) -> DataFrame:
    """The short builder's report per lead: typed sources with a note, evidence, the matched person,
    addresses, sites and reasons.  Leads without name or e-mail get the reason alone."""
    df = with_short_status(short_evidence(hits, leads, key, limit))
    names = ("full_name", "company_name", "country", "city")
    df = df.join(leads.select(key, *[clean(F.col(n)).alias(n) for n in names]), key)
    ready, domain, T = F.col("_ready"), F.col("_domain"), V.SHORT_TEXT
    email, name, own = (F.col(c) for c in ("email_found", "name_found", "own_domain"))

    def source(h):
        note = F.concat_ws(" — ", F.nullif(h["title"], F.lit("")), F.nullif(h["snippet"], F.lit("")))
        return F.struct(h["type"].alias("type"), h["url"].alias("url"), F.left(note, F.lit(V.SHORT_NOTE)).alias("note"))

    kind = "array<struct<type:string,url:string,note:string>>"
    strings = "array<string>"
    df = df.withColumn("source_list", F.when(
        ready & (F.col("sources") > 0), F.transform("_hits", source)).otherwise(F.array().cast(kind)).cast(kind))
    df = df.withColumn("evidence", F.array_compact(F.array(
        F.when(ready & email, T["email"]), F.when(ready & name, T["name"]),
        F.when(ready & own & (email | name), T["own_domain"]))).cast(strings))
    found = F.size("evidence") > 0

    def text_if(condition, value):
        return F.when(condition, value).otherwise("")

    place = F.when(F.col("city") != "", F.col("city")).otherwise(F.col("country"))
    linkedin = F.filter("source_list", lambda s: s["type"] == "linkedin")
    reasons = F.when(~ready, F.array(F.lit(T["no_input"]))).when(
        F.col("sources") > 0, F.array(F.concat(F.col("sources").cast("string"), F.lit(T["collected"])), F.lit(T["screening"]))
    ).otherwise(F.array(F.lit(T["none"])))
    return df.select(
        key, "identity_status", "confidence_score", "recommended_review", "source_list", "evidence",
        text_if(found, F.col("full_name")).alias("person_name"), text_if(found, place).alias("person_location"),
        text_if(found, F.col("company_name")).alias("person_company"), text_if(found, F.col("country")).alias("person_country"),
        text_if(found, F.lit(T["rationale"])).alias("rationale"),
        F.when(ready & email, F.array("_mail")).otherwise(F.array().cast(strings)).alias("emails"),
        F.col("source_list.url").alias("websites"), F.coalesce(F.get(linkedin, F.lit(0))["url"], F.lit("")).alias("linkedin"),
        text_if(ready & (domain != "") & ~domain.isin(*V.FREE_MAIL_SHORT), F.concat(F.lit("https://"), domain)).alias("company_website"),
        reasons.alias("key_reasons"))
