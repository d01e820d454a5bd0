"""Identity, report, contract and provider jobs on documents, events and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import contract as K
from ..operators import evidence as E
from ..operators import identity as I
from ..operators import providers as P
from ..operators import report as R
from ..schemas import ADVERSE_RECORD, COMPANY_ITEM, PROFILE_ITEM
from . import evidence as EW
from . import roles
from .roles import (
    EVIDENCE_LEADS_SQL, EVIDENCE_SCORED_SQL, dealt, q, sql_any, sql_domain, sql_fold, sql_host, sql_in_domain, sql_list, table,
)

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


FACTS_SQL = EVIDENCE_SCORED_SQL + f""",
facts AS (
  SELECT *, (f_exact OR f_tokens) AS named,
    (ends_with(host, 'linkedin.com') AND starts_with(lower(path), '/in/')) AS is_person,
    (ends_with(host, 'linkedin.com') AND starts_with(lower(path), '/company/')) AS is_page,
    (source_type IN ('company_website', 'official_registry') OR (ends_with(host, 'linkedin.com') AND starts_with(lower(path), '/company/'))) AS is_company,
    (domain <> '' AND (host = domain OR host = concat('www.', domain))) AS is_site
  FROM ev_scored WHERE score >= 20),
counts AS (
  SELECT lead_id, count(*) AS relevant, count(*) FILTER (WHERE named) AS named, bool_or(f_email) AS any_email,
    bool_or(named AND is_person) AS any_person, bool_or(is_company) AS any_company,
    count(*) FILTER (WHERE named AND source_type = 'sanctions_db') AS sanctions_docs,
    count(*) FILTER (WHERE named AND source_type = 'pep_db') AS pep_docs,
    bool_or(named AND f_country) AS named_country, bool_or(named AND f_city) AS named_city,
    bool_or(f_sector) AS any_sector, bool_or(f_exec) AS any_executive FROM facts GROUP BY lead_id),
ladder AS (
  SELECT l.*, c.* EXCLUDE (lead_id), coalesce(relevant, 0) AS n_relevant,
    (company_name <> '' OR country <> '' OR city <> '' OR ({sql_domain('email')} <> '' AND {sql_domain('email')} NOT IN {sql_list(V.FREE_MAIL_FULL)})) AS has_context
  FROM ev_leads l LEFT JOIN counts c ON c.lead_id = l.lead_id),
resolved AS (
  SELECT *, CASE WHEN n_relevant = 0 THEN 'unresolved' WHEN any_email THEN 'confirmed'
      WHEN has_context AND (named >= 2 OR (any_person AND any_company)) THEN 'probable'
      WHEN named > 0 THEN 'ambiguous' ELSE 'unresolved' END AS identity_status FROM ladder)"""


def facts(spark, sf):
    leads = roles.evidence_leads(spark, sf)
    docs = roles.untyped_documents(spark, sf)
    return I.document_facts(E.score_evidence(docs, leads, keep_terms=True), leads), leads


@query("identity_ladder", f"""WITH {FACTS_SQL}
SELECT lead_id, n_relevant AS relevant, coalesce(named, 0) AS named, has_context, identity_status,
  CASE WHEN n_relevant = 0 THEN 0 WHEN identity_status = 'confirmed' THEN 95 WHEN identity_status = 'probable' THEN 75 WHEN identity_status = 'ambiguous' THEN 45 ELSE 20 END AS confidence_score
FROM resolved""")
def identity_ladder(spark, sf):
    relevant, leads = facts(spark, sf)
    return I.identity_ladder(leads, I.identity_counts(relevant)).select(
        "lead_id", "relevant", "named", "has_context", "identity_status", "confidence_score")


@query("risk_levels", f"""WITH {FACTS_SQL}
SELECT lead_id, identity_status, CASE WHEN identity_status IN ('confirmed', 'probable') AND (any_company OR any_person) THEN 'medium' ELSE 'undetermined' END AS overall_risk,
  CASE WHEN identity_status = 'unresolved' THEN 'insufficient_data' ELSE 'manual_review' END AS recommended_review,
  CASE WHEN identity_status IN ('confirmed', 'probable') AND any_company THEN 'medium' ELSE 'undetermined' END AS economic_level,
  CASE WHEN coalesce(sanctions_docs, 0) > 0 THEN 'possible_homonym' ELSE 'not_enough_data' END AS sanctions_status,
  CASE WHEN coalesce(pep_docs, 0) > 0 THEN 'possible_homonym' ELSE 'not_enough_data' END AS pep_status FROM resolved""")
def risk_levels(spark, sf):
    relevant, leads = facts(spark, sf)
    return I.risk_levels(I.identity_ladder(leads, I.identity_counts(relevant))).select(
        "lead_id", "identity_status", "overall_risk", "recommended_review", "economic_level", "sanctions_status", "pep_status")


@query("top_sources", f"""WITH {FACTS_SQL}
SELECT lead_id, ordinal, source_type, concat('Indices d’attribution : ', signals, '.') AS note,
  row_number() OVER (PARTITION BY lead_id ORDER BY CASE WHEN is_person THEN 2 WHEN is_page THEN 1 ELSE 0 END DESC, score DESC, ordinal) AS rank
FROM facts QUALIFY rank <= 5""")
def top_sources(spark, sf):
    relevant, _ = facts(spark, sf)
    return I.top_sources(relevant).select("lead_id", "ordinal", "source_type", "note", "rank")


@query("person_candidates", f"""WITH {FACTS_SQL}
SELECT lead_id, ordinal, score, row_number() OVER (PARTITION BY lead_id ORDER BY score DESC, ordinal) AS rank FROM facts
WHERE named AND NOT is_page AND source_type <> 'company_website' QUALIFY rank <= 5""")
def person_candidates(spark, sf):
    relevant, _ = facts(spark, sf)
    return I.candidates(relevant).select("lead_id", "ordinal", "score", "rank")


@query("screening_details", f"""WITH {FACTS_SQL}
SELECT lead_id, concat('Correspondance textuelle à vérifier manuellement: ', url) AS detail, row_number() OVER (PARTITION BY lead_id ORDER BY score DESC, ordinal) AS rank
FROM facts WHERE named AND source_type = 'pep_db' QUALIFY rank <= 3""")
def screening_details(spark, sf):
    relevant, _ = facts(spark, sf)
    return I.screening_details(relevant, "pep_db").select("lead_id", "detail", "rank")


@query("identity_short", f"""
WITH {EVIDENCE_LEADS_SQL},
h AS (SELECT source AS lead_id, doc_id AS ordinal, {roles.DOCUMENT_URL} AS url, text AS snippet FROM documents),
l AS (SELECT lead_id, {sql_fold('full_name', 'builder')} AS n, {sql_fold('lower(email)', 'builder')} AS e, split_part(lower(email), '@', 2) AS d, full_name <> '' AND email <> '' AS ready FROM ev_leads),
r AS (SELECT h.*, d, {sql_in_domain(sql_host('url'), 'd')} AS own FROM h JOIN l USING (lead_id)
  QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY {sql_in_domain(sql_host('url'), 'd')} DESC, ordinal) <= 5),
g AS (SELECT lead_id, count(*) AS sources, string_agg(concat_ws(' ', '', snippet, url), ' ' ORDER BY own DESC, ordinal) AS t,
  bool_or(d <> '' AND d NOT IN {sql_list(V.FREE_MAIL_SHORT)} AND own) AS own FROM r GROUP BY lead_id),
f AS (SELECT l.*, sources, own, contains(ft, e) AND e <> '' AS ef, contains(ft, n) AND length(n) > 2 AS nf FROM l JOIN (SELECT *, {sql_fold('t', 'builder')} AS ft FROM g) USING (lead_id))
SELECT lead_id, sources, ef AS email_found, nf AS name_found, own AS own_domain,
  CASE WHEN ready AND ((ef AND nf) OR (nf AND own)) THEN 'probable' WHEN ready AND (ef OR nf) THEN 'ambiguous' ELSE 'unresolved' END AS identity_status,
  CASE WHEN NOT ready THEN 0 WHEN ef AND nf AND own THEN 70 WHEN ef AND nf THEN 60 WHEN nf AND own THEN 55 WHEN ef THEN 45 WHEN nf THEN 30 ELSE 0 END AS confidence_score,
  CASE WHEN ready AND sources > 0 THEN 'manual_review' ELSE 'insufficient_data' END AS recommended_review FROM f""")
def identity_short(spark, sf):
    hits = table(spark, sf, "documents").selectExpr(
        "source AS lead_id", "doc_id AS ordinal", f"{roles.DOCUMENT_URL} AS url", "'' AS title", "text AS snippet")
    return I.identity_short(hits, roles.evidence_leads(spark, sf))


_SHORT_TYPE = f"""CASE WHEN {sql_in_domain('hh', 'd')} THEN 'company_website' WHEN contains(hh, 'linkedin.com') THEN 'linkedin'
    WHEN contains(hh, 'sanction') OR contains(hh, 'ofac') OR contains(hh, 'europa.eu') THEN 'sanctions_db'
    WHEN contains(hh, 'company') OR contains(hh, 'registry') OR contains(hh, 'registre') THEN 'official_registry'
    WHEN contains(hh, 'news') OR contains(hh, 'press') OR contains(hh, 'reuters') THEN 'news' ELSE 'other' END"""
_S = V.SHORT_TEXT


@query("short_report", f"""
WITH {EVIDENCE_LEADS_SQL},
h AS (SELECT source AS lead_id, doc_id AS ordinal, {roles.DOCUMENT_URL} AS url, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS title, text AS snippet FROM documents),
l AS (SELECT *, {sql_fold('full_name', 'builder')} AS n, {sql_fold('lower(email)', 'builder')} AS e, split_part(lower(email), '@', 2) AS d, full_name <> '' AND email <> '' AS ready FROM ev_leads),
r AS (SELECT h.*, d, {sql_host('url')} AS hh, {sql_in_domain(sql_host('url'), 'd')} AS own FROM h JOIN l USING (lead_id)
  QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY {sql_in_domain(sql_host('url'), 'd')} DESC, ordinal) <= 5),
t AS (SELECT *, {_SHORT_TYPE} AS typ FROM r),
g AS (SELECT lead_id, count(*) AS sources, string_agg(concat_ws(' ', title, snippet, url), ' ' ORDER BY own DESC, ordinal) AS t,
  string_agg(concat(typ, ' ', url, ' ', left(concat_ws(' — ', nullif(title, ''), nullif(snippet, '')), 500)), '|' ORDER BY own DESC, ordinal) AS src,
  string_agg(url, '|' ORDER BY own DESC, ordinal) AS urls, coalesce(first(url ORDER BY own DESC, ordinal) FILTER (WHERE typ = 'linkedin'), '') AS linkedin,
  bool_or(d <> '' AND d NOT IN {sql_list(V.FREE_MAIL_SHORT)} AND own) AS own FROM t GROUP BY lead_id),
f AS (SELECT l.*, sources, own, src, urls, linkedin, ready AND contains(ft, e) AND e <> '' AS ef, ready AND contains(ft, n) AND length(n) > 2 AS nf
  FROM l JOIN (SELECT *, {sql_fold('t', 'builder')} AS ft FROM g) USING (lead_id))
SELECT lead_id, CASE WHEN ready THEN src ELSE '' END AS sources, CASE WHEN ready THEN urls ELSE '' END AS websites, CASE WHEN ready THEN linkedin ELSE '' END AS linkedin,
  concat_ws('|', CASE WHEN ef THEN {q(_S['email'])} END, CASE WHEN nf THEN {q(_S['name'])} END, CASE WHEN own AND (ef OR nf) THEN {q(_S['own_domain'])} END) AS evidence,
  CASE WHEN ef OR nf THEN full_name ELSE '' END AS person_name, CASE WHEN ef OR nf THEN company_name ELSE '' END AS person_company,
  CASE WHEN ef OR nf THEN CASE WHEN city <> '' THEN city ELSE country END ELSE '' END AS person_location,
  CASE WHEN ef OR nf THEN country ELSE '' END AS person_country, CASE WHEN ef OR nf THEN {q(_S['rationale'])} ELSE '' END AS rationale,
  CASE WHEN ef THEN lower(email) ELSE '' END AS emails,
  CASE WHEN ready AND d <> '' AND d NOT IN {sql_list(V.FREE_MAIL_SHORT)} THEN concat('https://', d) ELSE '' END AS company_website,
  CASE WHEN NOT ready THEN {q(_S['no_input'])} ELSE concat(sources, {q(_S['collected'])}, '|', {q(_S['screening'])}) END AS key_reasons FROM f""")
def short_report(spark, sf):
    hits = table(spark, sf, "documents").selectExpr(
        "source AS lead_id", "doc_id AS ordinal", f"{roles.DOCUMENT_URL} AS url",
        "CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS title", "text AS snippet")
    out = R.short_report(hits, roles.evidence_leads(spark, sf))
    lists = {c: F.array_join(c, "|") for c in ("evidence", "emails", "websites", "key_reasons")}
    sources = F.array_join(F.transform("source_list", lambda s: F.concat_ws(" ", s["type"], s["url"], s["note"])), "|")
    return out.withColumns(lists).withColumn("sources", sources).drop(
        "source_list", "identity_status", "confidence_score", "recommended_review")


# --- report ------------------------------------------------------------------------------

_FIRST = "string_agg({v}, '|' ORDER BY score DESC, ordinal)"


@query("report_assembly", f"""WITH {FACTS_SQL},
top AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY CASE WHEN is_person THEN 2 WHEN is_page THEN 1 ELSE 0 END DESC, score DESC, ordinal) AS rk FROM facts),
src AS (SELECT lead_id, string_agg(concat(source_type, ' ', url), '|' ORDER BY rk) AS sources, bool_or(source_type IN ('sanctions_db', 'pep_db')) AS any_list,
   bool_or(source_type = 'sanctions_db') AS any_sanctions FROM top WHERE rk <= 5 GROUP BY lead_id),
nm AS (SELECT lead_id, string_agg(url, '|' ORDER BY score DESC, ordinal) AS evidence FROM (
   SELECT * FROM facts WHERE named QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY score DESC, ordinal) <= 5) GROUP BY lead_id),
pe AS (SELECT lead_id, arg_min(url, (-score, ordinal)) AS linkedin FROM facts WHERE named AND is_person GROUP BY lead_id),
st AS (SELECT lead_id, arg_min(url, (-score, ordinal)) AS website FROM facts WHERE is_company AND is_site GROUP BY lead_id)
SELECT r.lead_id, identity_status, CASE WHEN n_relevant = 0 THEN 0 WHEN identity_status = 'confirmed' THEN 95 WHEN identity_status = 'probable' THEN 75 WHEN identity_status = 'ambiguous' THEN 45 ELSE 20 END AS confidence_score,
  coalesce(sources, '') AS sources,
  CASE WHEN identity_status = 'ambiguous' AND NOT has_context THEN 'separate' ELSE coalesce(evidence, '') END AS evidence,
  coalesce(linkedin, '') AS linkedin, coalesce(website, '') AS website,
  CASE WHEN identity_status IN ('confirmed', 'probable') AND (any_company OR any_person) THEN 'medium' ELSE 'undetermined' END AS overall_risk,
  CASE WHEN identity_status = 'unresolved' THEN 'insufficient_data' ELSE 'manual_review' END AS recommended_review,
  CASE WHEN coalesce(sanctions_docs, 0) > 0 AND any_sanctions THEN 'possible_homonym' ELSE 'not_enough_data' END AS sanctions_status,
  CASE WHEN coalesce(pep_docs, 0) > 0 AND any_list THEN 'possible_homonym' ELSE 'not_enough_data' END AS pep_status,
  CASE WHEN identity_status IN ('confirmed', 'probable') THEN full_name ELSE '' END AS person_name
FROM resolved r LEFT JOIN src USING (lead_id) LEFT JOIN nm USING (lead_id) LEFT JOIN pe USING (lead_id) LEFT JOIN st USING (lead_id)""")
def report_assembly(spark, sf):
    leads = roles.evidence_leads(spark, sf)
    reports = R.assemble(roles.untyped_documents(spark, sf), leads)
    r = F.col("report")
    people = r["identity_resolution"]["matched_persons"]
    separate = (r["identity_resolution"]["status"] == "ambiguous") & (
        (r["query_input"]["company_name"] == "") & (r["query_input"]["country"] == "") & (r["query_input"]["city"] == "")
        & ((r["query_input"]["email"] == "")))
    return reports.select(
        "lead_id", r["identity_resolution"]["status"].alias("identity_status"),
        r["identity_resolution"]["confidence_score"].alias("confidence_score"),
        F.array_join(F.transform(r["sources"], lambda s: F.concat_ws(" ", s["type"], s["url"])), "|").alias("sources"),
        F.when(separate, "separate").otherwise(F.coalesce(F.array_join(F.get(people, F.lit(0))["evidence"], "|"), F.lit(""))).alias("evidence"),
        r["person_profile"]["profiles"]["linkedin"].alias("linkedin"), r["company_profile"]["website"].alias("website"),
        r["kyc_assessment"]["overall_risk"].alias("overall_risk"),
        r["kyc_assessment"]["recommended_review"].alias("recommended_review"),
        r["risk_screening"]["sanctions"]["status"].alias("sanctions_status"),
        r["risk_screening"]["pep"]["status"].alias("pep_status"),
        r["person_profile"]["full_name"].alias("person_name"))


@query("report_json")
def report_json(spark, sf):
    leads = roles.evidence_leads(spark, sf)
    reports = R.assemble(roles.untyped_documents(spark, sf), leads)
    return reports.select("lead_id", F.to_json("report").alias("report"))


# headline and statement of a relevant document, and the facts of the best document that names the lead; the supplied
# texts hold no lines with profile fields (``profile_fields`` checks those)
_HEADS = f"""{FACTS_SQL},
heads AS (SELECT *, coalesce(list_filter(list_transform(list_slice({EW._LINES}, 1, 30), lambda x: {EW._bare('x')}),
      lambda x: length(x) BETWEEN 8 AND 180 AND NOT regexp_matches(lower(x), '^(cookie|javascript)'))[1], '') AS headline,
    list_filter(list_transform(list_slice({EW._LINES}, 1, 20), lambda x: regexp_replace({EW._bare('x')}, '[{V.WHITESPACE}]+', ' ', 'g')),
      lambda x: length(x) BETWEEN 8 AND 350 AND NOT regexp_matches(lower(x), '^(cookie|javascript|your cart|we noticed that you are using)')) AS st
  FROM facts),
said AS (SELECT *, left(rtrim(coalesce(list_filter(st, lambda x: {sql_any('lower(x)', V.ROLE_LINE_TERMS)})[1],
    CASE WHEN f_trusted THEN st[1] END, ''), ' .'), 280) AS statement FROM heads),
best AS (SELECT * FROM heads WHERE named QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY score DESC, ordinal) = 1),
lines AS (SELECT lead_id, coalesce(arg_min(statement, (-score, ordinal)) FILTER (WHERE statement <> ''), '') AS statement FROM said GROUP BY lead_id)"""
_PRIORITY = f"concat_ws(' et ', CASE WHEN f_sector THEN {q(V.SIGNALS['sector'])} END, CASE WHEN f_exec THEN {q(V.SIGNALS['executive'])} END)"
_USABLE = "(n_relevant > 0 AND r.full_name <> '')"


@query("report_reasons", f"""WITH {_HEADS},
top AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY CASE WHEN is_person THEN 2 WHEN is_page THEN 1 ELSE 0 END DESC, score DESC, ordinal) AS rk FROM heads),
notes AS (SELECT lead_id, string_agg(left(CASE WHEN headline <> '' THEN headline ELSE concat({q(V.TEXT['note_head'])}, signals, '.') END, 500), '|' ORDER BY rk) AS notes
  FROM top WHERE rk <= 5 GROUP BY lead_id),
why AS (SELECT r.*, concat(CASE identity_status WHEN 'confirmed' THEN {q(V.TEXT['confirmed'])} WHEN 'probable' THEN {q(V.TEXT['probable'])}
    WHEN 'ambiguous' THEN {q(V.TEXT['ambiguous'])} ELSE {q(V.TEXT['unresolved'])} END,
    CASE WHEN {_PRIORITY} <> '' THEN concat({q(V.TEXT['priority_head'])}, {_PRIORITY}, {q(V.TEXT['priority_tail'])}) ELSE '' END) AS rationale
  FROM resolved r LEFT JOIN (SELECT lead_id, f_sector, f_exec FROM best) b USING (lead_id))
SELECT lead_id, CASE WHEN {_USABLE} THEN rationale ELSE '' END AS rationale, coalesce(notes, '') AS source_notes,
  CASE WHEN r.full_name = '' THEN {q(V.TEXT['no_input'])} WHEN n_relevant = 0 THEN {q(V.TEXT['no_relevant'])}
    ELSE concat_ws('|', concat(n_relevant, {q(V.TEXT['sources_tail'])}), rationale, CASE WHEN coalesce(sanctions_docs, 0) + coalesce(pep_docs, 0) > 0
      THEN {q(V.TEXT['screening_match'])} ELSE {q(V.TEXT['screening_none'])} END) END AS reasons
FROM why r LEFT JOIN notes USING (lead_id)""")
def report_reasons(spark, sf):
    """Rationale, reasons and source notes of every report."""
    r = F.col("report")
    return R.assemble(roles.untyped_documents(spark, sf), roles.evidence_leads(spark, sf)).select(
        "lead_id", r["identity_resolution"]["selected_profile_rationale"].alias("rationale"),
        F.array_join(F.transform(r["sources"], lambda s: s["note"]), "|").alias("source_notes"),
        F.array_join(r["kyc_assessment"]["key_reasons"], "|").alias("reasons"))


@query("report_person", f"""WITH {_HEADS}
SELECT r.lead_id, CASE WHEN single AND b.lead_id IS NOT NULL THEN r.full_name ELSE '' END AS match_name,
  CASE WHEN single THEN coalesce(b.headline, '') ELSE '' END AS match_headline,
  CASE WHEN single AND b.f_city THEN r.city ELSE '' END AS match_location, CASE WHEN single AND b.f_company THEN r.company_name ELSE '' END AS match_company,
  CASE WHEN known THEN statement ELSE '' END AS title, CASE WHEN known AND any_company THEN r.company_name ELSE '' END AS company,
  CASE WHEN known AND named_city THEN r.city ELSE '' END AS location, CASE WHEN known AND named_country THEN r.country ELSE '' END AS country
FROM (SELECT r.*, {_USABLE} AND NOT (identity_status = 'ambiguous' AND NOT has_context) AS single,
    {_USABLE} AND identity_status IN ('confirmed', 'probable') AS known FROM resolved r) r
  LEFT JOIN best b ON b.lead_id = r.lead_id LEFT JOIN lines l ON l.lead_id = r.lead_id""")
def report_person(spark, sf):
    """The matched person of a single match, and what the profile says of an identified one."""
    r = F.col("report")
    people, query = r["identity_resolution"]["matched_persons"], r["query_input"]
    separate = (r["identity_resolution"]["status"] == "ambiguous") & (
        (query["company_name"] == "") & (query["country"] == "") & (query["city"] == "") & (query["email"] == ""))
    one = F.when(~separate, F.get(people, F.lit(0)))

    def of(name):
        return F.coalesce(one[name], F.lit("")).alias(f"match_{name}")

    profile = r["person_profile"]
    return R.assemble(roles.untyped_documents(spark, sf), roles.evidence_leads(spark, sf)).select(
        "lead_id", *[of(n) for n in ("name", "headline", "location", "company")], profile["current_title"].alias("title"),
        profile["current_company"].alias("company"), profile["location"].alias("location"), profile["country"].alias("country"))


@query("summary_lines", f"""
WITH f AS (SELECT c_custkey AS lead_id, c_name, CASE c_nationkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'probable' WHEN 2 THEN 'ambiguous' ELSE 'unresolved' END AS st,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS m, CASE WHEN c_custkey % 3 = 0 THEN 'Maison.' ELSE '' END AS co,
  CASE WHEN c_custkey % 5 = 0 THEN repeat('mission ', 50) ELSE '' END AS mi, CASE WHEN c_custkey % 7 = 0 THEN 'Cannes' ELSE '' END AS lo,
  c_custkey % 11 = 0 AS sec, c_custkey % 13 = 0 AS exe, CASE c_custkey % 17 WHEN 0 THEN 'hit' WHEN 1 THEN 'possible_homonym' ELSE 'not_enough_data' END AS sa FROM customer)
SELECT lead_id, md5(concat_ws('|', concat('Client potentiel : ', c_name, CASE st WHEN 'confirmed' THEN {q(V.TEXT['line_confirmed'])} WHEN 'probable' THEN {q(V.TEXT['line_probable'])} WHEN 'ambiguous' THEN {q(V.TEXT['line_ambiguous'])} ELSE {q(V.TEXT['line_unresolved'])} END),
  CASE WHEN m <> '' THEN concat('Métier : ', m, '.') ELSE 'Activité indiquée : Works as broker.' END, CASE WHEN co <> '' THEN concat('Entreprise : ', co) END,
  CASE WHEN mi <> '' THEN concat('Rôle et missions majeures : ', rtrim(left(mi, 280)), '…') END, CASE WHEN lo <> '' THEN concat('Localisation : ', lo, '.') END,
  CASE WHEN sec THEN {q(V.TEXT['rel_sector'])} WHEN exe THEN {q(V.TEXT['rel_economic'])} ELSE {q(V.TEXT['rel_none'])} END,
  CASE sa WHEN 'hit' THEN {q(V.TEXT['sum_hit'])} WHEN 'possible_homonym' THEN {q(V.TEXT['sum_homonym'])} END)) AS summary FROM f""")
def summary_lines(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey AS lead_id", "c_name", "CASE c_nationkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'probable' WHEN 2 THEN 'ambiguous' ELSE 'unresolved' END AS st",
        "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS field_metier", "CASE WHEN c_custkey % 3 = 0 THEN 'Maison.' ELSE '' END AS field_entreprise",
        "CASE WHEN c_custkey % 5 = 0 THEN repeat('mission ', 50) ELSE '' END AS field_missions", "'' AS field_about",
        "CASE WHEN c_custkey % 7 = 0 THEN 'Cannes' ELSE '' END AS field_location", "'' AS person_statement", "'' AS company_statement", "'Works as broker' AS any_statement",
        "c_custkey % 11 = 0 AS any_sector", "c_custkey % 13 = 0 AS any_executive",
        "CASE c_custkey % 17 WHEN 0 THEN 'hit' WHEN 1 THEN 'possible_homonym' ELSE 'not_enough_data' END AS sa")
    lines = R.executive_summary(F.col("c_name"), F.col("st"), F.col("sa"), F.lit("not_enough_data"))
    return rows.select("lead_id", F.md5(F.array_join(lines, "|")).alias("summary"))


# --- contract ----------------------------------------------------------------------------

_RISK = "CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'weird' ELSE 'medium' END"
_IDENT = "CASE event_id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'probable' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'unresolved' ELSE 'other' END"
_SANC = "CASE event_id % 3 WHEN 0 THEN 'clear' WHEN 1 THEN 'hit' ELSE 'possible_homonym' END"


def candidate_reports(spark, sf):
    """Captured replies, one per event, that hold a report with unusable parts; two
    documents per event are its collected evidence."""
    rows = dealt(spark, sf, "events").selectExpr(
        "event_id AS lead_id", f"{_RISK} AS risk", f"{_IDENT} AS ident", f"{_SANC} AS sanc", "get_json_object(props, '$.k') AS k", "event_type", "value")
    report = F.to_json(F.struct(
        F.lit("x").alias("unknown_key"),
        F.struct(F.col("ident").alias("status"), (F.col("value") * 3 - 20).alias("confidence_score"),
                 F.array(F.struct(F.lit(" N ").alias("name"), F.array(F.lit(" a "), F.lit(" ")).alias("evidence"))).alias("matched_persons")).alias("identity_resolution"),
        F.struct(F.struct(F.col("sanc").alias("status"), F.array(F.lit("d")).alias("details")).alias("sanctions")).alias("risk_screening"),
        F.array(F.struct(F.lit("bad").alias("category"), F.lit(" T ").alias("title"),
                         F.concat(F.lit("https://news.example/"), F.col("lead_id").cast("string")).alias("source_url")),
                F.struct(F.lit("civil").alias("category"), F.lit("gone").alias("title"), F.lit("https://unknown.example/").alias("source_url"))).alias("adverse_media"),
        F.struct(F.col("risk").alias("overall_risk"), F.lit("standard").alias("recommended_review"),
                 F.array(F.lit(" s "), F.lit("")).alias("executive_summary")).alias("kyc_assessment"),
        F.array(F.struct(F.lit("other").alias("type"), F.concat(F.lit("https://News.example//"), F.col("lead_id").cast("string"), F.lit("/")).alias("url"), F.lit(" note ").alias("note")),
                F.struct(F.lit("other").alias("type"), F.lit("https://unknown.example/2").alias("url"), F.lit("n").alias("note")),
                F.struct(F.lit("other").alias("type"), F.concat(F.lit("https://list.example/"), F.col("lead_id").cast("string")).alias("url"), F.lit("l").alias("note"))).alias("sources"),
    ))
    reply = F.when(F.col("lead_id") % 2 == 0, F.concat(F.lit("```json\n"), report, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), report, F.lit(" done")))
    leads = rows.selectExpr("lead_id", "concat('Person ', k) AS full_name", "'' AS email", "'' AS company_name", "'' AS country", "'' AS city")
    docs = rows.selectExpr("lead_id", "inline(array(named_struct('ordinal', 1L, 'url', concat('https://news.example/', CAST(lead_id AS STRING)), 'source_type', 'news'), "
                           "named_struct('ordinal', 2L, 'url', CASE WHEN lead_id % 7 = 0 THEN 'https://elsewhere.example/' ELSE concat('https://list.example/', CAST(lead_id AS STRING)) END, 'source_type', 'sanctions_db')))")
    return rows.select("lead_id", reply.alias("reply")), leads, docs


_S1 = f"CASE WHEN {_SANC} = 'clear' OR event_id % 7 = 0 THEN 'not_enough_data' WHEN {_SANC} = 'hit' AND {_IDENT} NOT IN ('confirmed', 'probable') THEN 'possible_homonym' ELSE {_SANC} END"
_I1 = f"CASE WHEN {_IDENT} = 'other' THEN 'unresolved' ELSE {_IDENT} END"
_R0 = f"CASE WHEN {_RISK} = 'weird' THEN 'undetermined' ELSE {_RISK} END"
_R1 = f"CASE WHEN {_R0} = 'low' AND {_I1} IN ('ambiguous', 'unresolved') THEN 'undetermined' WHEN {_R0} = 'low' THEN 'medium' ELSE {_R0} END"


@query("contract_projection", f"""
SELECT event_id AS lead_id, {_I1} AS identity_status, CAST(trunc(least(greatest(value * 3 - 20, 0), 100)) AS INT) AS confidence_score, {_S1} AS sanctions_status,
  CASE WHEN {_S1} = 'not_enough_data' THEN '' ELSE 'd' END AS sanctions_details, {_R1} AS overall_risk,
  CASE WHEN {_R1} = 'high' THEN 'enhanced_due_diligence' WHEN {_I1} = 'ambiguous' THEN 'manual_review' WHEN {_I1} = 'unresolved' THEN 'insufficient_data'
    WHEN {_R0} = 'low' THEN 'manual_review' ELSE 'standard' END AS recommended_review,
  concat('news https://news.example/', event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('|sanctions_db https://list.example/', event_id) END) AS sources,
  concat('reputational T low media_report https://news.example/', event_id) AS adverse, 's' AS summary, 'N: a' AS persons,
  CASE WHEN (CASE WHEN {_R1} = 'high' THEN 'x' WHEN {_I1} = 'unresolved' THEN 'insufficient_data' ELSE 'x' END) = 'insufficient_data' THEN 'insufficient_data' ELSE 'completed' END AS job_status
FROM events""")
def contract_projection(spark, sf):
    from ..operators.attempts import job_status
    replies, leads, docs = candidate_reports(spark, sf)
    found = replies.select("lead_id", K.recover_json(F.col("reply")).alias("candidate"))
    out = K.normalise(found, leads, docs)
    r = F.col("report")
    return out.select(
        "lead_id", r["identity_resolution"]["status"].alias("identity_status"),
        r["identity_resolution"]["confidence_score"].alias("confidence_score"),
        r["risk_screening"]["sanctions"]["status"].alias("sanctions_status"),
        F.array_join(r["risk_screening"]["sanctions"]["details"], "|").alias("sanctions_details"),
        r["kyc_assessment"]["overall_risk"].alias("overall_risk"),
        r["kyc_assessment"]["recommended_review"].alias("recommended_review"),
        F.array_join(F.transform(r["sources"], lambda s: F.concat_ws(" ", s["type"], s["url"])), "|").alias("sources"),
        F.array_join(F.transform(r["adverse_media"], lambda a: F.concat_ws(" ", a["category"], a["title"], a["confidence"], a["status_type"], a["source_url"])), "|").alias("adverse"),
        F.array_join(r["kyc_assessment"]["executive_summary"], "|").alias("summary"),
        F.array_join(F.transform(r["identity_resolution"]["matched_persons"], lambda p: F.concat(p["name"], F.lit(": "), F.array_join(p["evidence"], ","))), "|").alias("persons"),
        job_status(r["kyc_assessment"]["recommended_review"], r["query_input"]["full_name"]).alias("job_status"))


@query("grounding", f"""
WITH c AS (SELECT page_id % 20 AS lead_id, page_id, lower(url) AS u FROM pages),
d AS (SELECT page_id % 20 AS lead_id, page_id, url FROM pages WHERE NOT contains(url, 'www.'))
SELECT page_id AS position, lead_id, rtrim(split_part(url, '#', 1), '/') AS canonical FROM d""")
def grounding(spark, sf):
    pages = table(spark, sf, "pages")
    claimed = pages.selectExpr("page_id % 20 AS lead_id", "'source' AS kind", "page_id AS position", "concat(' ', url, '#claimed') AS url")
    docs = pages.selectExpr(
        "page_id % 20 AS lead_id", "page_id AS ordinal", "'other' AS source_type",
        "CASE WHEN contains(url, 'www.') THEN concat('https://else.example/', CAST(page_id AS STRING)) ELSE url END AS url")
    out = K.grounded_claims(claimed, docs)
    return out.select("position", "lead_id", F.rtrim(F.substring_index("url", "#", 1), F.lit("/")).alias("canonical"))


# --- providers ---------------------------------------------------------------------------

_ROLE = "CASE event_id % 5 WHEN 0 THEN ' Victim ' WHEN 1 THEN 'subject' WHEN 2 THEN '' ELSE 'defendant' END"
_CAT = "CASE event_id % 6 WHEN 0 THEN 'Money Laundering' WHEN 1 THEN 'tax' WHEN 2 THEN 'regulatory-enforcement' WHEN 3 THEN 'litigation' WHEN 4 THEN 'unknown' ELSE 'fraud' END"


@query("adverse_normalise", f"""
WITH h AS (SELECT user_id AS lead_id, event_id AS record, p AS position,
    CASE WHEN p = 0 THEN concat('https://n.example/', CAST(event_id % 40 AS VARCHAR)) ELSE CASE WHEN event_id % 8 = 0 THEN '' ELSE concat('https://m.example/', CAST(event_id AS VARCHAR)) END END AS url,
    {_ROLE} AS role, {_CAT} AS cat, CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'severe' ELSE 'medium' END AS sev, CASE WHEN p = 1 AND event_id % 9 = 0 THEN 'low' ELSE 'high' END AS m
  FROM events, (SELECT unnest([0, 1]) AS p)),
k AS (SELECT * FROM h WHERE url <> '' AND lower(trim(role)) NOT IN {sql_list(V.NON_ADVERSE_ROLES)} AND m <> 'low'
  QUALIFY row_number() OVER (PARTITION BY lead_id, url ORDER BY record, position) = 1)
SELECT lead_id, record, position, url AS source_url, CASE cat WHEN 'Money Laundering' THEN 'criminal' WHEN 'tax' THEN 'fiscal' WHEN 'regulatory-enforcement' THEN 'regulatory' WHEN 'litigation' THEN 'civil' WHEN 'fraud' THEN 'criminal' ELSE 'reputational' END AS category,
  CASE sev WHEN 'HIGH' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS confidence, 'FR' AS jurisdiction FROM k""")
def adverse_normalise(spark, sf):
    def hit(url, match):
        return F.struct(
            url.alias("url"), F.expr(_ROLE).alias("entityRole"), F.expr(_CAT).alias("riskCategory"),
            F.expr("CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'severe' ELSE 'medium' END").alias("severity"), match.alias("entityMatchConfidence"))
    one = hit(F.concat(F.lit("https://n.example/"), (F.col("event_id") % 40).cast("string")), F.lit("high"))
    two = hit(F.when(F.col("event_id") % 8 == 0, "").otherwise(F.concat(F.lit("https://m.example/"), F.col("event_id").cast("string"))),
              F.when(F.col("event_id") % 9 == 0, "low").otherwise("high"))
    text = F.to_json(F.struct(F.lit(" FR ").alias("country"), F.array(one, two).alias("hits")))
    records = dealt(spark, sf, "events").select(
        F.col("user_id").alias("lead_id"), F.col("event_id").alias("record"), F.from_json(text, ADVERSE_RECORD).alias("item"))
    return P.adverse_items(records, ["lead_id"]).select(
        "lead_id", "record", "position", "source_url", "category", "confidence", "jurisdiction")


@query("company_flatten", """
SELECT c_custkey, c_name AS company_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS industry,
  CASE WHEN c_custkey % 2 = 0 THEN concat('1 rue, Ville ', c_nationkey, ', FR') ELSE '' END AS address, CASE WHEN c_custkey % 2 = 0 THEN 'FR' ELSE '' END AS jurisdiction,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(1950 + c_nationkey AS VARCHAR) END AS incorporation_date,
  CASE WHEN c_acctbal > 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) + 1 AS VARCHAR) ELSE '' END AS employees FROM customer""")
def company_flatten(spark, sf):
    c = F.col
    text = F.to_json(F.struct(
        F.concat(F.lit(" "), c("c_name")).alias("name"),
        F.when(c("c_custkey") % 3 == 0, F.array(F.struct(c("c_mktsegment").alias("name")))).alias("industries"),
        F.when(c("c_custkey") % 2 == 0, F.array(F.struct(
            F.lit("1 rue").alias("line1"), F.lit(" ").alias("line2"), F.concat(F.lit("Ville "), c("c_nationkey").cast("string")).alias("city"),
            F.lit("FR").alias("country")), F.struct(F.lit("2").alias("line1"), F.lit("").alias("line2"), F.lit("x").alias("city"), F.lit("DE").alias("country")))).alias("locations"),
        F.when(c("c_custkey") % 5 != 0, F.struct((c("c_nationkey") + 1950).alias("year"))).alias("foundedOn"),
        F.when(c("c_acctbal") > 0, F.floor("c_acctbal") + 1).otherwise(F.lit(-1)).cast("long").alias("employeeCount")))
    out = table(spark, sf, "customer").select("c_custkey", F.from_json(text, COMPANY_ITEM).alias("item"))
    facts_ = out.select("c_custkey", P.company_facts(F.col("item")).alias("f"))
    return facts_.select("c_custkey", *[F.col(f"f.{n}").alias(n) for n in ("company_name", "industry", "address", "jurisdiction", "incorporation_date")],
                         F.col("f.financials.employees").alias("employees"))


_HEAD = "CASE o_orderkey % 6 WHEN 0 THEN 'Founder' WHEN 1 THEN 'Directeur general manager' WHEN 2 THEN 'Senior sailor' WHEN 3 THEN 'Yacht owner' ELSE 'Baker' END"


@query("profile_select", f"""
WITH p AS (SELECT o_custkey AS lead_id, o_orderkey AS ordinal, {_HEAD} AS h, concat('https://p.example/', CAST(o_orderkey % 50 AS VARCHAR)) AS url,
   CASE WHEN o_orderkey % 10 = 0 THEN 'Cannes' ELSE 'Paris' END AS loc FROM orders),
s AS (SELECT *, contains(loc, 'Cannes') AND lead_id % 2 = 0 AS corroborated,
  CASE h WHEN 'Founder' THEN 3 WHEN 'Yacht owner' THEN 5 WHEN 'Directeur general manager' THEN 2 WHEN 'Senior sailor' THEN 1 ELSE 0 END AS importance FROM p),
a AS (SELECT *, bool_or(corroborated) OVER (PARTITION BY lead_id) AS any_c FROM s),
k AS (SELECT * FROM a WHERE corroborated = any_c AND (corroborated OR importance > 0))
SELECT lead_id, ordinal, corroborated, importance, row_number() OVER (PARTITION BY lead_id ORDER BY CASE WHEN corroborated THEN 0 ELSE -importance END, ordinal) AS rank,
  concat('X ', lead_id, '\n', h, '\nMétier: ', h, '\nEntreprise: Co\nLocation: ', loc, '\n', 'Co') AS profile_text FROM k QUALIFY rank <= 3""")
def profile_select(spark, sf):
    rows = dealt(spark, sf, "orders").selectExpr(
        "o_custkey AS lead_id", "o_orderkey AS ordinal", f"{_HEAD} AS h", "CASE WHEN o_orderkey % 10 = 0 THEN 'Cannes' ELSE 'Paris' END AS loc")
    text = F.to_json(F.struct(
        F.lit("").alias("name"), F.lit("X").alias("firstName"), F.col("lead_id").cast("string").alias("lastName"), F.col("h").alias("headline"),
        F.struct(F.col("loc").alias("linkedinText")).alias("location"), F.array(F.struct(F.lit("").alias("position"), F.lit("Co").alias("companyName"))).alias("currentPosition"),
        F.concat(F.lit("https://p.example/"), (F.col("ordinal") % 50).cast("string")).alias("linkedinUrl")))
    profiles = P.flatten_profiles(rows.select("lead_id", "ordinal", F.from_json(text, PROFILE_ITEM).alias("item")))
    leads = rows.select("lead_id").distinct().selectExpr(
        "lead_id", "'' AS company_name", "'' AS country", "CASE WHEN lead_id % 2 = 0 THEN 'CANNES' ELSE '' END AS city")
    return P.select_profiles(profiles, leads, 3).select("lead_id", "ordinal", "corroborated", "importance", "rank", "profile_text")


@query("name_orders", """
SELECT c_custkey, a AS attempt, CASE a WHEN 1 THEN f ELSE r END AS first_name, CASE a WHEN 1 THEN r ELSE f END AS last_name
FROM (SELECT c_custkey, 'Jean' AS f, concat('de ', c_mktsegment) AS r FROM customer WHERE c_custkey % 2 = 0), (SELECT unnest([1, 2]) AS a)""")
def name_orders(spark, sf):
    from ..functions.text import name_orders as orders
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN concat(' Jean  de ', c_mktsegment) ELSE c_mktsegment END AS n")
    return rows.select("c_custkey", F.explode(orders(F.col("n"))).alias("o")).select("c_custkey", "o.*")


@query("enrichment_merge", f"""
WITH base AS (SELECT event_id, {_I1} AS st FROM events)
SELECT event_id AS lead_id, CASE WHEN st IN ('confirmed', 'probable') THEN concat('Co ', event_id) ELSE '' END AS company_name,
  CASE WHEN st IN ('confirmed', 'probable') THEN '7' ELSE '' END AS employees,
  CASE WHEN st IN ('confirmed', 'probable') AND event_id % 3 = 0 THEN 2 ELSE 1 END AS adverse_items,
  (CASE WHEN event_id % 7 = 0 THEN 1 ELSE 2 END) + (CASE WHEN st IN ('confirmed', 'probable') AND event_id % 3 = 0 THEN 1 ELSE 0 END) AS sources FROM base""")
def enrichment_merge(spark, sf):
    replies, leads, docs = candidate_reports(spark, sf)
    reports = K.normalise(replies.select("lead_id", K.recover_json(F.col("reply")).alias("candidate")), leads, docs)
    companies = table(spark, sf, "events").select(
        F.col("event_id").alias("lead_id"),
        F.struct(F.concat(F.lit("Co "), F.col("event_id").cast("string")).alias("company_name"),
                 F.struct(F.lit("7").alias("employees")).alias("financials")).alias("company"))
    items = table(spark, sf, "events").selectExpr(
        "event_id AS lead_id", "inline(array(named_struct('ordinal', 1, 'source_url', concat('https://news.example/', CAST(event_id AS STRING))), "
        "named_struct('ordinal', 2, 'source_url', CASE WHEN event_id % 3 = 0 THEN 'https://fresh.example/' ELSE concat('https://news.example/', CAST(event_id AS STRING)) END)))")
    items = items.selectExpr("*", "'civil' AS category", "'t' AS title", "'s' AS summary", "'' AS date", "'' AS jurisdiction", "'low' AS confidence", "'media_report' AS status_type")
    out = K.merge_adverse(K.enrich_company(reports, companies), items)
    return out.select(
        "lead_id", F.col("report.company_profile.company_name").alias("company_name"),
        F.col("report.company_profile.financials.employees").alias("employees"),
        F.size("report.adverse_media").alias("adverse_items"), F.size("report.sources").alias("sources"))
