"""The supplied tables in the roles the jobs expect.

nation = broker, part/supplier = listing, orders and customer = lead and contact,
events = screening attempts, documents/pages = evidence (lead = source or page_id % 20).
Everything is derived row by row from the tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_table
from ..plans.barrier import fenced
from ..plans.joins import with_group_facts
from ..session import materialise
from ..functions import vocab as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for heavy work on every row.  A file of one row group is one task however many cores
    there are; a session that reads such files can set ``keelson.read.partitions`` to deal the rows
    out.  Without the setting the scan stays as it is."""
    tasks = spark.conf.get("keelson.read.partitions", None)
    rows = table(spark, sf_dir, name)
    return rows.repartition(int(tasks)) if tasks else rows




# --- SQL helpers for the comparison queries ------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fold(expr: str, variant: str = "evidence") -> str:
    """The folding job as portable SQL."""
    from ..functions.text import FOLD_VARIANTS
    form, keep = FOLD_VARIANTS[variant]
    out = f"lower({expr})"
    if form:
        source, target, expansions = fold_table(form)
        for ch, base in expansions:
            out = f"replace({out}, {q(ch)}, {q(base)})"
        out = f"translate({out}, {q(source)}, {q(target)})"
    if keep is None:
        return out
    kept = keep.replace("-", "\\-")
    return f"trim(regexp_replace({out}, '[^a-z0-9{kept}]+', ' ', 'g'))"


def sql_any(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(t)})" for t in terms) + ")"


def sql_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def sql_squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[{V.WHITESPACE}]+', ' ', 'g'))"


# --- leads: orders with their customer ------------------------------------------------

LEAD_STATUS = (
    "CASE WHEN o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'NEW' "
    "WHEN o_orderstatus = 'O' THEN 'CONTACTED' WHEN o_orderstatus = 'P' THEN 'QUALIFIED' "
    "WHEN o_orderpriority = '5-LOW' THEN 'LOST' ELSE 'CONVERTED' END"
)
# e-mail of a customer: blank, with a test address, else on one of four domains
CUSTOMER_EMAIL = (
    "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 11 = 1 THEN 'test@example.com' "
    "WHEN c_custkey % 4 = 0 THEN concat('c', cast(c_custkey AS VARCHAR(20)), '@gmail.com') "
    "WHEN c_custkey % 4 = 1 THEN concat('c', cast(c_custkey AS VARCHAR(20)), '@Corp', cast(c_custkey % 7 AS VARCHAR(20)), '.example.com') "
    "WHEN c_custkey % 4 = 2 THEN concat('c', cast(c_custkey AS VARCHAR(20)), '@@bad') "
    "ELSE concat('c', cast(c_custkey AS VARCHAR(20)), '@nohost') END"
)
PRICE_TEXT = (
    "CASE p_partkey % 8 "
    "WHEN 0 THEN concat(cast(cast(floor(p_retailprice) AS BIGINT) AS VARCHAR(20)), 'K€ Ex VAT') "
    "WHEN 1 THEN concat(cast(p_size AS VARCHAR(20)), '.050M€') "
    "WHEN 2 THEN concat(cast(p_size AS VARCHAR(20)), ',5M €') "
    "WHEN 3 THEN concat('$', cast(p_size AS VARCHAR(20)), ',500,000') "
    "WHEN 4 THEN concat(cast(p_size AS VARCHAR(20)), '.850.000,50') "
    "WHEN 5 THEN concat(cast(cast(floor(p_retailprice) AS BIGINT) AS VARCHAR(20)), ',50') "
    "WHEN 6 THEN 'POA' "
    "ELSE cast(cast(floor(p_retailprice) AS BIGINT) AS VARCHAR(20)) END"
)


def brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS id", "n_name AS broker_name",
        "concat(lower(n_name), CASE WHEN n_nationkey % 2 = 0 THEN '@one.example' ELSE '@two.example' END) AS email")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to their customer, as flat leads."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey", f"{LEAD_STATUS} AS status", "o_orderpriority AS source",
        "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Portal ', o_orderpriority) END AS detailed_source_summary",
        "o_orderdate AS received_at", "o_totalprice")
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name AS contact_display_name", "c_nationkey AS broker_id",
        "c_mktsegment AS boat_make", f"{CUSTOMER_EMAIL} AS contact_email")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).drop("o_custkey")


LEADS_SQL = (
    f"SELECT o_orderkey AS id, {LEAD_STATUS} AS status, o_orderpriority AS source, "
    "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Portal ', o_orderpriority) END AS detailed_source_summary, "
    "o_orderdate AS received_at, o_totalprice, c_custkey, c_name AS contact_display_name, "
    f"c_nationkey AS broker_id, c_mktsegment AS boat_make, {CUSTOMER_EMAIL} AS contact_email "
    "FROM orders JOIN customer ON o_custkey = c_custkey"
)

# --- evidence: documents of a lead (lead = source) ---------------------------------------

EMAIL_RE = r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
DOCUMENT_URL = (
    "concat('https://', CASE doc_id % 8 "
    "WHEN 0 THEN 'www.linkedin.com/in/p' WHEN 1 THEN 'fr.linkedin.com/company/c' "
    "WHEN 2 THEN 'www.mail5.example.com/about/' WHEN 3 THEN 'sanctionssearch.ofac.treas.gov/d/' "
    "WHEN 4 THEN 'www.opensanctions.org/entities/' WHEN 5 THEN 'find.companieshouse.gov.uk/c/' "
    "WHEN 6 THEN concat(source, '.example.org/') ELSE 'www.reuters.com/a/' END, "
    "cast(doc_id AS VARCHAR(20)))"
)


def evidence_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lead per document source; its facts come from its own first document and the
    first mail address in its documents.  Three in four keep company, country and city."""
    docs = dealt(spark, sf_dir, "documents").select(
        "source", "doc_id", "lang", F.when(F.contains("text", F.lit("@")), F.nullif(F.regexp_extract("text", EMAIL_RE, 0), F.lit(""))).alias("mail"),
        F.regexp_extract("text", r"^\S*(?:\s+\S*){0,3}", 0).alias("w"))
    first = fenced(docs).groupBy("source").agg(
        F.min_by(F.struct(F.regexp_replace("w", r"\s+", " ").alias("w"), "lang"), F.col("doc_id")).alias("f"),
        F.min_by("mail", F.when(F.col("mail").isNotNull(), F.col("doc_id"))).alias("email"),
        F.min("doc_id").alias("first_id"))
    words = F.split(F.col("f.w"), " ")

    def word(i):
        return F.coalesce(F.get(words, F.lit(i)), F.lit(""))

    keep = F.col("first_id") % 4 != 0
    return materialise(first.select(
        F.col("source").alias("lead_id"),
        F.concat_ws(" ", word(0), word(1)).alias("full_name"),
        F.coalesce("email", F.lit("")).alias("email"),
        F.when(keep, word(2)).otherwise("").alias("company_name"),
        F.when(keep, F.col("f.lang")).otherwise("").alias("country"),
        F.when(keep, word(3)).otherwise("").alias("city")))


EVIDENCE_LEADS_SQL = f"""
first_docs AS (
  SELECT source, string_split(regexp_replace(arg_min(text, doc_id), '\\s+', ' ', 'g'), ' ') AS w,
         arg_min(lang, doc_id) AS lang,
         arg_min(regexp_extract(text, {q(EMAIL_RE)}), doc_id) FILTER (WHERE regexp_extract(text, {q(EMAIL_RE)}) <> '') AS email,
         min(doc_id) AS first_id
  FROM documents GROUP BY source),
ev_leads AS (
  SELECT source AS lead_id, concat_ws(' ', coalesce(w[1], ''), coalesce(w[2], '')) AS full_name,
         coalesce(email, '') AS email,
         CASE WHEN first_id % 4 <> 0 THEN coalesce(w[3], '') ELSE '' END AS company_name,
         CASE WHEN first_id % 4 <> 0 THEN lang ELSE '' END AS country,
         CASE WHEN first_id % 4 <> 0 THEN coalesce(w[4], '') ELSE '' END AS city
  FROM first_docs)"""


def untyped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a URL; scoring adds the source type in its own join."""
    return dealt(spark, sf_dir, "documents").selectExpr(
        "source AS lead_id", "doc_id AS ordinal", f"{DOCUMENT_URL} AS url", "text")


def evidence_documents(spark: SparkSession, sf_dir: str, own_domains: DataFrame | None = None) -> DataFrame:
    """Documents with a URL and its source type."""
    from ..functions.text import email_domain
    from ..functions.urls import parse_url, source_type
    docs = untyped_documents(spark, sf_dir)
    people = own_domains if own_domains is not None else evidence_leads(spark, sf_dir)
    own = people.select("lead_id", email_domain(F.col("email")).alias("_domain"))
    docs = with_group_facts(docs, own, "lead_id", "ordinal")
    docs = parse_url(docs, "url", "_u")
    return docs.withColumn("source_type", source_type(F.col("_u"), F.col("_domain"))).drop("_u", "_domain")


SQL_EMAIL_DOMAIN = (
    "CASE WHEN length({e}) - length(replace({e}, '@', '')) = 1 AND "
    "regexp_matches(rtrim(lower(trim(split_part({e}, '@', 2))), '.'), '^[a-z0-9.\\-]+\\.[a-z]{{2,}}$') "
    "THEN rtrim(lower(trim(split_part({e}, '@', 2))), '.') ELSE '' END"
)


def sql_domain(expr: str) -> str:
    return SQL_EMAIL_DOMAIN.format(e=expr)


def sql_host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#]*@)?([^:/?#@]*)', 1))"


def sql_path(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


def sql_in_domain(host: str, domain: str) -> str:
    return f"({domain} <> '' AND ({host} = {domain} OR ends_with({host}, concat('.', {domain}))))"


def sql_source_type(host: str, path: str, domain: str) -> str:
    return (
        f"CASE WHEN ends_with({host}, 'linkedin.com') THEN 'linkedin' "
        f"WHEN {sql_in_domain(host, domain)} THEN 'company_website' "
        f"WHEN {sql_any(host, V.MARITIME_HOSTS)} THEN 'maritime_db' "
        f"WHEN {sql_any(host, V.PEP_HOSTS)} THEN 'pep_db' "
        f"WHEN {sql_any(host, V.SANCTION_HOSTS)} AND contains(concat({host}, lower({path})), 'sanction') THEN 'sanctions_db' "
        f"WHEN {sql_any(host, V.REGISTRY_HOSTS)} THEN 'official_registry' "
        f"WHEN {sql_any(host, V.COURT_HOSTS)} THEN 'court_record' "
        f"WHEN {sql_any(host, V.NEWS_HOSTS)} THEN 'news' ELSE 'other' END")


EVIDENCE_DOCS_SQL = EVIDENCE_LEADS_SQL + f""",
ev_docs AS (
  SELECT d.*, {sql_source_type('host', 'path', 'domain')} AS source_type FROM (
    SELECT source AS lead_id, doc_id AS ordinal, {DOCUMENT_URL} AS url, text,
           {sql_host(DOCUMENT_URL)} AS host, {sql_path(DOCUMENT_URL)} AS path, l.domain AS domain
    FROM documents JOIN (SELECT lead_id, {sql_domain('email')} AS domain FROM ev_leads) l ON l.lead_id = source) d)"""

EVIDENCE_SCORED_SQL = EVIDENCE_DOCS_SQL + f""",
ev_terms AS (
  SELECT lead_id, {sql_fold('full_name')} AS n, lower(email) AS e, {sql_fold('company_name')} AS co,
         {sql_fold('country')} AS cy, {sql_fold('city')} AS ci FROM ev_leads),
ev_folded AS (
  SELECT d.*, {sql_fold('text')} AS t, lower(text) AS lt FROM ev_docs d),
ev_flags AS (
  SELECT d.lead_id, d.ordinal, d.url, d.host, d.path, d.domain, d.source_type, d.text, n,
         (e <> '' AND contains(lt, e)) AS f_email,
         (n <> '' AND contains(t, n)) AS f_exact,
         (NOT (n <> '' AND contains(t, n))
          AND len(list_filter(string_split(n, ' '), lambda x: length(x) >= 2)) >= 2
          AND len(list_filter(string_split(n, ' '), lambda x: length(x) >= 2 AND NOT contains(t, x))) = 0) AS f_tokens,
         (co <> '' AND contains(t, co)) AS f_company,
         {sql_in_domain('host', 'domain')} AS f_domain,
         (cy <> '' AND contains(t, cy)) AS f_country, (ci <> '' AND contains(t, ci)) AS f_city,
         {sql_any('t', V.SECTOR_TERMS)} AS f_sector, {sql_any('t', V.EXECUTIVE_TERMS)} AS f_exec,
         {sql_any('t', V.OFF_TOPIC_TERMS)} AS f_off,
         source_type IN ('official_registry', 'company_website', 'linkedin') AS f_trusted
  FROM ev_folded d JOIN ev_terms USING (lead_id)),
ev_scored AS (
  SELECT *, CASE WHEN f_email THEN 55 ELSE 0 END + CASE WHEN f_exact THEN 35 ELSE 0 END
    + CASE WHEN f_tokens THEN 22 ELSE 0 END + CASE WHEN f_company THEN 15 ELSE 0 END
    + CASE WHEN f_domain THEN 25 ELSE 0 END + CASE WHEN f_country THEN 4 ELSE 0 END
    + CASE WHEN f_city THEN 4 ELSE 0 END + CASE WHEN f_sector THEN 8 ELSE 0 END
    + CASE WHEN f_exec THEN 4 ELSE 0 END - CASE WHEN f_off THEN 20 ELSE 0 END
    + CASE WHEN f_trusted THEN 5 ELSE 0 END AS score,
    concat_ws(', ', CASE WHEN f_email THEN 'email exact' END, CASE WHEN f_exact THEN 'nom exact' END,
      CASE WHEN f_tokens THEN 'nom complet' END, CASE WHEN f_company THEN 'entreprise' END,
      CASE WHEN f_domain THEN 'domaine email professionnel' END, CASE WHEN f_country THEN 'pays' END,
      CASE WHEN f_city THEN 'ville' END, CASE WHEN f_sector THEN 'proximité yachting' END,
      CASE WHEN f_exec THEN 'profil économique documenté' END) AS signals
  FROM ev_flags)"""
