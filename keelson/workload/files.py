"""Jobs that write files and read them back, and the rule sets of the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import evidence as E
from ..operators import leads as L
from ..operators import providers as P
from ..operators import validation as R
from ..schemas import LISTING_CSV
from ..session import fresh_path
from ..sources import files
from . import leads as LW
from . import roles
from .roles import sql_list, table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


# a part as a row of the listings file, in SQL that both engines read
_PART = {
    "nom_bateau": "CASE WHEN p_partkey % 13 = 0 THEN ' ' WHEN p_partkey % 17 = 0 THEN 'a \"b\", c' ELSE p_name END",
    "constructeur": "CASE WHEN p_partkey % 11 = 0 THEN 'N/A' ELSE p_brand END",
    "longueur_m": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(CAST(p_size AS VARCHAR(9)), ',5') END",
    "annee": "CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE concat(CAST(1990 + p_size AS VARCHAR(9)), '.0') END",
    "proprietaire": "CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END",
    "broker": "concat('NATION_', CAST(p_partkey % 30 AS VARCHAR(9)))",
    "prix_actuel": "CASE WHEN p_partkey % 2 = 0 THEN concat(CAST(p_size AS VARCHAR(9)), '.5M€') ELSE 'N/A' END",
    "commentaire": "CASE WHEN p_partkey % 4 = 0 THEN 'é, \"x\"' ELSE '' END",
}
_HEADERS = {name: header for header, name in LISTING_CSV.items()}


def listing_rows(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", *[f"{sql} AS `{_HEADERS[n]}`" for n, sql in _PART.items()])


_NA = sql_list(["", V.NOT_AVAILABLE])
_RAW = ", ".join(f"{sql} AS {n}" for n, sql in _PART.items())


def _kept(c, otherwise="NULL"):
    return f"CASE WHEN trim({c}) IN {_NA} THEN {otherwise} ELSE trim({c}) END"


_TYPED = f"""{_kept('nom_bateau')} AS nom_bateau, {_kept('constructeur')} AS constructeur,
  CASE WHEN longueur_m <> '' THEN CAST(replace(longueur_m, ',', '.') AS DOUBLE) END AS longueur_m,
  CASE WHEN annee <> 'unknown' THEN CAST(split_part(annee, '.', 1) AS INT) END AS annee,
  {_kept('proprietaire', "'" + V.NOT_AVAILABLE + "'")} AS proprietaire, n_nationkey AS broker_id,
  {_kept('prix_actuel')} AS prix_actuel, {_kept('commentaire')} AS commentaire,
  CASE WHEN trim(nom_bateau) = '' OR trim(constructeur) IN {_NA} THEN 'skipped' ELSE 'imported' END AS outcome"""


def typed(rows, brokers, *more):
    missing = [c for c in ("capitaine", "localisation", "prix_precedent", "dernier_message") if c not in rows.columns]
    out = files.import_listings(rows.withColumns({c: F.lit(None).cast("string") for c in missing}), brokers)
    return out.select(*more, "nom_bateau", "constructeur", F.col("longueur_m").cast("double").alias("longueur_m"), "annee",
                      "proprietaire", "broker_id", "prix_actuel", "commentaire", "outcome")


@query("listing_import", f"""
WITH r AS (SELECT {_RAW} FROM part) SELECT {_TYPED} FROM r LEFT JOIN nation ON n_name = broker""")
def listing_import(spark, sf):
    """Listings file written, read back and typed."""
    path = fresh_path(spark, "csv")
    listing_rows(spark, sf).drop("p_partkey").write.csv(path, header=True, escape='"')
    return typed(files.read_listing_csv(spark, path), roles.brokers(spark, sf))


@query("export_round_trip", f"""
WITH r AS (SELECT p_partkey, {_RAW} FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS external_id, strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * p_partkey, '%Y-%m-%d %H:%M:%S') AS created_at,
  (SELECT count(*) FROM part) AS records, {_TYPED} FROM r LEFT JOIN nation ON n_name = broker""")
def export_round_trip(spark, sf):
    """JSON export with its record count, imported again."""
    path = fresh_path(spark, "json")
    rows = listing_rows(spark, sf).withColumn(
        "created", F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("p_partkey")))
    records = files.write_export(rows, path, "p_partkey", "created")
    out = typed(files.read_export(spark, path), roles.brokers(spark, sf), "external_id", "created_at")
    return out.withColumn("created_at", LW.day("created_at")).withColumn("records", F.lit(records).cast("long"))


@query("report_sink", """
SELECT event_id AS id, concat('v', CAST(event_id % 3 AS VARCHAR)) AS schema_version, concat('{"score":', CAST(event_id % 100 AS VARCHAR), '}') AS report,
  unnest([1, 2]) AS run FROM events""")
def report_sink(spark, sf):
    """Two runs of versioned reports in one sink; every attempt stays."""
    path = fresh_path(spark, "reports")
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("schema_version"),
        F.struct((F.col("event_id") % 100).cast("int").alias("score")).alias("report"))
    for run in (1, 2):
        files.append_reports(rows.withColumn("run", F.lit(run)), path)
    return spark.read.schema("id long, report string, run int, schema_version string").parquet(path).select(
        "id", "schema_version", "report", "run")


@query("profile_swap", """
WITH s AS (SELECT o_custkey AS lead_id, o_orderkey AS ordinal, concat('https://p.example/', o_orderkey % 50) AS profile_url, concat('short ', o_orderkey) AS t FROM orders),
f AS (SELECT o_custkey AS lead_id, concat('https://p.example/', o_orderkey % 50) AS profile_url, o_orderkey FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT lead_id, profile_url, concat('rich ', min(o_orderkey)) AS rich FROM f GROUP BY ALL)
SELECT s.lead_id, s.ordinal, s.profile_url, coalesce(rich, t) AS profile_text FROM s LEFT JOIN r USING (lead_id, profile_url)""")
def profile_swap(spark, sf):
    """Selected profiles with the text of the record fetched again under the same URL."""
    url = "concat('https://p.example/', CAST(o_orderkey % 50 AS STRING)) AS profile_url"
    orders = table(spark, sf, "orders")
    picked = orders.selectExpr("o_custkey AS lead_id", "o_orderkey AS ordinal", url, "concat('short ', CAST(o_orderkey AS STRING)) AS profile_text")
    again = orders.filter("o_orderstatus = 'F'").selectExpr(
        "o_custkey AS lead_id", "o_orderkey AS ordinal", url, "concat('rich ', CAST(o_orderkey AS STRING)) AS profile_text")
    return P.swap_richer(picked, again, ["lead_id"]).select("lead_id", "ordinal", "profile_url", "profile_text")


@query("payload_columns", """
SELECT o_orderkey AS ordinal, CAST(o_orderkey AS VARCHAR) AS source_lead_id, o_orderpriority AS source, o_orderstatus AS request_type,
  CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment END AS contact_first_name, CASE WHEN o_orderkey % 7 = 0 THEN 'Last' END AS contact_last_name,
  'Office' AS recipient_office_name, '9' AS recipient_office_id, CAST(NULL AS VARCHAR) AS empty_columns, TRUE AS payload_kept
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0""")
def payload_columns(spark, sf):
    """The other columns of flat leads, and the raw document they came from."""
    good, _ = R.split(R.with_errors(L.parse_documents(LW.documents(spark, sf)), R.lead_document_rules()))
    flat = L.flatten_documents(good, F.lit(LW.NOW).cast("timestamp"), keep=("ordinal",))
    unset = ("detailed_source", "detailed_source_summary", "contact_phone", "contact_country", "boat_model", "boat_year",
             "boat_condition", "boat_length_value", "boat_length_units", "boat_price_currency", "boat_url",
             "customer_comments", "lead_comments")
    return flat.select(
        "ordinal", "source_lead_id", "source", "request_type", "contact_first_name", "contact_last_name",
        "recipient_office_name", "recipient_office_id", F.coalesce(*unset).alias("empty_columns"),
        (F.get_json_object("raw_payload", "$.lead.id") == F.col("source_lead_id")).alias("payload_kept"))


_LISTING = {
    "nom_bateau": "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN repeat('n', 101) ELSE 'Boat' END",
    "constructeur": "CASE WHEN o_orderkey % 5 = 0 THEN repeat('c', 60) ELSE 'Yard' END",
    "longueur_m": "CASE WHEN o_orderkey % 13 = 0 THEN -1 WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 250 END",
    "annee": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(1880 + o_orderkey % 160 AS INT) END",
    "localisation": "CASE WHEN o_orderkey % 4 = 0 THEN repeat('l', 120) ELSE 'Port' END",
    "commentaire": "CASE WHEN o_orderkey % 8 = 0 THEN repeat('x', 2100) ELSE '  ' END",
    "proprietaire": "'Owner'", "capitaine": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Cap' END",
    "nombre_cabines": "CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 2 END",
    "prix_actuel": "CASE WHEN o_orderkey % 12 = 0 THEN repeat('p', 101) ELSE '1M' END",
    "prix_precedent": "CAST(NULL AS VARCHAR(9))", "dernier_message": "CASE WHEN o_orderkey % 14 = 0 THEN repeat('m', 501) ELSE '' END",
    "status": "CASE WHEN o_orderkey % 3 = 0 THEN 'NEW' WHEN o_orderkey % 3 = 1 THEN 'OPEN' END",
    "customer_comments": "CASE WHEN o_orderkey % 15 = 0 THEN repeat('y', 2001) ELSE '' END", "lead_comments": "CAST(NULL AS VARCHAR(9))",
}
_ATTEMPT = {
    "status": "CASE WHEN o_orderkey % 7 = 0 THEN 'lost' ELSE 'running' END",
    "trigger_source": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'manual' END",
    "retry_count": "CAST(o_orderkey % 4 - 1 AS INT)", "started_at": "o_orderdate",
    "completed_at": "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE o_orderdate END",
}
_YEAR = 2026


def _caps(**longest):
    return {c: f"coalesce(length({c}) <= {n}, TRUE)" for c, n in longest.items()}


def _needed(**longest):
    return {c: f"coalesce(length({c}), 0) BETWEEN 1 AND {n}" for c, n in longest.items()}


_SETS = {
    "listing": _needed(nom_bateau=100, constructeur=50) | {
        "longueur_m": "longueur_m > 0 AND longueur_m <= 200", "annee": f"annee BETWEEN 1900 AND {_YEAR + 2}"}
    | _needed(proprietaire=100, capitaine=100, localisation=10**6) | {"nombre_cabines": "nombre_cabines IS NULL OR nombre_cabines > 0"}
    | _caps(prix_actuel=100, prix_precedent=100, dernier_message=500, commentaire=2000),
    "tracked": _needed(nom_bateau=100) | _caps(constructeur=100) | {
        "longueur_m": "longueur_m IS NULL OR (longueur_m > 0 AND longueur_m <= 200)",
        "annee": f"annee IS NULL OR annee BETWEEN 1900 AND {_YEAR + 2}"} | _caps(localisation=100, commentaire=2000),
    "update": {"status": f"status IS NULL OR status IN {sql_list(V.LEAD_STATUSES)}"} | _caps(customer_comments=2000, lead_comments=2000),
    "stored": {"longueur_m": "coalesce(longueur_m > 0, TRUE)", "annee": f"coalesce(annee BETWEEN 1900 AND {_YEAR + 2}, TRUE)"},
    "attempt": {"status": f"status IN {sql_list(V.ATTEMPT_STATUSES)}", "trigger_source": "trigger_source IN ('new_lead', 'manual', 'recheck')",
                "retry_count": "retry_count >= 0", "completed_at": "coalesce(completed_at >= started_at, TRUE)"},
}


def _errors(rules):
    return "concat_ws('|', " + ", ".join(f"CASE WHEN NOT coalesce({sql}, FALSE) THEN '{n}' END" for n, sql in rules.items()) + ")"


@query("rule_sets", "WITH l AS (SELECT o_orderkey, " + ", ".join(f"{s} AS {n}" for n, s in _LISTING.items()) + " FROM orders), "
       "a AS (SELECT o_orderkey, " + ", ".join(f"{s} AS {n}" for n, s in _ATTEMPT.items()) + " FROM orders) "
       "SELECT l.o_orderkey, " + ", ".join(f"{_errors(_SETS[k])} AS {k}" for k in ("listing", "tracked", "update", "stored"))
       + ", attempt FROM l JOIN (SELECT o_orderkey, " + _errors(_SETS["attempt"]) + " AS attempt FROM a) USING (o_orderkey)")
def rule_sets(spark, sf):
    """Failed rules of the listing, tracked, update, stored and attempt sets, row by row."""
    year = F.lit(_YEAR)
    sets = {"listing": R.listing_rules(year), "tracked": R.tracked_rules(year), "update": R.lead_update_rules(),
            "stored": R.stored_listing_rules(year)}
    orders = table(spark, sf, "orders")
    rows = orders.selectExpr("o_orderkey", *[f"{sql} AS {n}" for n, sql in _LISTING.items()],
                             *[f"{sql} AS a_{n}" for n, sql in _ATTEMPT.items()])
    for name, rules in sets.items():
        rows = R.with_errors(rows, rules, name)
    rows = rows.select("o_orderkey", *sets, *[F.col(f"a_{n}").alias(n) for n in _ATTEMPT])
    rows = R.with_errors(rows, R.attempt_rules(), "attempt")
    return rows.select("o_orderkey", *[F.array_join(n, "|").alias(n) for n in (*sets, "attempt")])


# a profile page: fields at the start of a line, in any case, with blanks around them
_LINES = {
    "metier": "CASE WHEN c_custkey % 2 = 0 THEN concat('  MÉTIER:  ', c_mktsegment, ' ') ELSE 'x Métier: no' END",
    "entreprise": "CASE WHEN c_custkey % 3 = 0 THEN concat('Entreprise: Co ', CAST(c_custkey AS VARCHAR(20))) ELSE '' END",
    "missions": "CASE WHEN c_custkey % 5 = 0 THEN concat('missions:', repeat('m ', 250)) ELSE 'Missions:' END",
    "location": "concat('Location: ', CAST(c_nationkey AS VARCHAR(20)))",
    "about": "CASE WHEN c_custkey % 7 = 0 THEN 'About: first' ELSE 'none' END",
    "company_url": "'EntrepriseUrl: https://co.example/'",
}
_PAGE = "concat_ws(chr(10), c_name, " + ", ".join(_LINES.values()) + ", 'About: second')"
_PAGE_URL = "concat('https://www.linkedin.com/', CASE WHEN c_custkey % 4 = 0 THEN 'company/' ELSE 'in/' END, CAST(c_custkey AS VARCHAR(20)))"
_WANT = {
    "metier": "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END",
    "entreprise": "CASE WHEN c_custkey % 3 = 0 THEN concat('Co ', c_custkey) ELSE '' END",
    "missions": "CASE WHEN c_custkey % 5 = 0 THEN left(trim(repeat('m ', 250)), 400) ELSE '' END",
    "location": "CAST(c_nationkey AS VARCHAR)", "about": "CASE WHEN c_custkey % 7 = 0 THEN 'first' ELSE 'second' END",
    "company_url": "'https://co.example/'",
}


@query("profile_fields", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_custkey % 4 = 0 THEN '' ELSE {w} END AS field_{n}" for n, w in _WANT.items()) + " FROM customer")
def profile_fields(spark, sf):
    """The prefixed fields of profile pages; other pages have none."""
    pages = table(spark, sf, "customer").selectExpr("c_custkey", f"{_PAGE} AS text", f"{_PAGE_URL} AS url", "'linkedin' AS source_type")
    return E.with_fields(pages).select("c_custkey", *[f"field_{n}" for n in _WANT])
