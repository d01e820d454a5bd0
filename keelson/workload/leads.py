"""Lead jobs on orders, customer and nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import leads as L
from ..operators.validation import lead_document_rules, outcome_counts, with_errors
from . import roles
from .roles import CUSTOMER_EMAIL, LEAD_STATUS, LEADS_SQL, dealt, sql_fold, table

QUERIES, ORACLE = {}, {}
NOW = "2026-01-01 00:00:00"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def day(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_STATS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}_leads" for s in V.LEAD_STATUSES)
_ZERO = ", ".join(f"coalesce({s.lower()}_leads, 0) AS {s.lower()}_leads" for s in V.LEAD_STATUSES)


@query("lead_funnel", f"""
WITH l AS ({LEADS_SQL}), s AS (
  SELECT broker_id, count(*) AS total_leads, {_STATS}, max(received_at) AS latest FROM l GROUP BY broker_id)
SELECT n_nationkey AS broker_id, n_name AS broker_name, coalesce(total_leads, 0) AS total_leads, {_ZERO},
  strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest_lead_date,
  CASE WHEN coalesce(total_leads, 0) > 0 THEN round(converted_leads / total_leads * 100, 1) ELSE 0.0 END AS conversion_rate
FROM nation LEFT JOIN s ON n_nationkey = broker_id""")
def lead_funnel(spark, sf):
    """Orders are counted per contact before the join, so neither a contact nor a broker
    with a large share of all leads reaches one task row by row."""
    orders = table(spark, sf, "orders").selectExpr("o_custkey", f"{LEAD_STATUS} AS status", "o_orderdate AS received_at")
    per_contact = L.funnel(orders, owner="o_custkey")
    owners = table(spark, sf, "customer").selectExpr(
        "c_custkey AS o_custkey", "c_nationkey AS broker_id")
    stats = L.merge_funnels(per_contact.join(owners, "o_custkey"), "broker_id")
    out = L.zero_filled(roles.brokers(spark, sf).drop("email"), stats)
    return out.withColumn("conversion_rate", L.conversion_rate(F.col("converted_leads"), F.col("total_leads"))) \
        .withColumn("latest_lead_date", day("latest_lead_date"))


@query("lead_filter", f"""
WITH l AS ({LEADS_SQL})
SELECT id, status, source, contact_email, strftime(received_at, '%Y-%m-%d') AS day FROM l
WHERE contact_email <> 'test@example.com' AND broker_id BETWEEN 3 AND 3 AND status = 'NEW'
  AND (detailed_source_summary = '1-URGENT' OR source = '1-URGENT')
  AND (contains(lower(contact_display_name), '00') OR contains(lower(contact_email), '00') OR contains(lower(boat_make), '00'))
  AND received_at >= TIMESTAMP '1996-01-01' AND received_at < TIMESTAMP '1999-01-01'
ORDER BY received_at DESC, id""")
def lead_filter(spark, sf):
    out = L.without_test_rows(roles.leads(spark, sf).withColumn("text_id", F.col("id").cast("string")),
                              "text_id", "contact_email", "contact_display_name")
    out = L.filter_leads(
        out, owner=3, status="NEW", search="00", source="1-URGENT", date_from="1996-01-01", date_to="1998-12-31",
        columns={"search": ("contact_display_name", "contact_email", "boat_make")})
    return L.newest_first(out).select("id", "status", "source", "contact_email",
                                      F.date_format("received_at", "yyyy-MM-dd").alias("day"))


@query("leads_with_broker", f"""
WITH l AS ({LEADS_SQL})
SELECT id, broker_id, n_name AS broker_name FROM l LEFT JOIN nation ON broker_id = n_nationkey""")
def leads_with_broker(spark, sf):
    from ..operators.catalogue import with_broker
    return with_broker(roles.leads(spark, sf), roles.brokers(spark, sf), names=("broker_name",)).select(
        "id", "broker_id", "broker_name")


def documents(spark, sf):
    """Orders as JSON lead documents; some lack a required part, some are cut off."""
    rows = dealt(spark, sf, "orders").join(
        table(spark, sf, "customer").selectExpr("c_custkey AS o_custkey", "c_name", "c_mktsegment", "c_nationkey",
                                                f"{CUSTOMER_EMAIL} AS email"), "o_custkey")
    text = F.to_json(F.struct(
        F.struct(F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderkey").cast("string")).alias("id"),
                 F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("date"),
                 F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("requestType")).alias("lead"),
        F.struct(F.struct(
            F.when(F.col("o_orderkey") % 2 == 0, F.col("c_name")).alias("display"),
            F.when(F.col("o_orderkey") % 3 == 0, F.col("c_mktsegment")).alias("first"),
            F.when(F.col("o_orderkey") % 7 == 0, F.lit("Last")).alias("last")).alias("name"),
            F.col("email").alias("email")).alias("contact"),
        F.struct(F.lit("Maker").alias("make"),
                 F.struct(F.round("o_totalprice", 2).cast("decimal(12,2)").cast("string").alias("amount")).alias("price")).alias("boat"),
        F.struct(F.when(F.col("o_orderkey") % 23 != 0, F.lit("Office")).alias("officeName"),
                 F.lit("9").alias("officeId"),
                 F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("contactName")).alias("recipient"),
        F.struct(F.when(F.col("o_orderkey") % 4 != 0, F.transform(
            F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")), lambda i: F.struct(
                F.concat(F.lit("Make"), i.cast("string")).alias("make"),
                (F.lit(2000) + i).cast("string").alias("year"),
                F.struct(F.lit("FR").alias("country")).alias("location")))).alias("leadHistory")).alias("leadSmart"),
    ))
    cut = F.when(F.col("o_orderkey") % 29 == 0, F.left(text, F.lit(40))).otherwise(text)
    return rows.select(F.col("o_orderkey").alias("ordinal"), cut.alias("value"))


_CONTACT = """CASE WHEN o_orderkey % 2 = 0 THEN c_name WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 = 0 THEN concat(c_mktsegment, ' Last')
  WHEN o_orderkey % 3 = 0 THEN c_mktsegment WHEN o_orderkey % 7 = 0 THEN 'Last' ELSE 'Unknown Contact' END"""


@query("payload_flatten", f"""
SELECT o_orderkey AS ordinal, CAST(o_orderkey AS VARCHAR) AS source_lead_id, {_CONTACT} AS contact_display_name,
  {CUSTOMER_EMAIL} AS contact_email, o_orderpriority AS source, 'Maker' AS boat_make,
  CAST(CAST(round(o_totalprice, 2) AS DECIMAL(12,2)) AS VARCHAR) AS boat_price_amount,
  concat('NATION_', CAST(c_nationkey AS VARCHAR)) AS recipient_contact_name, 'NEW' AS status,
  CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE '{NOW}' END AS lead_date
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0""")
def payload_flatten(spark, sf):
    from ..operators.validation import split
    good, _ = split(with_errors(L.parse_documents(documents(spark, sf)), lead_document_rules()))
    flat = L.flatten_documents(good, F.lit(NOW).cast("timestamp"), keep=("ordinal",))
    return flat.select("ordinal", "source_lead_id", "contact_display_name", "contact_email", "source", "boat_make",
                       "boat_price_amount", "recipient_contact_name", "status", day("lead_date").alias("lead_date"))


@query("payload_rejects", """
SELECT CASE WHEN o_orderkey % 29 = 0 THEN 'lead.id|lead.source|contact|recipient.officeName|recipient.officeId'
  ELSE concat_ws('|', CASE WHEN o_orderkey % 19 = 0 THEN 'lead.id' END, CASE WHEN o_orderkey % 23 = 0 THEN 'recipient.officeName' END) END AS errors,
  count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def payload_rejects(spark, sf):
    # a cut-off document keeps no usable part
    parsed = L.parse_documents(documents(spark, sf))
    parsed = parsed.withColumn("doc", F.when(F.col("corrupt").isNull(), F.col("doc")))
    checked = with_errors(parsed, lead_document_rules())
    return outcome_counts(checked.withColumn("errors", F.array_join("errors", "|")), "errors")


@query("history_explode", """
SELECT o_orderkey AS ordinal, CAST(i - 1 AS INT) AS position, CASE WHEN i IS NOT NULL THEN concat('Make', CAST(i AS VARCHAR)) END AS make,
  CAST(2000 + i AS VARCHAR) AS year, CASE WHEN i IS NOT NULL THEN 'FR' END AS country
FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 4 <> 0 THEN range(1, o_orderkey % 3 + 2) ELSE [NULL] END) AS i
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 29 <> 0)""")
def history_explode(spark, sf):
    parsed = L.parse_documents(documents(spark, sf)).filter(F.col("corrupt").isNull())
    return L.history(parsed, keep=("ordinal",)).select("ordinal", "position", "make", "year", "country")


_RECIPIENT = """CASE c_custkey % 6 WHEN 0 THEN concat('Natïon ', CAST(c_nationkey AS VARCHAR(20)))
  WHEN 1 THEN concat(lower(concat('NATION_', CAST(c_nationkey AS VARCHAR(20)))), '@one.example')
  WHEN 2 THEN concat('nation_', CAST(c_nationkey AS VARCHAR(20))) WHEN 3 THEN '' WHEN 4 THEN 'Nobody' ELSE NULL END"""


@query("route_cascade", f"""
WITH b AS (SELECT n_nationkey AS id, n_name, concat(lower(n_name), CASE WHEN n_nationkey % 2 = 0 THEN '@one.example' ELSE '@two.example' END) AS email FROM nation),
a AS (SELECT {sql_fold("concat('nation ', CAST(n_nationkey AS VARCHAR))", 'recipient')} AS k, CASE WHEN n_nationkey % 5 <> 0 THEN concat(lower(n_name), '@two.example') END AS mail FROM nation),
r AS (SELECT c_custkey, coalesce({_RECIPIENT}, '') AS raw FROM customer),
m AS (SELECT c_custkey, raw, coalesce(a.mail, trim(raw)) AS m1 FROM r LEFT JOIN a ON {sql_fold('raw', 'recipient')} = a.k),
m2 AS (SELECT *, CASE WHEN ends_with(m1, '@one.example') THEN replace(m1, '@one.example', '@two.example')
  WHEN ends_with(m1, '@two.example') THEN replace(m1, '@two.example', '@one.example') END AS m2 FROM m),
e AS (SELECT c_custkey, raw, count(b.id) AS n, min(b.id) AS id FROM m2 LEFT JOIN b ON m1 <> '' AND (b.email = m1 OR b.email = m2) GROUP BY ALL)
SELECT c_custkey, CASE WHEN e.n = 1 THEN e.id ELSE nm.id END AS broker_id,
  CASE WHEN CASE WHEN e.n = 1 THEN e.id ELSE nm.id END IS NOT NULL THEN '{NOW}' END AS processed_at
FROM e LEFT JOIN (SELECT lower(n_name) AS nl, min(n_nationkey) AS id FROM nation GROUP BY 1 HAVING count(*) = 1) nm ON lower(raw) = nl AND raw <> ''""")
def route_cascade(spark, sf):
    leads = table(spark, sf, "customer").selectExpr("c_custkey", f"{_RECIPIENT} AS recipient_contact_name")
    aliases = table(spark, sf, "nation").selectExpr(
        "concat('nation ', CAST(n_nationkey AS STRING)) AS alias_key",
        "CASE WHEN n_nationkey % 5 <> 0 THEN concat(lower(n_name), '@two.example') ELSE '' END AS email")
    out = L.route(leads, roles.brokers(spark, sf), aliases, F.lit(NOW).cast("timestamp"), ("one.example", "two.example"))
    return out.select("c_custkey", "broker_id", day("processed_at").alias("processed_at"))


@query("first_wins", """
SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""")
def first_wins(spark, sf):
    from ..plans.ordering import first_per_key
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return first_per_key(rows, ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_linenumber")


@query("new_only", """
SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey - 1 ELSE o_orderkey END FROM orders)""")
def new_only(spark, sf):
    stored = table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderstatus = 'P' THEN -o_orderkey - 1 ELSE o_orderkey END AS event_id")
    return L.new_only(table(spark, sf, "events").select("event_id", "user_id"), stored, "event_id")
