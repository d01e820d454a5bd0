"""Tables kept in place, stored searches, global positions, and documents read as VARIANT."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.money import with_price
from ..operators import maintenance as M
from ..operators import searches, variants
from ..plans.ordering import positions
from ..session import fresh_path
from ..sources import filed
from . import attempts as AW
from . import catalogue as CW
from . import leads as LW
from . import roles
from .roles import CUSTOMER_EMAIL, table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


@query("patch_in_place", """
WITH late AS (SELECT * FROM orders WHERE o_totalprice > 400000),
ch AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderstatus = 'O' AS s1, o_orderpriority AS v1,
    o_orderstatus <> 'F' AS s2, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS v2 FROM late),
a AS (SELECT k, v1 FROM ch WHERE s1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY o DESC) = 1),
b AS (SELECT k, v2, true AS hit FROM ch WHERE s2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY o DESC) = 1)
SELECT c_custkey, coalesce(a.v1, c_mktsegment) AS segment, CASE WHEN b.hit THEN b.v2 ELSE c_nationkey END AS owner,
  CASE WHEN EXISTS (SELECT 1 FROM ch WHERE ch.k = c_custkey) THEN 'touched' ELSE 'old' END AS updated_at
FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey
WHERE c_acctbal > -900""")
def patch_in_place(spark, sf):
    path = fresh_path(spark, "filed")
    customers = table(spark, sf, "customer")
    filed.create(customers.selectExpr("c_custkey", "c_mktsegment AS segment", "CAST(c_nationkey AS BIGINT) AS owner",
                                      "'old' AS updated_at"), path, "c_custkey")
    patches = table(spark, sf, "orders").filter("o_totalprice > 400000").selectExpr(
        "o_custkey AS c_custkey", "o_orderkey AS seq", "o_orderpriority AS segment", "o_orderstatus = 'O' AS set_segment",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS owner", "o_orderstatus <> 'F' AS set_owner")
    M.patch_in_place(spark, path, patches, ["segment", "owner"], "seq", F.lit("touched"), mark=1)
    # the same batch once more changes nothing
    M.patch_in_place(spark, path, patches, ["segment", "owner"], "seq", F.lit("again"), mark=1)
    M.delete_in_place(spark, path, customers.filter("c_acctbal <= -900").select("c_custkey"), mark=2)
    return filed.read(spark, path)


@query("clean_in_place", """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < -950),
off AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9950)
SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM off) THEN o_custkey END AS o_custkey
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)""")
def clean_in_place(spark, sf):
    path = fresh_path(spark, "filed")
    customers = table(spark, sf, "customer")
    filed.create(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), path, "o_orderkey")
    M.cascade_in_place(spark, path, customers.filter("c_acctbal < -950"), "o_custkey", "c_custkey")
    M.set_null_in_place(spark, path, customers.filter("c_acctbal > 9950"), "o_custkey", "c_custkey")
    return filed.read(spark, path)


# a document with every column filled; now and then a part is missing, null, a number, or the text is cut off
_FULL = {
    "source_lead_id": ("lead.id", "CAST(o_orderkey AS VARCHAR(20))"), "source": ("lead.source", "o_orderpriority"),
    "detailed_source": ("lead.detailedSource", "concat('Portal ', o_orderstatus)"),
    "detailed_source_summary": ("lead.detailedSourceSummary", "CASE WHEN o_orderkey % 3 <> 0 THEN concat('Sum ', o_orderpriority) END"),
    "request_type": ("lead.requestType", "CASE WHEN o_orderkey % 2 = 0 THEN 'Contact Broker' ELSE 'Price' END"),
    "contact_first_name": ("contact.name.first", "CASE WHEN o_orderkey % 5 <> 0 THEN c_mktsegment END"),
    "contact_last_name": ("contact.name.last", "c_name"), "contact_email": ("contact.email", CUSTOMER_EMAIL),
    "contact_phone": ("contact.phone", "concat('+33 ', CAST(c_custkey AS VARCHAR(20)))"),
    "contact_country": ("contact.country", "CASE WHEN c_nationkey % 4 <> 0 THEN concat('N', CAST(c_nationkey AS VARCHAR(20))) END"),
    "boat_make": ("boat.make", "concat('Make ', chr(34), c_mktsegment, chr(34))"), "boat_model": ("boat.model", "concat('É', CAST(o_orderkey % 97 AS VARCHAR(20)))"),
    "boat_year": ("boat.year", "CASE WHEN o_orderkey % 6 = 0 THEN 'new' ELSE CAST(1950 + o_orderkey % 75 AS VARCHAR(20)) END"),
    "boat_condition": ("boat.condition", "CASE WHEN o_orderstatus = 'F' THEN 'Used' ELSE 'New' END"),
    "boat_length_value": ("boat.length.measure", "concat(CAST(o_orderkey % 90 AS VARCHAR(20)), '.5')"),
    "boat_length_units": ("boat.length.units", "CASE WHEN o_orderkey % 2 = 0 THEN 'm' ELSE 'ft' END"),
    "boat_price_amount": ("boat.price.amount", "CAST(CAST(round(o_totalprice, 2) AS DECIMAL(12,2)) AS VARCHAR(20))"),
    "boat_price_currency": ("boat.price.currency", "CASE WHEN c_nationkey % 2 = 0 THEN 'EUR' ELSE 'USD' END"),
    "boat_url": ("boat.url", "concat('https://boats.example/', CAST(o_orderkey AS VARCHAR(20)), '?a=1&b=2')"),
    "customer_comments": ("customerComments", "concat('Hello', chr(10), 'line <', c_name, '>')"),
    "lead_comments": ("leadComments", "CASE WHEN o_orderkey % 8 <> 0 THEN concat('tab', chr(9), 'x') ELSE '' END"),
    "recipient_office_name": ("recipient.officeName", "concat('Office ', CAST(c_nationkey AS VARCHAR(20)))"),
    "recipient_office_id": ("recipient.officeId", "CAST(c_nationkey AS VARCHAR(20))"),
    "recipient_contact_name": ("recipient.contactName", "CASE WHEN o_orderkey % 7 <> 0 THEN concat('Broker ', CAST(c_nationkey AS VARCHAR(20))) ELSE '' END"),
    "lead_date": ("lead.date", "CASE WHEN o_orderkey % 5 = 1 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END"),
}
_SPARK_DATE = """CASE WHEN o_orderkey % 5 = 1 THEN 'soon' ELSE date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'") END"""


def _nested(fields):
    """Columns by path as one nested struct."""
    tree = {}
    for path, expr in fields:
        at = tree
        *folders, name = path.split(".")
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = F.expr(expr)

    def struct(node):
        return F.struct(*[(struct(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return struct(tree)


def full_documents(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey").withColumn(
        "c_custkey", F.col("o_custkey")), "o_custkey")
    fields = [(path, _SPARK_DATE if name == "lead_date" else expr) for name, (path, expr) in _FULL.items()]
    text = F.to_json(_nested(fields))
    # a number where a text is expected reads as that text
    text = F.when(F.col("o_orderkey") % 11 == 0, F.regexp_replace(text, r'"officeId":"(\d+)"', '"officeId":$1')).otherwise(text)
    return rows.select(F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 31 == 0, F.left(text, F.lit(60))).otherwise(text).alias("value"))


def _sql_column(name):
    path, expr = _FULL[name]
    if name == "boat_year":
        return "CASE WHEN o_orderkey % 6 <> 0 THEN CAST(1950 + o_orderkey % 75 AS INT) END"
    if name == "boat_length_value":
        return "CAST(o_orderkey % 90 + 0.5 AS DOUBLE)"
    if name == "boat_price_amount":
        return "CAST(CAST(round(o_totalprice, 2) AS DECIMAL(12,2)) AS DOUBLE)"
    if name == "recipient_contact_name":
        return f"nullif({expr}, '')"
    return expr


_CUT = "o_orderkey % 31 = 0"


@query("lead_columns", "SELECT o_orderkey AS ordinal, " + ", ".join(
    f"CASE WHEN NOT {_CUT} THEN {_sql_column(n)} END AS {n}" for n in _FULL if n != "lead_date") + f""",
  CASE WHEN {_CUT} OR o_orderkey % 5 = 1 THEN '{LW.NOW}' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS lead_date,
  CASE WHEN {_CUT} THEN '{V.UNKNOWN_CONTACT}' WHEN o_orderkey % 5 <> 0 THEN concat(c_mktsegment, ' ', c_name) ELSE c_name END AS contact_display_name,
  'NEW' AS status, CASE WHEN NOT {_CUT} THEN CAST(o_orderkey AS VARCHAR) END AS payload_id
FROM orders JOIN customer ON o_custkey = c_custkey""")
def lead_columns(spark, sf):
    """Every flat column of a lead with real values, three of them typed."""
    out = variants.lead_columns(full_documents(spark, sf), F.lit(LW.NOW).cast("timestamp"), keep=("ordinal",), types=variants.TYPED)
    return out.withColumns({"lead_date": LW.day("lead_date"), "boat_price_amount": F.col("boat_price_amount").cast("double"),
                            "payload_id": F.get_json_object("raw_payload", "$.lead.id")}).drop("raw_payload")


@query("report_variants", f"""
SELECT event_id AS id, user_id AS lead_id, {AW.STATUS} AS status, event_type AS identity_status, props->>'$.k' AS confidence_score,
  'low' AS overall_risk, event_type AS recommended_review, CASE WHEN event_id % 4 = 0 THEN 'listed' END AS sanctions_status,
  CASE WHEN event_id % 4 = 0 THEN 'clear' END AS pep_status FROM events""")
def report_variants(spark, sf):
    """The six report values of the latest-attempt view, for every attempt."""
    screening = F.when(F.col("id") % 4 == 0, F.concat(
        F.expr("substring(report, 1, length(report) - 1)"),
        F.lit(', "risk_screening": {"sanctions": {"status": "listed"}, "pep": {"status": "clear"}}}'))).otherwise(F.col("report"))
    attempts = AW.attempts(spark, sf).withColumn("report", screening)
    return variants.report_columns(attempts.select("id", "lead_id", "status", "report")).drop("report")


# --- stored searches: suppliers search the parts --------------------------------------------

_SEARCHES = {
    "search": "CASE s_suppkey % 9 WHEN 0 THEN 'Ring' WHEN 1 THEN 'ed ' WHEN 2 THEN '#1' WHEN 3 THEN 'x' END",
    "location": "CASE s_suppkey % 9 WHEN 1 THEN 'OMO' WHEN 4 THEN 'conom' WHEN 5 THEN 'ST' END",
    "broker": "CASE WHEN s_suppkey % 11 = 3 THEN concat(' nation_', CAST(s_nationkey AS VARCHAR(20))) WHEN s_suppkey % 11 = 5 THEN 'Nobody' ELSE '' END",
    "min_length": "CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey % 40 END", "max_length": "CASE WHEN s_suppkey % 4 <> 0 THEN 45 - s_suppkey % 13 ELSE 0 END",
    "min_price": "CASE WHEN s_suppkey % 5 = 2 THEN s_acctbal * 100 WHEN s_suppkey % 5 = 4 THEN 950.5 END",
    "max_price": "CASE WHEN s_suppkey % 5 = 2 THEN s_acctbal * 100 + 400000 END",
    "min_cabins": "CASE WHEN s_suppkey % 3 = 1 THEN 2 END", "max_cabins": "CASE WHEN s_suppkey % 6 = 2 THEN 4 END",
    "starred": "s_suppkey % 7 = 6",
}
_PRICED = CW._PRICES.removeprefix("WITH ")


@query("saved_searches", f"""
WITH {_PRICED},
l AS (SELECT part.*, p_partkey % 6 AS cabins, {CW._CORRECTED} AS price, p_size % 3 = 0 AS star, CAST(p_partkey % 25 AS VARCHAR) AS owner
  FROM part JOIN p USING (p_partkey)),
s AS (SELECT s_suppkey, {", ".join(f"{e} AS {n}" for n, e in _SEARCHES.items())} FROM supplier),
b AS (SELECT s.*, (SELECT min(n_nationkey)::VARCHAR FROM nation WHERE lower(n_name) = lower(trim(broker)) HAVING count(*) = 1) AS bid FROM s)
SELECT CAST(s_suppkey AS VARCHAR) AS search_id, p_partkey AS id FROM b JOIN l ON
  (search IS NULL OR contains(lower(p_name), lower(search)) OR contains(lower(p_brand), lower(search)))
  AND (location IS NULL OR contains(lower(p_type), lower(location)))
  AND (trim(broker) = '' OR owner = bid)
  AND (coalesce(min_length, 0) = 0 OR p_size >= min_length) AND (coalesce(max_length, 0) = 0 OR p_size <= max_length)
  AND (coalesce(min_price, 0) = 0 OR price >= min_price) AND (coalesce(max_price, 0) = 0 OR price <= max_price)
  AND (coalesce(min_cabins, 0) = 0 OR cabins >= min_cabins) AND (coalesce(max_cabins, 0) = 0 OR cabins <= max_cabins)
  AND ((coalesce(min_cabins, 0) = 0 AND coalesce(max_cabins, 0) = 0) OR cabins <> 0) AND (NOT starred OR star)""")
def saved_searches(spark, sf):
    asked = table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS search_id", *[f"{e} AS {n}" for n, e in _SEARCHES.items()])
    parts = CW.listings(spark, sf).selectExpr("*", "p_size % 3 = 0 AS star", "p_partkey % 25 AS owner")
    return searches.match_searches(asked, parts, roles.brokers(spark, sf), columns={
        **CW.PART, "owner": "owner", "starred": "star", "price": "price_text"})


@query("sorted_positions", f"""{CW._PRICES}
SELECT p_partkey, row_number() OVER (ORDER BY coalesce({CW._CORRECTED}, 0) DESC, p_partkey) AS price_position,
  row_number() OVER (ORDER BY p_size, p_partkey) AS size_position FROM p JOIN part USING (p_partkey)""")
def sorted_positions(spark, sf):
    """The place of every listing in two orders of the catalogue; an eighth of the prices is unreadable and ties at 0."""
    rows = with_price(CW.listings(spark, sf), "price_text", "price").select(
        "p_partkey", "p_size", F.coalesce("price", F.lit(0.0)).alias("price"))
    by_price = positions(rows, [("price", False), ("p_partkey", True)], "price_position")
    return positions(by_price, [("p_size", True), ("p_partkey", True)], "size_position").select(
        "p_partkey", "price_position", "size_position")
