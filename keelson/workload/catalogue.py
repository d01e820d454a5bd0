"""Catalogue, maintenance and validation jobs on part, supplier, customer and nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import with_price
from ..functions.text import display_name, format_fr, initials, metres_to_feet, truncate
from ..functions import vocab as V
from ..operators import catalogue as C
from ..operators import maintenance as M
from ..operators import validation as R
from . import roles
from .roles import CUSTOMER_EMAIL, PRICE_TEXT, sql_fold, table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


PART = {"id": "p_partkey", "name": "p_name", "builder": "p_brand", "length": "p_size",
        "location": "p_type", "cabins": "cabins"}


def listings(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
        "CAST(p_partkey % 6 AS INT) AS cabins", f"{PRICE_TEXT} AS price_text")


@query("catalogue_search", """
SELECT p_partkey, p_name, p_brand, p_type, p_size, CAST(p_partkey % 6 AS INT) AS cabins FROM part
WHERE (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')) AND contains(lower(p_type), 'mo')
  AND p_size >= 5 AND p_size <= 40 AND p_partkey % 6 BETWEEN 2 AND 4
ORDER BY p_name, p_partkey""")
def catalogue_search(spark, sf):
    params = C.sanitise_filters({"search": " RED ", "location": "mo", "min_length": "5", "max_length": "40"})
    out = C.filter_catalogue(listings(spark, sf), columns=PART, **params)
    out = C.filter_cabins(out, "cabins", 2, 4)
    return C.sort_catalogue(out, "name", "p_name", "p_partkey").drop("price_text", "p_retailprice")


@query("catalogue_exact", """
SELECT s_suppkey, s_name, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_name = 'NATION_3' AND s_acctbal >= 100""")
def catalogue_exact(spark, sf):
    out = C.filter_catalogue(
        table(spark, sf, "supplier"), table(spark, sf, "nation"), broker="NATION_3", match="exact",
        min_length=100, columns={"name": "s_name", "owner": "s_nationkey", "length": "s_acctbal"},
        broker_key="n_nationkey", broker_name="n_name")
    return out.select("s_suppkey", "s_name", "s_nationkey")


@query("catalogue_by_broker", """
SELECT s_suppkey, s_name, s_nationkey FROM supplier
WHERE s_nationkey = (SELECT min(n_nationkey) FROM nation WHERE lower(n_name) = 'nation_7' HAVING count(*) = 1)""")
def catalogue_by_broker(spark, sf):
    out = C.filter_catalogue(
        table(spark, sf, "supplier"), table(spark, sf, "nation"), broker=" Nation_7 ",
        columns={"name": "s_name", "owner": "s_nationkey"}, broker_key="n_nationkey", broker_name="n_name")
    return out.select("s_suppkey", "s_name", "s_nationkey")


_UP = f"upper({PRICE_TEXT})"
_NUM = r"'^([+-]?(?:\d+\.?\d*|\.\d+))'"


def _plain(x: str) -> str:
    commas = f"(length({x}) - length(replace({x}, ',', '')))"
    dots = f"(length({x}) - length(replace({x}, '.', '')))"
    return f"""TRY_CAST(regexp_extract(CASE
  WHEN {commas} > 0 AND {dots} > 0 AND strpos(reverse({x}), ',') < strpos(reverse({x}), '.')
    THEN replace(replace({x}, '.', ''), ',', '.')
  WHEN {commas} > 0 AND {dots} > 0 THEN replace({x}, ',', '')
  WHEN {commas} = 1 AND strpos({x}, ',') > length({x}) - 3 THEN replace({x}, ',', '.')
  WHEN {commas} > 0 THEN replace({x}, ',', '')
  WHEN {dots} > 1 THEN replace({x}, '.', '') ELSE {x} END, {_NUM}, 1) AS DOUBLE)"""


_PRICES = f"WITH p AS (SELECT p_partkey, {_UP} AS t, regexp_replace({_UP}, '[€$£¥ ]', '', 'g') AS b FROM part)"
_STRICT = rf"CASE WHEN regexp_extract(t, '(\d+\.?\d*)\s*M', 1) <> '' THEN CAST(regexp_extract(t, '(\d+\.?\d*)\s*M', 1) AS DOUBLE) * 1000000.0 ELSE {_plain('b')} END"
_SUF = r"'(\d[\d.,]*)\s*(M|K)(?:[^A-Z]|ILLION|EUR|USD|GBP|$)'"
_CORRECTED = f"""CASE WHEN regexp_extract(t, {_SUF}, 1) <> '' THEN
  TRY_CAST(regexp_extract(CASE WHEN length(regexp_replace(regexp_extract(t, {_SUF}, 1), '[^.,]', '', 'g')) = 1
      THEN replace(regexp_extract(t, {_SUF}, 1), ',', '.') ELSE regexp_extract(t, {_SUF}, 1) END, {_NUM}, 1) AS DOUBLE)
  * CASE WHEN regexp_extract(t, {_SUF}, 2) = 'M' THEN 1000000.0 ELSE 1000.0 END ELSE {_plain('b')} END"""


@query("price_normalise_strict", f"""{_PRICES}
SELECT p_partkey, round(price, 2) AS price FROM (SELECT p_partkey, {_STRICT} AS price FROM p)
WHERE price >= 1000 AND price <= 30000000 ORDER BY price DESC, p_partkey""")
def price_strict(spark, sf):
    out = C.filter_price(listings(spark, sf), "price_text", 1000, 30_000_000, "strict")
    out = C.sort_catalogue(out, "price-desc", "price", "p_partkey")
    return out.select("p_partkey", F.round("price", 2).alias("price"))


@query("price_normalise_corrected", f"""{_PRICES}
SELECT p_partkey, round({_CORRECTED}, 2) AS price FROM p""")
def price_corrected(spark, sf):
    out = with_price(listings(spark, sf), "price_text", "price", "corrected")
    return out.select("p_partkey", F.round("price", 2).alias("price"))


@query("listing_with_broker", """
SELECT s_suppkey, s_name, s_nationkey, n_name AS broker_name,
  concat(lower(n_name), CASE WHEN n_nationkey % 2 = 0 THEN '@one.example' ELSE '@two.example' END) AS email
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def listing_with_broker(spark, sf):
    out = C.with_broker(table(spark, sf, "supplier"), roles.brokers(spark, sf), "s_nationkey")
    return out.select("s_suppkey", "s_name", "s_nationkey", "broker_name", "email")


_NAMED = "CASE c_custkey % 3 WHEN 0 THEN concat(' nation_', cast(c_nationkey AS VARCHAR(20)), ' ') WHEN 1 THEN concat('0000000', cast(c_custkey % 10 AS VARCHAR(20)), '-0000-4000-8000-00000000000a') ELSE 'NATION_99' END"


@query("name_resolution", f"""
SELECT c_custkey, CASE WHEN regexp_matches(trim(v), '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')
  THEN trim(v) ELSE CAST(id AS VARCHAR) END AS broker_id
FROM (SELECT c_custkey, {_NAMED} AS v FROM customer)
LEFT JOIN (SELECT lower(n_name) AS n, min(n_nationkey) AS id FROM nation GROUP BY 1 HAVING count(*) = 1) ON lower(trim(v)) = n""")
def name_resolution(spark, sf):
    values = table(spark, sf, "customer").selectExpr("c_custkey", f"{_NAMED} AS named")
    return C.resolve_names(values, "named", roles.brokers(spark, sf)).select("c_custkey", "broker_id")


@query("distinct_facets", """
SELECT 'location' AS facet, p_type AS value FROM part WHERE trim(p_type) <> '' GROUP BY p_type
UNION ALL
SELECT 'source', v FROM (SELECT DISTINCT coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Portal ', o_orderpriority) END, ''), nullif(trim(o_orderpriority), '')) AS v FROM orders) WHERE v IS NOT NULL""")
def distinct_facets(spark, sf):
    places = C.distinct_values(table(spark, sf, "part"), "p_type").select(F.lit("location").alias("facet"), "value")
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderpriority", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Portal ', o_orderpriority) END AS summary")
    sources = C.distinct_first_filled(orders, ["summary", "o_orderpriority"])
    return places.unionByName(sources.select(F.lit("source").alias("facet"), "value"))


# watch-list entries: every brand-and-name pair of the catalogue's tracked types
@query("watchlist_union", f"""
WITH stored AS (SELECT p_partkey, p_name, p_size FROM part),
wanted AS (SELECT upper(replace(p_name, ' ', '-')) AS n, min(p_partkey) AS pos FROM part GROUP BY p_name
  UNION ALL SELECT concat('Old ', p_name), min(p_partkey) FROM part GROUP BY p_name)
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS nom_bateau, p_size AS longueur_m, CAST(NULL AS VARCHAR) AS localisation FROM stored
UNION ALL
SELECT concat('virtual-', replace({sql_fold('n', 'plain')}, ' ', '-'), '-', CAST(pos AS VARCHAR)), n, 0, 'N/A' FROM wanted
WHERE {sql_fold('n', 'plain')} NOT IN (SELECT {sql_fold('p_name', 'plain')} FROM stored)""")
def watchlist_union(spark, sf):
    part = table(spark, sf, "part")
    stored = part.selectExpr(
        "CAST(p_partkey AS STRING) AS id", "p_name AS nom_bateau", "p_size AS longueur_m",
        "CAST(NULL AS STRING) AS localisation")
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("position"))
    defaults = names.selectExpr("upper(replace(p_name, ' ', '-')) AS nom_bateau", "position").unionByName(
        names.selectExpr("concat('Old ', p_name) AS nom_bateau", "position"))
    defaults = defaults.selectExpr("*", "CAST(NULL AS INT) AS annee", "false AS etoile")
    return C.watchlist(stored, defaults)


@query("required_names_union", """
SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS broker_name FROM nation
UNION ALL SELECT CAST(NULL AS VARCHAR), name FROM (SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT 'NATION_1')
WHERE name NOT IN (SELECT n_name FROM nation)""")
def required_names_union(spark, sf):
    stored = table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS STRING) AS id", "n_name AS broker_name")
    wanted = table(spark, sf, "customer").selectExpr("c_mktsegment AS broker_name").unionByName(
        table(spark, sf, "nation").filter("n_nationkey = 1").selectExpr("n_name AS broker_name"))
    return M.seed_missing(stored, wanted, "broker_name")


@query("keyed_lookup", """
SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (
  SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_linenumber % 25 = s_nationkey)""")
def keyed_lookup(spark, sf):
    asked = table(spark, sf, "lineitem").selectExpr("l_suppkey AS s_suppkey", "l_linenumber % 25 AS s_nationkey")
    out = C.lookup(table(spark, sf, "supplier"), asked, ["s_suppkey", "s_nationkey"])
    return C.without_secrets(out.withColumn("password", F.lit("x"))).select("s_suppkey", "s_name")


# --- validation ------------------------------------------------------------------------

_DISPLAY = "CASE WHEN c_custkey % 13 = 0 THEN '  ' WHEN c_custkey % 17 = 0 THEN repeat('n', 130) ELSE c_name END"
_OK_MAIL = f"""(trim({CUSTOMER_EMAIL}) = '' OR (regexp_matches(trim({CUSTOMER_EMAIL}), '^[A-Za-z0-9_''+\\-.]*[A-Za-z0-9_+\\-]@(?:[A-Za-z0-9][A-Za-z0-9\\-]*\\.)+[A-Za-z]{{2,}}$')))"""


@query("validate_split", f"""
WITH e AS (SELECT concat_ws('|', CASE WHEN NOT length(trim({_DISPLAY})) BETWEEN 1 AND 120 THEN 'contact_display_name' END,
  CASE WHEN NOT {_OK_MAIL} THEN 'contact_email' END,
  CASE WHEN length(c_mktsegment) > 8 THEN 'segment' END) AS errors FROM customer)
SELECT errors, count(*) AS n FROM e GROUP BY errors""")
def validate_split(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        f"{_DISPLAY} AS contact_display_name", f"{CUSTOMER_EMAIL} AS contact_email", "c_mktsegment")
    rules = R.manual_lead_rules(columns=[]) | {"segment": R.optional_trimmed(F.col("c_mktsegment"), 8)}
    checked = R.with_errors(rows, rules).withColumn("errors", F.array_join("errors", "|"))
    return R.outcome_counts(checked, "errors")


# --- maintenance -------------------------------------------------------------------------


@query("patch_apply", """
WITH ch AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderkey % 2 = 0 AS s1, o_orderpriority AS v1,
    o_orderkey % 3 = 0 AS s2, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS v2 FROM orders),
a AS (SELECT k, v1 FROM ch WHERE s1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY o DESC) = 1),
b AS (SELECT k, v2, true AS hit FROM ch WHERE s2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY o DESC) = 1)
SELECT c_custkey, coalesce(a.v1, c_mktsegment) AS segment, CASE WHEN b.hit THEN b.v2 ELSE c_nationkey END AS owner,
  CASE WHEN EXISTS (SELECT 1 FROM ch WHERE ch.k = c_custkey) THEN 'touched' ELSE 'old' END AS updated_at
FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def patch_apply(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_mktsegment AS segment", "CAST(c_nationkey AS BIGINT) AS owner", "'old' AS updated_at")
    patches = table(spark, sf, "orders").selectExpr(
        "o_custkey AS c_custkey", "o_orderkey AS seq", "o_orderpriority AS segment", "o_orderkey % 2 = 0 AS set_segment",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS owner", "o_orderkey % 3 = 0 AS set_owner")
    return M.apply_patches(rows, patches, "c_custkey", ["segment", "owner"], "seq", F.lit("touched"))


@query("delete_apply", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)""")
def delete_apply(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 300000").selectExpr("o_custkey AS c_custkey")
    return M.delete_keys(table(spark, sf, "customer").select("c_custkey", "c_name"), gone, ["c_custkey"])


@query("referential_clean", """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_nationkey = 4)
SELECT 'cascade' AS mode, o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL
SELECT 'set_null', o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM gone) THEN o_custkey END FROM orders""")
def referential_clean(spark, sf):
    gone = table(spark, sf, "customer").filter("c_acctbal < 0 OR c_nationkey = 4").select("c_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    kept = M.cascade_delete(orders, gone, "o_custkey", "c_custkey").select(F.lit("cascade").alias("mode"), "o_orderkey", "o_custkey")
    nulled = M.set_null_children(orders, gone, "o_custkey", "c_custkey")
    return kept.unionByName(nulled.select(F.lit("set_null").alias("mode"), "o_orderkey", "o_custkey"))


@query("empty_clean", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'N/A' END AS localisation,
  c_nationkey % 3 AS zero_kept, 'N/A' AS proprietaire, 'N/A' AS capitaine, CASE WHEN c_custkey % 4 = 0 THEN true ELSE false END AS etoile,
  coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END, 99) AS broker_id FROM customer""")
def empty_clean(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN ' \\t ' ELSE c_name END AS name",
        "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS localisation",
        "c_nationkey % 3 AS zero_kept", "CASE WHEN c_custkey % 4 = 0 THEN true END AS etoile",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS broker_id")
    return M.tracked_defaults(M.clean_empty(rows), F.lit(99)).select(
        "c_custkey", "name", "localisation", "zero_kept", "proprietaire", "capitaine", "etoile", "broker_id")


# --- display -----------------------------------------------------------------------------


@query("unit_format", """
SELECT p_partkey, round(CAST(p_size AS DOUBLE) * CAST(3.28084 AS DOUBLE), 4) AS feet,
  replace(replace(replace(format('{:,.2f}', p_retailprice * 1000), ',', '_'), '.', ','), '_', chr(8239)) AS price_fr,
  upper(concat(left(p_name, 1), left(split_part(p_name, ' ', 2), 1))) AS initials,
  CASE WHEN length(p_name) <= 8 THEN p_name ELSE concat(left(p_name, 8), '...') END AS short_name,
  nullif(CAST(concat(p_size, '.5') AS DOUBLE), 0) AS length_m, CAST(2000 + p_size AS INT) AS year_built
FROM part""")
def unit_format(spark, sf):
    from ..functions.money import parse_length, parse_year
    part = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    return part.select(
        "p_partkey", F.round(metres_to_feet(F.col("p_size")), 4).alias("feet"),
        format_fr(F.col("p_retailprice") * 1000, 2).alias("price_fr"), initials(F.col("p_name")).alias("initials"),
        truncate(F.col("p_name"), 8).alias("short_name"),
        parse_length(F.concat(F.lit(" "), size, F.lit(",5 m"))).alias("length_m"),
        parse_year(F.concat((F.col("p_size") + 2000).cast("string"), F.lit(".0"))).alias("year_built"))


@query("contact_names", """
SELECT c_custkey, coalesce(nullif(d, ''), nullif(concat_ws(' ', nullif(f, ''), nullif(l, '')), ''), 'Unknown Contact') AS contact
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS d,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS f, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE NULL END AS l FROM customer)""")
def contact_names(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS d",
        "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS f", "CASE WHEN c_custkey % 5 = 0 THEN 'x' END AS l")
    return rows.select("c_custkey", display_name(F.col("d"), F.col("f"), F.col("l"), V.UNKNOWN_CONTACT).alias("contact"))


@query("broker_mask", """
SELECT n_nationkey AS id, n_name AS broker_name, '********' AS password, 'kept' AS mode FROM nation
UNION ALL SELECT n_nationkey, n_name, NULL, 'dropped' FROM nation""")
def broker_mask(spark, sf):
    brokers = table(spark, sf, "nation").selectExpr(
        "n_nationkey AS id", "n_name AS broker_name", "concat('pw', n_name) AS password", "sha2(n_name, 256) AS password_hash")
    masked = C.without_secrets(brokers, mask="********").withColumn("mode", F.lit("kept"))
    dropped = C.without_secrets(brokers).withColumn("mode", F.lit("dropped"))
    return masked.drop("password_hash").unionByName(dropped, allowMissingColumns=True)
