"""URL columns: canonical form, safety, host buckets and source types.

One regular expression splits a URL into a struct (:func:`parse_url`); the other
builders read that struct, so each URL is matched once and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V
from .text import contains_any, strip

# scheme, user info, host, port, path, query
URL_PATTERN = (
    r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^:/?#@\[\]]*)"
    r"(?::([^/?#@]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
)
SEPARATOR = "\u0001"


def parse_url(df: DataFrame, url: str, out: str = "u") -> DataFrame:
    """Add ``out`` = struct<scheme, user, host, port, path, query>.

    Every field is '' when the text is not an absolute URL.
    """
    parts = F.col("_url_parts")
    text = F.translate(strip(F.coalesce(F.col(url), F.lit(""))), "\t\r\n" + SEPARATOR, "")
    replacement = SEPARATOR.join(f"${i}" for i in range(1, 7))
    df = df.withColumn("_url_parts", F.split(F.regexp_replace(text, URL_PATTERN, replacement), SEPARATOR))

    def part(i):
        return F.when(F.size(parts) == 6, F.get(parts, F.lit(i))).otherwise(F.lit(""))

    host = F.translate(F.lower(part(2)), "[]", "")
    return df.withColumn(
        out,
        F.struct(
            F.lower(part(0)).alias("scheme"), part(1).alias("user"), host.alias("host"),
            part(3).alias("port"), part(4).alias("path"), part(5).alias("query"),
        ),
    ).drop("_url_parts")


def canonical(u: Column) -> Column:
    """Canonical http(s) URL, '' when it is not acceptable.

    No credentials, default ports only (and dropped), lower-case host, single
    slashes, the query kept, the fragment and trailing slashes dropped; country
    sub-domains of the profile network fold to ``www`` for profile pages.
    """
    path = F.regexp_replace(u["path"], r";[^/]*$", "")
    path = F.regexp_replace(F.concat(F.lit("/"), F.ltrim(path, F.lit("/"))), "/{2,}", "/")
    host = F.rtrim(u["host"], F.lit("."))
    profile = F.endswith(host, F.lit("." + V.PROFILE_DOMAIN)) & F.startswith(path, F.lit("/in/"))
    out = F.concat(
        u["scheme"], F.lit("://"),
        F.when(profile, F.lit("www." + V.PROFILE_DOMAIN)).otherwise(host),
        path, F.when(u["query"] == "?", F.lit("")).otherwise(u["query"]),
    )
    acceptable = (
        u["scheme"].isin("http", "https")
        & (u["host"] != "")
        & ~u["user"].rlike("[^:]")
        & u["port"].rlike(r"^(?:0*(?:80|443))?$")
    )
    return F.when(acceptable, F.rtrim(out, F.lit("/"))).otherwise(F.lit(""))


def with_canonical(df: DataFrame, url: str, out: str) -> DataFrame:
    """Add the canonical form of a URL column."""
    return parse_url(df, url, "_u").withColumn(out, canonical(F.col("_u"))).drop("_u")


def is_public(u: Column) -> Column:
    """False for IP literals (any notation), localhost and ``.local`` names."""
    host = u["host"]
    return (
        (host != "")
        & ~F.contains(host, F.lit(":"))
        & (host != "localhost")
        & ~F.endswith(host, F.lit(".local"))
        & ~host.rlike(r"(?:^|\.)(?:\d+|0x[0-9a-f]*)$")
    )


def with_safe(df: DataFrame, url: str, out: str, depth: int = 2) -> DataFrame:
    """Add the canonical URL when it may be visited, else null.

    Ports must be the scheme's own; links of the known redirector are replaced
    by their target, at most ``depth`` times.
    """
    u = F.col("_u")
    redirector = F.endswith(u["host"], F.lit(V.REDIRECTOR_DOMAIN))
    own_port = u["port"].rlike("^$") | (
        (u["scheme"] == "http") & u["port"].rlike("^0*80$")
    ) | ((u["scheme"] == "https") & u["port"].rlike("^0*443$"))
    text = strip(F.coalesce(F.col(url), F.lit("")))
    df = df.withColumn("_link", F.when(F.startswith(text, F.lit("//")), F.concat(F.lit("https:"), text)).otherwise(text))
    for step in range(depth + 1):
        df = parse_url(df, "_link", "_u")
        df = df.withColumn("_safe", F.when(own_port & is_public(u), F.nullif(canonical(u), F.lit(""))))
        if step < depth:
            target = F.regexp_extract(u["query"], rf"[?&]{V.REDIRECTOR_PARAM}=([^&]*)", 1)
            df = df.withColumn(
                "_link",
                F.when(redirector, F.when(F.col("_safe").isNotNull(), F.try_url_decode(target)))
                .otherwise(F.col("_link")),
            )
    return df.withColumn(out, F.when(~redirector, F.col("_safe"))).drop("_link", "_u", "_safe")


def bucket(u: Column) -> Column:
    """Last two labels of the host."""
    return F.substring_index(u["host"], ".", -2)


def in_domain(u: Column, domain: Column) -> Column:
    """Host equals the domain or is one of its sub-domains; '' matches nothing."""
    return (domain != "") & (
        (u["host"] == domain) | F.endswith(u["host"], F.concat(F.lit("."), domain)))


def is_profile_person(u: Column) -> Column:
    return F.endswith(u["host"], F.lit(V.PROFILE_DOMAIN)) & F.startswith(F.lower(u["path"]), F.lit("/in/"))


def is_profile_company(u: Column) -> Column:
    return F.endswith(u["host"], F.lit(V.PROFILE_DOMAIN)) & F.startswith(F.lower(u["path"]), F.lit("/company/"))


def source_type(u: Column, own_domain: Column) -> Column:
    """Source type by ordered host rules, full rule set."""
    host = u["host"]
    return (
        F.when(F.endswith(host, F.lit(V.PROFILE_DOMAIN)), "linkedin")
        .when(in_domain(u, own_domain), "company_website")
        .when(contains_any(host, V.MARITIME_HOSTS), "maritime_db")
        .when(contains_any(host, V.PEP_HOSTS), "pep_db")
        .when(contains_any(host, V.SANCTION_HOSTS)
              & F.contains(F.concat(host, F.lower(u["path"])), F.lit("sanction")), "sanctions_db")
        .when(contains_any(host, V.REGISTRY_HOSTS), "official_registry")
        .when(contains_any(host, V.COURT_HOSTS), "court_record")
        .when(contains_any(host, V.NEWS_HOSTS), "news")
        .otherwise("other")
    )


def source_type_short(u: Column, own_domain: Column) -> Column:
    """Source type, short rule set."""
    host = u["host"]
    return (
        F.when(in_domain(u, own_domain), "company_website")
        .when(F.contains(host, F.lit(V.PROFILE_DOMAIN)), "linkedin")
        .when(contains_any(host, ("sanction", "ofac", "europa.eu")), "sanctions_db")
        .when(contains_any(host, ("company", "registry", "registre")), "official_registry")
        .when(contains_any(host, ("news", "press", "reuters")), "news")
        .otherwise("other")
    )
