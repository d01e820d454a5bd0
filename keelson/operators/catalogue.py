"""Listing catalogue: filters, owner joins, name resolution, facets, sorts, watch-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import with_price
from ..functions.text import blank_to_null, fold, strip
from ..functions.vocab import NOT_AVAILABLE, UUID_PATTERN
from ..plans.barrier import filter_computed
from ..plans.ordering import keys_of

COLUMNS = {
    "id": "id", "name": "nom_bateau", "builder": "constructeur", "length": "longueur_m",
    "year": "annee", "owner": "broker_id", "location": "localisation", "starred": "etoile",
    "cabins": "nombre_cabines", "price": "prix_actuel",
}


def sanitise_filters(params: dict) -> dict:
    """Clean filter parameters before planning: trimmed and capped texts, bounds in range."""
    out = {}
    for key in ("search", "broker", "location"):
        if params.get(key):
            out[key] = str(params[key]).strip()[:100]
    for key in ("min_length", "max_length"):
        try:
            value = float(params.get(key) or "nan")
        except ValueError:
            continue
        if 0 <= value <= 1000:
            out[key] = value
    if out.get("min_length", 0) > out.get("max_length", float("inf")):
        del out["min_length"], out["max_length"]
    return out


def contains_ci(c: Column, needle: str) -> Column:
    """Literal case-insensitive substring test; null is no match."""
    return F.coalesce(F.contains(F.lower(c), F.lower(F.lit(needle))), F.lit(False))


def unique_names(brokers: DataFrame, name: str, key: str) -> DataFrame:
    """(folded name, id) of the names that belong to exactly one broker."""
    return (
        brokers.groupBy(F.lower(F.col(name)).alias("_name"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_id"))
        .filter(F.col("_n") == 1)
        .select("_name", "_id")
    )


def resolve_names(
    values: DataFrame, column: str, brokers: DataFrame, out: str = "broker_id",
    name: str = "broker_name", key: str = "id", exact_first: bool = False,
) -> DataFrame:
    """Name-or-id to id.  A UUID is taken as it is; a name must match exactly one broker."""
    text = strip(F.col(column))
    df = values.withColumn("_text", text).withColumn("_lower", F.lower(text))
    names = unique_names(brokers, name, key)
    df = df.join(names, df["_lower"] == names["_name"], "left").drop("_name")
    found = F.col("_id")
    if exact_first:
        exact = brokers.groupBy(F.col(name).alias("_exact_name")).agg(
            F.count(F.lit(1)).alias("_exact_n"), F.min(key).alias("_exact_id")
        ).filter(F.col("_exact_n") == 1)
        df = df.join(exact, df["_text"] == exact["_exact_name"], "left").drop("_exact_name", "_exact_n")
        found = F.coalesce(F.col("_exact_id"), found)
    uuid = F.col("_text").rlike(UUID_PATTERN)
    df = df.withColumn(out, F.when(uuid, F.col("_text")).otherwise(found.cast("string")))
    return df.drop("_text", "_lower", "_id", "_exact_id")


def filter_catalogue(
    listings: DataFrame, brokers: DataFrame | None = None, *, search: str | None = None,
    broker: str | None = None, location: str | None = None, min_length: float | None = None,
    max_length: float | None = None, starred: bool = False, match: str = "substring",
    columns: dict | None = None, broker_key: str = "id", broker_name: str = "broker_name",
    search_name_only: bool = False,
) -> DataFrame:
    """AND of the given filters; a bound of 0 counts as not set.

    ``match='exact'`` compares broker and location for equality.  A broker name that
    matches no broker, or several, gives an empty result.
    """
    c = {**COLUMNS, **(columns or {})}
    out = listings
    if search:
        hit = contains_ci(F.col(c["name"]), search)
        out = out.filter(hit if search_name_only else hit | contains_ci(F.col(c["builder"]), search))
    if location:
        out = out.filter(
            F.col(c["location"]) == location if match == "exact"
            else contains_ci(F.col(c["location"]), location))
    if min_length:
        out = out.filter(F.col(c["length"]) >= min_length)
    if max_length:
        out = out.filter(F.col(c["length"]) <= max_length)
    if starred:
        out = out.filter(F.col(c["starred"]))
    if broker:
        if match == "exact":
            owners = brokers.filter(F.col(broker_name) == broker).select(F.col(broker_key).alias("_owner"))
        elif _is_uuid(broker.strip()):
            return out.filter(F.col(c["owner"]) == broker.strip())
        else:
            wanted = brokers.filter(F.lower(F.col(broker_name)) == F.lower(F.lit(broker.strip())))
            owners = wanted.agg(F.count(F.lit(1)).alias("_n"), F.min(broker_key).alias("_owner")).filter(
                F.col("_n") == 1).select("_owner")
        out = out.join(owners, out[c["owner"]] == owners["_owner"], "left_semi")
    return out


def _is_uuid(text: str) -> bool:
    import re
    return re.match(UUID_PATTERN, text) is not None


def filter_price(df: DataFrame, price: str, low: float | None, high: float | None,
                 mode: str = "corrected", out: str = "price") -> DataFrame:
    """Add the parsed price; with a bound set keep only readable prices inside the bounds."""
    df = with_price(df, price, out, mode)
    if not low and not high:
        return df

    def inside(p):
        ok = p.isNotNull()
        ok = ok & (p >= low) if low else ok
        return ok & (p <= high) if high else ok

    return filter_computed(df, inside(F.col(out)))


def filter_cabins(df: DataFrame, cabins: str, low: int | None, high: int | None) -> DataFrame:
    """With a bound set, rows without a cabin count (null or 0) are excluded."""
    if low or high:
        df = df.filter(F.coalesce(F.col(cabins), F.lit(0)) != 0)
        if low:
            df = df.filter(F.col(cabins) >= low)
        if high:
            df = df.filter(F.col(cabins) <= high)
    return df


def sort_catalogue(df: DataFrame, by: str, column: str, tiebreak: str) -> DataFrame:
    """``name``, ``size-asc|desc`` or ``price-asc|desc``; an unreadable price sorts as 0."""
    key = F.col(column)
    if by.startswith("price"):
        key = F.coalesce(key, F.lit(0.0))
    return df.orderBy(key.desc() if by.endswith("-desc") else key.asc(), F.col(tiebreak).asc())


def with_broker(df: DataFrame, brokers: DataFrame, owner: str = "broker_id", key: str = "id",
                names: tuple = ("broker_name", "email"), prefix: str = "") -> DataFrame:
    """Left join adding broker columns.  Spark broadcasts the brokers only while their
    measured size is under ``spark.sql.autoBroadcastJoinThreshold``."""
    dim = brokers.select(F.col(key).alias("_bk"), *[F.col(n).alias(prefix + n) for n in names])
    return df.join(dim, df[owner] == dim["_bk"], "left").drop("_bk")


def lookup(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key (or key and owner) is asked for."""
    return df.join(keys_of(wanted, on), on, "left_semi")


def without_secrets(df: DataFrame, columns: tuple = ("password", "password_hash"),
                    mask: str | None = None) -> DataFrame:
    """Drop sensitive columns, or replace them by a fixed mask."""
    if mask is None:
        return df.drop(*columns)
    return df.withColumns({c: F.lit(mask) for c in columns if c in df.columns})


def distinct_values(df: DataFrame, column: str, out: str = "value") -> DataFrame:
    """Distinct non-blank values, sorted."""
    value = F.col(column)
    return df.filter(strip(value) != "").select(value.alias(out)).distinct().orderBy(out)


def distinct_first_filled(df: DataFrame, columns: list[str], out: str = "value") -> DataFrame:
    """Distinct first non-blank value over several columns, sorted."""
    value = F.coalesce(*[blank_to_null(F.col(c)) for c in columns])
    return df.select(value.alias(out)).filter(F.col(out).isNotNull()).distinct().orderBy(out)


def watchlist(stored: DataFrame, defaults: DataFrame, *, search: str | None = None,
              starred: bool = False, other_filters: bool = False, name: str = "nom_bateau",
              key: str = "id") -> DataFrame:
    """Stored tracked rows plus the default entries no stored row has the name of.

    ``defaults`` carries (name, year, starred, position); default rows get a
    synthetic id, zero length and year.  Broker, location or length filters
    (``other_filters``) suppress the defaults altogether.
    """
    if other_filters:
        return stored
    extra = defaults.withColumn("_folded", fold(F.col(name), "plain"))
    known = stored.select(fold(F.coalesce(F.col(name), F.lit("")), "plain").alias("_folded")).distinct()
    extra = extra.join(known, "_folded", "left_anti")
    if search:
        extra = extra.filter(F.contains(F.col("_folded"), fold(F.lit(search), "plain")))
    if starred:
        extra = extra.filter(F.col("etoile"))
    filler = {
        key: F.concat_ws("-", F.lit("virtual"), F.replace(F.col("_folded"), F.lit(" "), F.lit("-")),
                         F.col("position").cast("string")),
        "constructeur": F.lit("—"), "longueur_m": F.lit(0),
        "annee": F.coalesce(F.col("annee"), F.lit(0)), "proprietaire": F.lit(NOT_AVAILABLE),
        "capitaine": F.lit(NOT_AVAILABLE), "broker_id": F.lit(""),
        "localisation": F.lit(NOT_AVAILABLE), "etoile": F.coalesce(F.col("etoile"), F.lit(False)),
    }
    columns = []
    for field in stored.schema.fields:
        value = F.col(name) if field.name == name else filler.get(field.name, F.lit(None))
        columns.append(value.cast(field.dataType).alias(field.name))
    return stored.unionByName(extra.select(*columns))
