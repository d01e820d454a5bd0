"""Readers and writers: listing CSV, nested JSON export and import, lead documents, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.money import parse_length, parse_year
from ..functions.text import strip
from ..functions.vocab import NOT_AVAILABLE
from ..schemas import LISTING_CSV


def read_listing_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV, every column a string, under the canonical column names.

    ``multi_line`` reads quoted line breaks, at the price of one task per file."""
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"',
                        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select(*[
        F.col(f"`{header}`").alias(name) for header, name in LISTING_CSV.items() if header in df.columns])


def _value(c: Column) -> Column:
    text = strip(c)
    return F.when((text != "") & (text != NOT_AVAILABLE), text)


def import_listings(raw: DataFrame, brokers: DataFrame, on_unknown: str = "null", key: str = "id",
                    name: str = "broker_name") -> DataFrame:
    """Typed listings with an ``outcome`` column: ``imported``, ``skipped`` (no name or
    builder) or, with ``on_unknown='reject'``, ``rejected``.  Count the outcomes with one
    ``groupBy``; split with a filter."""
    dim = brokers.groupBy(F.col(name).alias("_name")).agg(F.min(key).alias("broker_id"))
    df = raw.withColumn("_broker", _value(F.col("broker")))
    df = df.join(dim, df["_broker"] == dim["_name"], "left")
    boat, builder = _value(F.col("nom_bateau")), _value(F.col("constructeur"))
    unknown = F.col("broker_id").isNull()
    outcome = F.when(boat.isNull() | builder.isNull(), "skipped")
    if on_unknown == "reject":
        outcome = F.when(unknown, "rejected")
    elif on_unknown != "null":
        raise ValueError("on_unknown is 'null' or 'reject'")
    texts = ("prix_actuel", "prix_precedent", "dernier_message", "commentaire")
    defaulted = ("proprietaire", "capitaine", "localisation")
    extra = [c for c in ("external_id", "created_at") if c in raw.columns]
    return df.select(
        boat.alias("nom_bateau"), builder.alias("constructeur"),
        parse_length(F.col("longueur_m")).cast("decimal(10,2)").alias("longueur_m"),
        parse_year(F.col("annee")).alias("annee"),
        *[F.coalesce(_value(F.col(c)), F.lit(NOT_AVAILABLE)).alias(c) for c in defaulted],
        "broker_id", *[_value(F.col(c)).alias(c) for c in texts], *extra,
        outcome_or_default(outcome).alias("outcome"),
        F.col("_broker").isNotNull().alias("broker_named"))


def outcome_or_default(outcome: Column) -> Column:
    return F.coalesce(outcome, F.lit("imported"))


def read_export(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON export ``{id, fields, createdTime}``: fields flattened to canonical names.

    One document per line, which splits; ``multi_line`` reads one array per file instead."""
    schema = "id string, createdTime string, fields struct<" + ", ".join(
        f"`{h}`: string" for h in LISTING_CSV) + ">"
    df = spark.read.schema(schema).json(path, multiLine=multi_line)
    return df.select(
        F.col("id").alias("external_id"), F.to_timestamp("createdTime").alias("created_at"),
        *[F.col(f"fields.`{h}`").alias(name) for h, name in LISTING_CSV.items()])


def write_export(df: DataFrame, path: str, key: str, created: str) -> int:
    """Table to JSON lines ``{id, fields, createdTime}``; returns the number of records, which is
    counted while they are written."""
    fields = [c for c in df.columns if c not in (key, created)]
    seen = Observation()
    rows = export_rows(df, key, created, fields).observe(seen, F.count(F.lit(1)).alias("records"))
    rows.write.mode("overwrite").json(path)
    return seen.get["records"]


def export_rows(df: DataFrame, key: str, created: str, fields: list[str]) -> DataFrame:
    return df.select(
        F.col(key).cast("string").alias("id"), F.struct(*fields).alias("fields"),
        F.col(created).cast("string").alias("createdTime"))


def read_lead_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line, unparsed."""
    return spark.read.text(path)


def append_reports(attempts: DataFrame, path: str) -> None:
    """Versioned report sink: every attempt is kept, partitioned by schema version."""
    report = attempts.schema["report"].dataType.typeName()
    out = attempts if report == "string" else attempts.withColumn("report", F.to_json("report"))
    out.write.mode("append").partitionBy("schema_version").parquet(path)


def broker_emails(names: DataFrame, domain: str, name: str = "broker") -> DataFrame:
    """Broker seed rows from a list of names: address ``name@domain``."""
    text = strip(F.col(name))
    return names.filter(text != "").select(
        F.concat(text, F.lit("@" + domain)).alias("email"), text.alias("broker_name")).distinct()


__all__ = [
    "read_listing_csv", "import_listings", "read_export", "write_export", "export_rows",
    "read_lead_documents", "append_reports", "broker_emails",
]
