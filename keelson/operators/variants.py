"""Lead documents and reports as VARIANT: a text is parsed once into binary JSON, columns are typed reads of it.

``leads.parse_documents`` needs the whole schema and keeps unreadable texts apart; here any document is
taken, columns are named by path, and further paths cost no further parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import display_name
from .attempts import REPORT_PATHS
from .leads import PAYLOAD_COLUMNS

#: Columns that are no texts, when asked for as such.
TYPED = {"boat_year": "int", "boat_length_value": "double", "boat_price_amount": "decimal(14,2)"}


def with_variant(df: DataFrame, text: str, out: str = "_variant") -> DataFrame:
    """Add the parsed text; null where it is no JSON."""
    return df.withColumn(out, F.try_parse_json(F.col(text)))


def read(variant: str, path: str, kind: str = "string") -> Column:
    """Value at a path; null where it is missing, null or not of the type."""
    return F.try_variant_get(F.col(variant), f"$.{path}", kind)


def lead_columns(raw: DataFrame, now: Column, text: str = "value", keep: tuple = (), types: dict | None = None) -> DataFrame:
    """All flat lead columns of JSON documents, of the types asked for (else texts).  A missing date becomes ``now``."""
    types = types or {}
    parsed = with_variant(raw, text)
    columns = {out: read("_variant", path, types.get(out, "string")) for out, path in PAYLOAD_COLUMNS.items()}
    columns |= {
        "lead_date": F.coalesce(F.try_to_timestamp(F.nullif(read("_variant", "lead.date"), F.lit(""))), now),
        "contact_display_name": display_name(read("_variant", "contact.name.display"), read("_variant", "contact.name.first"),
                                             read("_variant", "contact.name.last"), V.UNKNOWN_CONTACT),
        "recipient_contact_name": F.nullif(read("_variant", "recipient.contactName"), F.lit("")),
        "status": F.lit("NEW"), "raw_payload": F.col(text)}
    return parsed.select(*keep, *[c.alias(name) for name, c in columns.items()])


def report_columns(attempts: DataFrame, report: str = "report", paths: dict | None = None) -> DataFrame:
    """The attempts with the report values of the latest-attempt view: six paths, one parse."""
    parsed = with_variant(attempts, report)
    return parsed.select(*attempts.columns, *[
        read("_variant", path.removeprefix("$.")).alias(out) for out, path in (paths or REPORT_PATHS).items()])
