"""Price, length and year texts to numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip
from .vocab import WS

NUMBER_PREFIX = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
SUFFIXED = r"(\d[\d.,]*)\s*(M|K)(?:[^A-Z]|ILLION|EUR|USD|GBP|$)"


def leading_number(c: Column) -> Column:
    """Number at the start of a text; null when there is none."""
    return F.regexp_extract(c, NUMBER_PREFIX, 1).try_cast("double")


def unify_separators(c: Column) -> Column:
    """Rewrite mixed thousands/decimal separators so that '.' is the decimal."""
    without_commas = F.replace(c, F.lit(","), F.lit(""))
    without_dots = F.replace(c, F.lit("."), F.lit(""))
    return (
        # both, comma last: European text
        F.when(c.rlike(r"\..*,[^.]*$"), F.translate(without_dots, ",", "."))
        # one comma among the last three characters: a decimal comma
        .when(c.rlike(r"^[^,.]*,[^,.]{0,2}$"), F.translate(c, ",", "."))
        .when(F.contains(c, F.lit(",")), without_commas)
        # several dots: thousands
        .when(c.rlike(r"\..*\."), without_dots)
        .otherwise(c)
    )


def with_price(df: DataFrame, price: str, out: str, mode: str = "corrected") -> DataFrame:
    """Add the number a price text stands for, null when none can be read.

    ``strict`` scales only a plain decimal followed by M, whatever comes after;
    ``corrected`` (default) also reads ``K`` and a decimal comma before the suffix.
    The steps are separate projections so that each text is derived once.
    """
    if mode not in ("strict", "corrected"):
        raise ValueError(f"unknown mode {mode!r}")
    text, bare, number = F.col("_price_text"), F.col("_price_bare"), F.col("_price_number")
    df = df.withColumn("_price_text", F.upper(strip(F.col(price))))
    df = df.withColumn("_price_bare", F.regexp_replace(text, "[€$£¥" + WS[1:-1] + "]", ""))
    plain = leading_number(unify_separators(bare))
    if mode == "strict":
        df = df.withColumn("_price_number", F.regexp_extract(text, r"(\d+\.?\d*)\s*M", 1))
        value = F.when(number != "", number.cast("double") * F.lit(1000000.0)).otherwise(plain)
    else:
        df = df.withColumn("_price_number", F.regexp_extract(text, SUFFIXED, 1))
        scale = F.when(F.regexp_extract(text, SUFFIXED, 2) == "M", F.lit(1000000.0)).otherwise(F.lit(1000.0))
        single = number.rlike(r"^\d*[.,]\d*$")
        scaled = F.when(single, F.translate(number, ",", ".")).otherwise(unify_separators(number))
        value = F.when(number != "", leading_number(scaled) * scale).otherwise(plain)
    return df.withColumn(out, value).drop("_price_text", "_price_bare", "_price_number")


def parse_length(c: Column) -> Column:
    """Length text: decimal comma accepted, 0 and unreadable become null."""
    return F.nullif(leading_number(F.translate(strip(c), ",", ".")), F.lit(0.0))


def parse_year(c: Column) -> Column:
    """Year text: the integer part before a dot; 0 and unreadable become null."""
    digits = F.regexp_extract(strip(F.substring_index(c, ".", 1)), r"^([+-]?\d+)", 1)
    return F.nullif(digits.try_cast("int"), F.lit(0))


def form_number(c: Column) -> tuple[Column, Column]:
    """Form variant: (value, is_invalid).  Blank is missing, a bad text is an error."""
    text = strip(F.translate(c, ",", "."))
    value = text.try_cast("double")
    return value, (F.coalesce(text, F.lit("")) != "") & value.isNull()
