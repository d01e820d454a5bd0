"""op10: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.anchor_cover import near_duplicates
from keelson.llm.arrow_text import table


def op10_anchor_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_anchor_cover": op10_anchor_cover}
ORACLE = {}
