"""op5: secrets in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.arrow_text import table
from keelson.llm.secrets_markov import PATTERNS, find_secrets, written


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = find_secrets(table(spark, sf_dir, "documents"))
    return marked.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(written("_base"), 256).alias("base_sha256"), written("_all").alias("spans"))


QUERIES = {"op5_markov_secrets": op5_markov_secrets}
ORACLE = {}
