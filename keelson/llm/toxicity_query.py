"""op4: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.arrow_text import arrow_batches, table
from keelson.llm.ftrl import fit, held_out, score, training_rows

REJECT_AT = 0.3


def op4_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents")
    weights = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs, weights, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= REJECT_AT).cast("int").alias("predicted"))


QUERIES = {"op4_ftrl": op4_ftrl}
ORACLE = {}
