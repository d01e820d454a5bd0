"""op13: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.arrow_text import table
from keelson.llm.cross_parsing import fit, held_out, labelled_passages, predict


def op13_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(labelled_passages(docs)), ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op13_cross_parsing": op13_cross_parsing}
ORACLE = {}
