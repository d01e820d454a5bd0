"""op7: word-piece counts of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.arrow_text import table
from keelson.llm.wordpiece import count_tokens


def op7_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op7_word_pieces": op7_word_pieces}
ORACLE = {}
