"""The corpus pipeline: each stage is written as Parquet and reread as the next one's documents.

Rows travel through the stages as one struct, so further columns of the input come through as they are
and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.anchor_cover import first_rows
from keelson.llm.arrow_text import arrow_batches, table
from keelson.llm.ftrl import fit, score, training_rows
from keelson.llm.order_sample import mixed
from keelson.llm.secrets_markov import ratio_table, redacted, scan, spans
from keelson.llm.wu_manber import contaminated, find_items, n_hit
from keelson.session import materialise

REJECT_AT = 0.3


def whole_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), "doc_id", "text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.3 or more go; rows without text stay if the bias says so."""
    arrow_batches(spark)
    weights = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    scored = score(whole_rows(docs), weights, ["row"])
    return scored.filter(F.col("score") < REJECT_AT).select("row.*")


def row_digest(docs: DataFrame) -> Column:
    """64 bits of all columns but the text; nulls count, and maps go by their JSON."""
    parts = []
    for f in docs.schema.fields:
        if f.name != "text":
            c = F.col(f"`{f.name}`")
            parts += [c.isNull(), F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c]
    return F.xxhash64(*parts)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays: the one of the smallest id, rows without id last, then of the
    smallest digest of its text and of its other columns.  Rows are judged one by one, so different
    texts under one id stay, and copies without id go."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", row_digest(docs).alias("_other"),
                       F.xxhash64(F.isnull("text"), "text").alias("_same"))
    keys = ["_same", "_other"]
    first = first_rows(rows, keys, [F.isnull("doc_id"), F.col("doc_id")])
    return rows.join(first, keys, "left_semi").dropDuplicates(keys).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty inside test items go."""
    found = find_items(whole_rows(docs), table(spark, sf_dir, "benchmark"), ["row"])
    return found.filter(~contaminated(n_hit(), F.col("n_words"))).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, n_chars follows the new text."""
    scanned = scan(whole_rows(docs).select("row", "text"), ["row"])
    marked = spans(scanned, ratio_table(scanned, docs))
    text = redacted(F.col("row.text"), F.col("_all"))
    changed = F.size("_all") > 0
    new = {"text": text, "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return marked.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies."""
    return mixed(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secrets", secrets), ("mixing", mixing)]

# the scores, fingerprints and Markov spans are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
