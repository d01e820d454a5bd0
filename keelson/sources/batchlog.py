"""A log of micro-batches whose number of files stays bounded.

Every batch is a folder.  As soon as ``fold_at`` neighbouring folders of one level stand at the end of the
log they are written as one folder of the next level, so ``n`` batches leave at most ``fold_at - 1`` folders of
each of ``log n`` levels, and a row is rewritten once a level.  The state of the log (``versions``) names
the folders that count: a batch that is repeated after a failure is not added twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .versions import Files, advance, current

FOLD_AT = 10
#: Rows of a folded file, about.
FILE_ROWS = 1_000_000


def _name(level: int, first: int, last: int) -> str:
    return f"batches-{level}-{first}-{last}"


def _parts(folder: str) -> tuple[int, int, int]:
    level, first, last = folder.split("-")[1:]
    return int(level), int(first), int(last)


def mark(spark: SparkSession, path: str) -> int | None:
    """The last batch the log holds."""
    found = current(Files(spark, path))
    return found[1]["mark"] if found else None


def append(df: DataFrame, path: str, batch_id: int, fold_at: int = FOLD_AT) -> None:
    """Add a batch, unless the log has it already, and fold what is due."""
    spark = df.sparkSession
    files = Files(spark, path)
    found = current(files)
    number, state = found or (-1, {"folders": [], "rows": [], "mark": None, "schema": df.schema.jsonValue()})
    if state["mark"] is not None and batch_id <= state["mark"]:
        return
    folder = _name(0, batch_id, batch_id)
    df.write.mode("overwrite").parquet(f"{files.path}/{folder}")
    schema = T.StructType.fromJson(state["schema"])
    rows = spark.read.schema(schema).parquet(f"{files.path}/{folder}").count()  # read from the file footers
    if rows:
        state = state | {"folders": [*state["folders"], folder], "rows": [*state["rows"], rows]}
    number += 1
    advance(files, number, state | {"mark": batch_id})
    while True:
        due = state["folders"][-fold_at:]
        if len(due) < fold_at or len({_parts(f)[0] for f in due}) > 1:
            return
        level, first, _ = _parts(due[0])
        folded, n = _name(level + 1, first, _parts(due[-1])[2]), sum(state["rows"][-fold_at:])
        spark.read.schema(schema).parquet(*[f"{files.path}/{f}" for f in due]).coalesce(
            max(1, -(-n // FILE_ROWS))).write.mode("overwrite").parquet(f"{files.path}/{folded}")
        state = state | {"folders": [*state["folders"][:-fold_at], folded], "rows": [*state["rows"][:-fold_at], n]}
        number += 1
        advance(files, number, state | {"mark": batch_id})


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the log, None while it has never been written."""
    files = Files(spark, path)
    found = current(files)
    if found is None:
        return None
    schema = T.StructType.fromJson(found[1]["schema"])
    if not found[1]["folders"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{files.path}/{f}" for f in found[1]["folders"]])
