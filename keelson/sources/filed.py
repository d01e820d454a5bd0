"""Parquet tables filed by a hash of their key, of which a change rewrites only the folders it touches.

A table has a fixed number of buckets.  ``<path>/gen=<g>/_bucket=<b>`` holds the rows of a bucket as
change number ``g`` left them; the state of the table (``versions``) names the folder that counts for
each bucket.  A change reads the buckets its keys fall in, writes them under a new number and then makes
the new state, so it happens as a whole or not at all, readers are never disturbed, and a writer that dies
leaves nothing that counts.  At most two generations of a bucket exist.

A table gets a bucket for every ``BUCKET_ROWS`` rows unless a number is given: a change of ``n`` keys rewrites at
most ``n`` buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .versions import Files, advance, current

#: Fewest buckets of a table, and rows of a bucket when it is filed.
BUCKETS, BUCKET_ROWS = 16, 500_000


def bucket_of(key: str | Column, buckets: int) -> Column:
    """Bucket of a key; its text decides, so equal keys of different types meet."""
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(c.cast("string")), F.lit(buckets)).cast("int")


def _state(files: Files) -> tuple[int, dict]:
    found = current(files)
    if found is None:
        raise FileNotFoundError(f"no filed table in {files.path}")
    return found


def exists(spark: SparkSession, path: str) -> bool:
    return current(Files(spark, path)) is not None


def info(spark: SparkSession, path: str) -> dict:
    """key, buckets, mark and the folders of the buckets that hold rows."""
    return _state(Files(spark, path))[1]


def _write(df: DataFrame, files: Files, key: str, buckets: int, number: int) -> dict[int, str]:
    """Folders by bucket of the rows, written as generation ``number``."""
    place = f"{files.path}/gen={number}"
    # rows of a bucket meet, so a bucket is one file; a number that is given is kept, so buckets are written side by side
    tasks = min(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.withColumn("_bucket", bucket_of(key, buckets)).repartition(tasks, "_bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy("_bucket").parquet(place)
    return {int(n.split("=")[1]): f"gen={number}/{n}" for n in files.names(place) if n.startswith("_bucket=")}


def create(df: DataFrame, path: str, key: str, buckets: int | None = None, mark: int | None = None) -> None:
    """File a table; the folder must not hold one yet."""
    files = Files(df.sparkSession, path)
    if current(files) is not None:
        raise FileExistsError(f"there is a filed table in {path}")
    buckets = buckets or max(BUCKETS, -(-df.count() // BUCKET_ROWS))
    filed = _write(df, files, key, buckets, 0)
    advance(files, 0, {"key": key, "buckets": buckets, "schema": df.schema.jsonValue(), "mark": mark,
                       "folders": [filed[b] for b in sorted(filed)]})


def _folders(state: dict) -> dict[int, str]:
    return {int(f.rsplit("=", 1)[1]): f for f in state["folders"]}


def _schema(state: dict) -> T.StructType:
    return T.StructType.fromJson(state["schema"])


def _read(spark: SparkSession, files: Files, state: dict, buckets: Iterable[int] | None) -> DataFrame:
    filed = _folders(state)
    wanted = sorted(filed if buckets is None else set(buckets) & set(filed))
    if not wanted:
        return spark.createDataFrame([], _schema(state))
    return spark.read.schema(_schema(state)).parquet(*[f"{files.path}/{filed[b]}" for b in wanted])


def read(spark: SparkSession, path: str, buckets: Iterable[int] | None = None) -> DataFrame:
    """The table, or those of its buckets; only their folders are listed and read."""
    files = Files(spark, path)
    return _read(spark, files, _state(files)[1], buckets)


def buckets_of(spark: SparkSession, path: str, keys: DataFrame, key: str) -> list[int]:
    """Buckets that can hold the keys: at most as many numbers as the table has buckets."""
    found = keys.select(bucket_of(key, info(spark, path)["buckets"]).alias("b")).distinct().collect()
    return sorted(r["b"] for r in found)


def change(spark: SparkSession, path: str, touched: Iterable[int], to: Callable[[DataFrame], DataFrame],
           mark: int | None = None) -> list[int]:
    """Replace the rows of the touched buckets by ``to`` of them, as one step; returns these buckets.

    ``to`` must keep the columns and give rows of the touched buckets only.  ``mark`` is a rising number, such as
    that of a micro-batch: a change whose mark the table has reached is not made again.
    """
    files = Files(spark, path)
    number, state = _state(files)
    if mark is not None and state["mark"] is not None and mark <= state["mark"]:
        return []
    touched = sorted(set(touched))
    schema = _schema(state)
    filed = _folders(state)
    if touched:
        new = to(_read(spark, files, state, touched)).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
        written = _write(new, files, state["key"], state["buckets"], number + 1)
        strays = sorted(set(written) - set(touched))
        if strays:
            raise ValueError(f"the change gave rows of buckets {strays} that it did not read")
        filed = {b: f for b, f in filed.items() if b not in touched} | written
    advance(files, number + 1, state | {"folders": [filed[b] for b in sorted(filed)],
                                        "mark": state["mark"] if mark is None else mark})
    return touched


def upsert(spark: SparkSession, path: str, rows: DataFrame, mark: int | None = None) -> list[int]:
    """Add rows or replace those of the same key, one row a key; only their buckets are rewritten."""
    key = info(spark, path)["key"]
    keys = rows.select(F.col(key).alias("_key")).distinct()
    return change(spark, path, buckets_of(spark, path, rows, key), lambda old: old.join(
        keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(rows), mark)
