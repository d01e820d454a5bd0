"""Table maintenance as set operations: seeding, patches, deletes, clean-up, defaults.

Parquet has no MERGE, so each job returns the complete new table for a swap.  The ``*_in_place`` jobs work on a
table filed by its key (``sources.filed``) and rewrite only the buckets that hold changed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..functions.vocab import NOT_AVAILABLE
from ..plans.ordering import first_per_key, keys_of
from ..sources import filed


def seed_missing(existing: DataFrame, wanted: DataFrame, key: str, ordinal: str | None = None) -> DataFrame:
    """Existing rows plus the wanted rows whose key is not there yet (idempotent)."""
    wanted = (
        first_per_key(wanted, [key], [F.col(ordinal)]) if ordinal else wanted.dropDuplicates([key]))
    fresh = wanted.join(keys_of(existing, [key]), key, "left_anti")
    return existing.unionByName(fresh.select(*[c for c in existing.columns if c in fresh.columns]),
                                allowMissingColumns=True)


def apply_patches(
    table: DataFrame, patches: DataFrame, key: str, fields: list[str], ordinal: str,
    stamp: Column | None = None, stamp_column: str = "updated_at", owner: str | None = None,
) -> DataFrame:
    """Apply partial updates; a field is written only where the patch carries it.

    A patch row has ``key``, ``ordinal``, the fields and a flag ``set_<field>`` for
    each.  The last patch that carries a field wins.  With ``owner`` a patch must also
    name the row's owner.
    """
    keys = [key] + ([owner] if owner else [])
    latest = patches.groupBy(*keys).agg(*[
        F.max_by(F.struct(F.col(f).alias("value")),
                 F.when(F.col(f"set_{f}"), F.col(ordinal))).alias(f"_new_{f}")
        for f in fields
    ])
    # max_by ignores null orderings, so a field nobody set stays null; a set to
    # null arrives as a struct that holds null
    latest = latest.withColumn("_patched", F.lit(True))
    joined = table.join(latest, keys, "left")
    out = joined.withColumns({
        f: F.when(F.col(f"_new_{f}").isNotNull(), F.col(f"_new_{f}.value")).otherwise(F.col(f))
        for f in fields
    })
    if stamp is not None:
        out = out.withColumn(
            stamp_column, F.when(F.col("_patched"), stamp).otherwise(F.col(stamp_column)))
    return out.select(*table.columns)


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys_of(keys, on), on, "left_anti")


def cascade_delete(children: DataFrame, deleted: DataFrame, parent: str, key: str) -> DataFrame:
    """Children without those of a deleted parent."""
    gone = deleted.select(F.col(key).alias(parent)).distinct()
    return children.join(gone, parent, "left_anti")


def set_null_children(children: DataFrame, deleted: DataFrame, parent: str, key: str) -> DataFrame:
    """Children kept, the reference to a deleted parent emptied."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    joined = children.join(gone, children[parent] == gone["_gone"], "left")
    return joined.withColumn(
        parent, F.when(F.col("_gone").isNull(), F.col(parent))).select(*children.columns)


def _key(spark: SparkSession, path: str) -> str:
    return filed.info(spark, path)["key"]


def patch_in_place(spark: SparkSession, path: str, patches: DataFrame, fields: list[str], ordinal: str,
                   stamp: Column | None = None, stamp_column: str = "updated_at", owner: str | None = None,
                   mark: int | None = None) -> list[int]:
    """``apply_patches`` on a filed table; returns the buckets rewritten.  A batch of patches with a
    rising ``mark`` is applied once, however often it is repeated."""
    key = _key(spark, path)
    return filed.change(
        spark, path, filed.buckets_of(spark, path, patches, key),
        lambda rows: apply_patches(rows, patches, key, fields, ordinal, stamp, stamp_column, owner), mark)


def delete_in_place(spark: SparkSession, path: str, keys: DataFrame, on: list[str] | None = None,
                    mark: int | None = None) -> list[int]:
    """``delete_keys`` on a filed table; ``on`` may name more columns than its key (an owner)."""
    key = _key(spark, path)
    return filed.change(spark, path, filed.buckets_of(spark, path, keys, key),
                        lambda rows: delete_keys(rows, keys, on or [key]), mark)


def children_buckets(spark: SparkSession, path: str, deleted: DataFrame, parent: str, key: str) -> list[int]:
    """Buckets of the rows that refer to a deleted parent: read from two columns of the children."""
    children = filed.read(spark, path).select(_key(spark, path), parent)
    gone = keys_of(deleted, [key]).select(F.col(key).alias(parent))
    return filed.buckets_of(spark, path, children.join(gone, parent, "left_semi"), _key(spark, path))


def cascade_in_place(spark: SparkSession, path: str, deleted: DataFrame, parent: str, key: str,
                     mark: int | None = None) -> list[int]:
    """``cascade_delete`` on filed children."""
    return filed.change(spark, path, children_buckets(spark, path, deleted, parent, key),
                        lambda rows: cascade_delete(rows, deleted, parent, key), mark)


def set_null_in_place(spark: SparkSession, path: str, deleted: DataFrame, parent: str, key: str,
                      mark: int | None = None) -> list[int]:
    """``set_null_children`` on filed children, which must be filed by another column than ``parent``."""
    if _key(spark, path) == parent:
        raise ValueError("children filed by their parent would change their bucket")
    return filed.change(spark, path, children_buckets(spark, path, deleted, parent, key),
                        lambda rows: set_null_children(rows, deleted, parent, key), mark)


def clean_empty(df: DataFrame) -> DataFrame:
    """Blank texts and empty arrays become null; 0 and false stay."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = F.when(strip(c) != "", c)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.when(F.size(c) > 0, c)
        out.append(c.alias(field.name))
    return df.select(*out)


def tracked_defaults(df: DataFrame, fallback_owner: Column) -> DataFrame:
    """Insert defaults of the tracked tables."""
    return df.withColumns({
        "proprietaire": F.lit(NOT_AVAILABLE),
        "capitaine": F.lit(NOT_AVAILABLE),
        "localisation": F.coalesce(F.col("localisation"), F.lit(NOT_AVAILABLE)),
        "etoile": F.coalesce(F.col("etoile"), F.lit(False)),
        "broker_id": F.coalesce(F.col("broker_id"), fallback_owner),
    })
