"""Order-dependent work that stays exact and parallel when one group is huge.

``top_k`` relies on the rank filter that Spark applies on the map side before the
shuffle (WindowGroupLimit), so a hot group ships at most k rows per task.

``numbered`` ranks *every* row of a group.  A plain window would send a hot group to
one task, so each group is cut into blocks of ``block`` consecutive ordinals: block
sizes are counted with partial aggregation, their running total gives each block's
offset, and only the rows of one block meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BLOCK = 1_000_000


def top_k(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group in the given order; ``order`` must be total."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def keys_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys for the right side of a semi or anti join.  The duplicates of a hot
    key go away on the map side instead of meeting in the one task that joins it."""
    return df.select(*keys).distinct()


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """First row of every group."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def numbered(
    df: DataFrame,
    keys: list[str],
    ordinal: str,
    coarse: list[Column] | None = None,
    rank: str = "rank",
    block: int = BLOCK,
) -> DataFrame:
    """Number every row of a group by the ``coarse`` sort values, then by ordinal.

    ``ordinal`` is an integer column, unique within the group.  ``coarse`` holds sort
    expressions over columns with few values (a bounded score, a flag).
    """
    coarse = coarse or []
    names = [f"_c{i}" for i in range(len(coarse))]
    plain = df
    for name, expression in zip(names, coarse):
        plain = plain.withColumn(name, expression)
    plain = plain.withColumn("_b", F.floor(F.col(ordinal) / F.lit(block)))
    # one struct key: null group values compare equal and the window below
    # reuses the partitioning of the join
    keyed = plain.withColumn("_k", F.struct(*keys, *names, "_b"))
    sizes = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    group = [F.col("_k")[k] for k in keys]
    before = Window.partitionBy(*group).orderBy(
        *[F.col("_k")[n] for n in names], F.col("_k")["_b"]
    ).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_k").orderBy(ordinal)
    return (
        keyed.join(offsets, "_k", "left")
        .withColumn(rank, (F.col("_offset") + F.row_number().over(inside)).cast("long"))
        .drop("_k", "_b", "_offset", *names)
    )


def positions(df: DataFrame, order: list[tuple[str, bool]], out: str = "position", partitions: int | None = None) -> DataFrame:
    """Every row with its place, from 1, in the order of (column, ascending) pairs, which must be total.

    Ranges of the order are dealt to partitions and sorted there; the rows go to a table of the shared
    folder with their place inside their partition, partitions are counted, and a row's position is its place plus the
    rows of the partitions before.  A value that a third of all rows share is split by the columns after it, so
    no partition is hot, and no window sees more than its partition's count.  Null sorts first when ascending.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    placed = materialise(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(
        "_place", F.monotonically_increasing_id()))
    # the id is the partition's number above 33 bits that count its rows
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    starts, total = [], 0
    for r in sizes:  # one number a partition
        starts.append((r["p"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        out, F.col("_before") + inside + 1).drop("_part", "_before", "_place")
