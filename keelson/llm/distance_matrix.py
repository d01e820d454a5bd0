"""Centroid clustering (Lloyd rounds) by an incremental distance matrix.

A table in the shared folder holds, for every vector, its exact integer dot product with every
centroid.  When centroids move, a dot product changes by the vector's component times the change of
the centroid's, so a round reads the table once, adds those products for the components that did
change, recomputes the nearest centroid from ``c.c - 2 v.c`` and writes the next table.  The starting
centroids are a change from zero, so the first table is made by the same step.

Scale: no vector is ever shuffled.  A round is one pass over the table, in tasks of one Arrow batch of
rows at a time, and one aggregate of at most ``k`` rows a task.  Only the centroids (``k`` times
``width`` integers, parameters) pass the driver.  Tables are written files, so a lost executor costs a
re-read; a table goes as soon as the next one is complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.arrow_text import arrow_batches
from keelson.session import fresh_path, materialise, remove

#: Components beyond this have no squared distance of 64 bits.
LIMIT = 1 << 27
#: Integers below this are exact as doubles.
EXACT = 1 << 53


def integers(vector: str, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("int"))


def usable(vector: str, width: int, scale: float) -> Column:
    """Exactly ``width`` components, none null, NaN, infinite or beyond ``LIMIT``."""
    def whole(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(LIMIT / scale))

    return F.coalesce((F.size(vector) == width) & F.forall(vector, whole), F.lit(False))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least hash; ``rows`` that share an id follow in order of their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = rows.select(order.alias("h"), "vec_id", "w").orderBy(F.col("h").asc_nulls_last(), "w").limit(k).collect()
    return np.array([r["w"] for r in chosen], np.int64)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column of equal lengths as an integer matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def moved(dots: np.ndarray, w: np.ndarray, change: np.ndarray) -> None:
    """Add to every dot product what the changed components of its centroid add."""
    size = int(np.abs(w).max(initial=0))
    as_double = w.astype(np.float64) if size * int(np.abs(change).max(initial=0)) * w.shape[1] < EXACT else None
    for j in np.flatnonzero(change.any(axis=1)):
        at = np.flatnonzero(change[j])
        if as_double is not None:
            dots[:, j] += (as_double[:, at] @ change[j, at].astype(np.float64)).astype(np.int64)
        else:
            dots[:, j] += w[:, at] @ change[j, at]


def assigned(rows: DataFrame, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
    """The next table from (vec_id, w[, dots]): dot products with ``new`` (those with ``old`` being in
    ``dots``, or none yet), the nearest centroid, ties to the smaller number, and its squared distance."""
    k, width = new.shape
    change = new if old is None else new - old
    norms = (new * new).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            w = matrix(batch.column("w"), width)
            dots = np.zeros((len(w), k), np.int64) if old is None else matrix(batch.column("dots"), k)
            moved(dots, w, change)
            nearness = norms - 2 * dots
            cluster = nearness.argmin(axis=1)
            distance = nearness[np.arange(len(w)), cluster] + (w * w).sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, dots.size + 1, k), pa.int32()), pa.array(dots.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("w"), lists, pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "w", "dots", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, w array<int>, dots array<long>, cluster int, distance long")


def means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise exact floor of the mean of every cluster; empty clusters keep their centroid.
    A task adds up its own rows; sums have 64 bits, room for 2^36 vectors at the limit of a component."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            order = np.argsort(cluster, kind="stable")
            if len(order):
                found, starts = np.unique(cluster[order], return_index=True)
                sums[found] += np.add.reduceat(matrix(batch.column("w"), width)[order], starts)
                sizes += np.bincount(cluster, minlength=k)
        at, part = np.nonzero(sizes > 0)[0], np.arange(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, width), pa.int32()), pa.array(np.tile(part, len(at)), pa.int32()),
             pa.array(sums[at].ravel()), pa.array(np.repeat(sizes[at], width))], names=["cluster", "part", "s", "n"])

    partial = table.select("cluster", "w").mapInArrow(run, "cluster int, part int, s long, n long")
    out = centroids.copy()
    for r in partial.groupBy("cluster", "part").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["part"]] = r["s"] // r["n"]
    return out


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64, scale: float = 256.0,
              vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, w, cluster, distance) of every usable vector and the final centroids.

    Components become ``floor(scale * x)``.  Centroids start as the ``k`` vectors of least SHA-256 of
    ``seed:vec_id``; every round assigns all vectors and moves every centroid that has vectors to the
    floor of their mean; a last assignment follows.  Rounds end early once no centroid moves, which
    changes nothing.  Fewer than ``k`` vectors are as many centroids.

    A vector that is null, of another width, or holds a null, NaN, infinite or too large
    component (``LIMIT``) takes no part.  A null id takes part, as the last choice for a start.  Repeated
    rows count as often as they stand there; equal vectors have the same cluster.  Other columns are
    not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    # one row in, one row out: the scan's tasks stay as they are
    base_path = fresh_path(spark)
    base = materialise(vectors.filter(usable(vector, width, scale)).select(
        F.col(vec_id).cast("long").alias("vec_id"), integers(vector, scale).alias("w")), base_path)
    new = first_centroids(base, k, seed)
    if not len(new):
        empty = base.select("vec_id", "w", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty, new.reshape(0, width)
    old, table, path = None, base, base_path
    for r in range(rounds + 1):
        next_path = fresh_path(spark)
        table = materialise(assigned(table, old, new), next_path)
        remove(spark, path)
        path = next_path
        if r == rounds:
            break
        old, new = new, means(table, new)
        if (old == new).all():
            break
    return table.select("vec_id", "w", "cluster", "distance"), new


def with_inertia(assignment: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with the distance sums of its cluster and of all, and the digest of the
    centroid's components.  A sum beyond 64 bits is null."""
    spark: SparkSession = assignment.sparkSession
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sums = {r["cluster"]: int(r["s"]) for r in assignment.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def fits(n: int) -> int | None:
        return n if n < 1 << 63 else None

    total = fits(sum(sums.values()))
    # one row a centroid
    facts = spark.createDataFrame([(j, fits(s), total, digests[j]) for j, s in sums.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assignment.join(F.broadcast(facts), "cluster")
