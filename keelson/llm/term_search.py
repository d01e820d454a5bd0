"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights, a term being a dimension.  Rows are dealt into
blocks; queries and candidates meet block by block.  Inside a block every term has a posting list
(rows and weights); for every term of the queries the weighted postings are scattered into a dense
array of scores, one line per query, and a partition selection keeps k rows of each line.  The
k best of all blocks are merged by rank.

The queries are a stated set (ids divisible by ``every``) against all rows.  A task holds one query
block and one candidate block, of ``QUERY_BLOCK`` and ``BLOCK`` rows on average; the score array is
filled for ``LINES`` queries at a time.  Candidates are dealt by a hash of a running number and queries, which are
distinct, by one of id and vector, so neither equal vectors nor one id can fill a block.  Each row travels once per block of the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import materialise

BLOCK, QUERY_BLOCK, LINES = 16_384, 2_048, 128


def weights(vector: str, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: str) -> Column:
    """Not null, and no component null, NaN or infinite."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))),
        F.lit(False))


def dense(rows: pd.Series) -> np.ndarray:
    """Integer matrix of rows that may differ in length; missing terms weigh nothing."""
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best_of(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    rows = rows.sort_values("vec_id", kind="stable")
    ids = rows["vec_id"].to_numpy()
    terms = dense(rows["w"])
    postings = [(np.flatnonzero(terms[:, d]), terms[:, d][np.flatnonzero(terms[:, d])]) for d in range(terms.shape[1])]
    own, asked = queries["vec_id"].to_numpy(), dense(queries["w"])
    for first in range(0, len(own), LINES):
        lines = asked[first: first + LINES]
        scores = np.zeros((len(lines), len(ids)), np.int64)
        for d in range(min(lines.shape[1], len(postings))):
            at, value = postings[d]
            for q in np.flatnonzero(lines[:, d]):
                if len(at) == len(ids):
                    scores[q] += lines[q, d] * value
                else:
                    scores[q, at] += lines[q, d] * value
        for q, line in enumerate(scores):
            me = own[first + q]
            # rows of the query's own id stand together, as ids are sorted
            low, high = np.searchsorted(ids, me, "left"), np.searchsorted(ids, me, "right")
            wanted = min(k + high - low, len(ids))  # enough to leave k without its own
            edge = np.partition(line, len(ids) - wanted)[len(ids) - wanted]
            above = np.flatnonzero(line > edge)
            level = np.flatnonzero(line == edge)[: wanted - len(above)]  # smaller ids first
            at = np.concatenate([above, level])
            at = at[(at < low) | (at >= high)]
            at = at[np.lexsort((ids[at], -line[at]))][:k]
            if len(at):
                yield pd.DataFrame({"query_id": me, "vec_id": ids[at], "score": line[at]})


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, vec_id: str = "vec_id",
          vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product with each query,
    ties to the smaller id.

    Rows without id or with an unusable vector take no part; an empty vector has no terms and scores
    0 with every row; vectors of different lengths share their first components.  Rows with the query's
    own id are its own and left out; a repeated query (same id and vector) asks once; repeated
    candidates rank one by one.  Queries that share an id but not the vector get the best of both.
    Scores are 64-bit sums.  Other columns are not read; an empty table gives an empty result.
    """
    rows = materialise(vectors.filter(F.col(vec_id).isNotNull() & usable(vector)).select(
        F.col(vec_id).cast("long").alias("vec_id"), weights(vector, scale).alias("w")))
    queries = rows.filter(F.col("vec_id") % every == 0).distinct()
    n_blocks = max(1, -(-rows.count() // block))
    n_queries = max(1, -(-queries.count() // query_block))
    dealt = F.xxhash64(F.monotonically_increasing_id())
    left = (queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", "w"), F.lit(n_queries)))
            .withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))))
    right = (rows.withColumn("cb", F.pmod(dealt, F.lit(n_blocks)))
             .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long")))))

    def blocks(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(q) or not len(r):
            return none
        return pd.concat([none, *best_of(q, r, k)])

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(
        blocks, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
