"""Whole texts of an Arrow column as byte arrays, their words and word hashes (numpy).

Operators that run in ``mapInArrow`` share these.  A batch is worked through in runs of whole
texts of about ``CHUNK`` bytes, so the working memory of a task follows the chunk (or the one
text that is longer), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHUNK = 1 << 19
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(fields: Iterable[T.StructField], more: str) -> T.StructType:
    """The given columns as they are, then those of a DDL text."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields]
                        + T.StructType.fromDDL(more).fields)


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python operators by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of whole texts; null reads as empty."""
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def words(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of ``is_word``, never across two texts), and the
    number of the first word of each text, with the number of all words last."""
    n = len(is_word)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[1:] = is_word[:-1]
    before[:1] = False
    starts = np.flatnonzero(is_word & (edge[:n] | ~before))
    after = np.empty(n, bool)
    after[:-1] = is_word[1:]
    after[-1:] = False
    ends = np.flatnonzero(is_word & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every word's bytes; equal words have equal hashes in every task."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    letters = data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    powers = _powers(int(lengths.max()), seed)
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat(letters * powers[place], first) + lengths.astype(np.uint64) * np.uint64(seed | 1))


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, seed: int) -> np.ndarray:
    known = _POWERS.get(seed)
    if known is None or len(known) < n:
        known = np.random.default_rng(seed).integers(1, 2**63, max(n, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _POWERS[seed] = known
    return known
