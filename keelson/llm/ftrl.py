"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed single words, pairs of neighbours and pairs with one or
two words between them, and single words cut to their first bytes, so that a stem counts under
endings that the sample does not hold.  FTRL-proximal keeps a gradient sum and a squared-gradient sum for every
coordinate, which gives each its own learning rate, and L1 keeps most weights at exactly zero: the
model that travels to the scoring tasks is the list of non-zero weights, at most ``2 ** BITS``.

Scale: the model is fitted by one task on a sample of at most about ``sample`` labelled texts (a
parameter; drawn by a hash of id and text at a rate from their number, so it does not grow with the input); their
hashes are what is broadcast to pick the training texts.  Scoring reads every text once, whole, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.arrow_text import LOWER, arrow_batches, mixed, schema_of, text_chunks, word_hashes, words

BITS = 20
SAMPLE = 20_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.01
#: Words between the two words of a pair.
GAPS = (0, 1, 2)
#: Longer words also count as stems of so many bytes.
STEMS = (4, 5, 6)

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = True
IS_WORD[0x61:0x7B] = True
IS_WORD[0x80:] = True


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every feature occurrence, bucket 0 being left to the bias."""
    low = LOWER[data]
    starts, ends, firsts = words(IS_WORD[low], offsets)
    h = word_hashes(low, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    rows, found = [text], [h]
    for n in STEMS:
        long = ends - starts > n
        rows.append(text[long])
        found.append(word_hashes(low, starts[long], starts[long] + n, seed=n))
    with np.errstate(over="ignore"):
        for gap in GAPS:
            left, right = h[: -1 - gap], h[1 + gap:]
            same = text[: -1 - gap] == text[1 + gap:]
            rows.append(text[: -1 - gap][same])
            found.append(mixed(left * np.uint64(3 + 2 * gap) + right * np.uint64(0x9E3779B97F4A7C15))[same])
    top = np.uint64((1 << BITS) - 1)
    return np.concatenate(rows), (np.concatenate(found) % top + np.uint64(1)).astype(np.int64)


class Ftrl:
    """State of the learner: z and n of every coordinate."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(labelled: DataFrame, epochs: int = EPOCHS) -> dict[int, float]:
    """Non-zero weights by bucket from (order long, label int, text), a bounded sample."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(), []
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for first, _, data, offsets in text_chunks(batch.column("text")):
                text, bucket = buckets(data, offsets)
                keys = np.unique((text << BITS) | bucket)
                cuts = np.searchsorted(keys >> BITS, np.arange(len(offsets)))
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    seen.append((np.append(keys[a:b] & ((1 << BITS) - 1), 0).astype(np.int32), labels[first + k]))
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(seen)):
                model.learn(*seen[k])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at], pa.float64())], names=["bucket", "weight"])

    one = labelled.repartition(1).sortWithinPartitions("order", "label", "text")
    return {r["bucket"]: r["weight"] for r in one.mapInArrow(train, "bucket int, weight double").toLocalIterator()}


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id",
                  text: str = "text", label: str = "toxic") -> DataFrame:
    """(order, label, text) of at most about ``sample`` labelled texts that are not held out.  Of
    several labels of one id the largest counts; a text that repeats under its id is one text; rows without id,
    label or text teach nothing, and empty tables give none."""
    usable = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label"))
              .filter(F.col("_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("_id")))
              .groupBy("_id").agg(F.max("label").alias("label")))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).filter(
        F.col("text").isNotNull() & F.col("_id").isNotNull()).withColumn(
        "order", F.xxhash64(F.col("_id").cast("string"), "text", F.lit("sample")))
    # narrow and distinct before they meet: an id that holds many rows sends each of its texts once a task
    texts = rows.select("_id", "order").distinct().join(usable, "_id")
    rate = min(1.0, sample / max(1, texts.count()))
    # bounded by the parameter, not by the input
    chosen = texts.filter(F.pmod("order", F.lit(1 << 30)) < int(rate * (1 << 30))).select("order", "label")
    return rows.select("order", "text").join(F.broadcast(chosen), "order").dropDuplicates(["order"]).select(
        "order", "label", "text")


def score(docs: DataFrame, weights: dict[int, float], keys: list[str], text: str = "text",
          name: str = "score") -> DataFrame:
    """``keys`` and the probability of label 1 of every whole text; a text without words has the
    score of the bias alone, and so has null."""
    arrow_batches(docs.sparkSession)
    at = np.fromiter(weights.keys(), np.int64, len(weights))
    values = np.fromiter(weights.values(), np.float64, len(weights))
    rows = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"))
    names = [f.name for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[at] = values
        for batch in batches:
            sums = [np.zeros(0)]
            for first, last, data, offsets in text_chunks(batch.column("_text")):
                row, bucket = buckets(data, offsets)
                live = dense[bucket] != 0
                found = np.unique((row[live] << BITS) | bucket[live])
                sums.append(np.bincount(found >> BITS, dense[found & ((1 << BITS) - 1)], last - first) + dense[0])
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(sums), -35, 35)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(p)], names=[*names, "_score"])

    return rows.mapInArrow(run, schema_of(rows.schema.fields[:-1], "_score double")).select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("_score").alias(name))
