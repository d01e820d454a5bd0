"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and test items become strings of lower-cased words, each word between single spaces, so a
window of words is a byte pattern.  The search slides over a text by the last ``BLOCK`` bytes
under it: a table of block shifts tells how far no pattern can end, a shift of zero opens the
bucket of patterns that share the block (suffix hash), and comparing the bytes confirms.  Patterns
are searched in three classes by length, so short test items do not shorten the shifts of long ones.

The slide runs in numpy over many stretches of a chunk at once.  No shuffle: documents stay where
they are.  The patterns travel to the tasks; ``limit`` bounds their bytes, and larger benchmarks
are searched in several passes over the documents, each with a part of the items, so nothing
unbounded is broadcast and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.arrow_text import LOWER, arrow_batches, schema_of, text_chunks, words
from keelson.session import materialise

WINDOW = 13
BLOCK = 8
TABLE_BITS = 20
STRETCH = 512
#: Pattern classes by length in bytes: shorter ones slide in smaller steps.
CLASSES = (3, 8, 24)
LIMIT_BYTES = 16 << 20

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = True
IS_WORD[0x61:0x7B] = True
IS_WORD[0x80:] = True

SPREAD = np.uint64(0x9E3779B97F4A7C15)
PAD = 8


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`` w1 w2 .. wn `` and a line end for every text, after PAD bytes; where each word begins in
    it; the number of the first word of each text, with the number of all words last."""
    low = LOWER[data]
    starts, ends, firsts = words(IS_WORD[low], offsets)
    lengths = ends - starts
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    places = PAD + np.cumsum(lengths + 1) - lengths + 2 * text_of
    out = np.full(PAD + int(lengths.sum()) + len(lengths) + 2 * (len(offsets) - 1), 0x20, np.uint8)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[inside + np.repeat(places, lengths)] = low[inside + np.repeat(starts, lengths)]
    upto = np.concatenate([[0], np.cumsum(lengths + 1)])
    out[PAD + upto[firsts[1:]] + 2 * np.arange(1, len(offsets)) - 1] = 0x0A
    return out, places, firsts


def last_bytes(text: np.ndarray) -> np.ndarray:
    """View: element i holds the 8 bytes that begin at i."""
    return np.ndarray((len(text) - 7,), np.dtype("<u8"), text, strides=(1,))


class PatternClass:
    """Shift table, suffix buckets and bytes of patterns at least ``CLASSES`` long."""

    def __init__(self, patterns: list[tuple[bytes, list[int]]]):
        self.patterns = patterns
        self.m = min(len(p) for p, _ in patterns)
        self.block = min(BLOCK, self.m)
        head = np.frombuffer(b"".join(p[: self.m] for p, _ in patterns), np.uint8).reshape(-1, self.m)
        head = np.concatenate([np.zeros((len(patterns), PAD), np.uint8), head], axis=1)
        self.shifts = np.full(1 << TABLE_BITS, min(255, self.m - self.block + 1), np.uint8)
        for end in range(self.block, self.m + 1):  # the latest place of a block gives the smallest shift
            values = np.ascontiguousarray(head[:, end: end + PAD]).view("<u8").ravel()
            self.shifts[self.hashed(values)] = min(255, self.m - end)
            suffix = self.hashed(values)
        order = np.argsort(suffix, kind="stable")
        self.order, self.suffix = order, suffix[order]
        self.first = np.array([int.from_bytes(p[: self.block], "little") for p, _ in patterns], np.uint64)

    def hashed(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((values >> np.uint64(64 - 8 * self.block)) * SPREAD) >> np.uint64(64 - TABLE_BITS)

    def search(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(place, pattern number) of every occurrence."""
        ends_at = last_bytes(text)
        n = len(text)
        pos = np.arange(PAD + self.m - 1, n, STRETCH)
        stop = np.minimum(pos + STRETCH, n)
        found = []
        while len(pos):
            h = self.hashed(ends_at[pos - 7])
            step = self.shifts[h]
            at = np.flatnonzero(step == 0)
            if len(at):
                found.append((pos[at], h[at]))
            pos = pos + np.maximum(step, 1)
            going = pos < stop
            pos, stop = pos[going], stop[going]
        if not found:
            return []
        ends, h = (np.concatenate(x) for x in zip(*found))
        low, high = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
        many = high - low
        member = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        begins = np.repeat(ends - self.m + 1, many)
        number = self.order[member]
        same = (ends_at[np.minimum(begins, n - 8)] << np.uint64(64 - 8 * self.block)) >> np.uint64(64 - 8 * self.block)
        keep = (same == self.first[number]) | (begins > n - 8)
        whole = text.tobytes()
        return [(b, p) for b, p in zip(begins[keep].tolist(), number[keep].tolist())
                if whole.startswith(self.patterns[p][0], b)]


class Patterns:
    """The windows of all items: ``n`` consecutive words, or all words of a shorter item."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        owners: dict[bytes, set[int]] = {}
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            out, places, _ = spaced(data, np.array([0, len(data)]))
            whole, n = out.tobytes(), len(places)
            ends = [*(places[1:] - 1).tolist(), len(whole) - 2]
            for k in range(max(0, n - window) + 1 if n else 0):
                owners.setdefault(whole[places[k] - 1: ends[min(k + window, n) - 1] + 1], set()).add(number[item])
        self.windows = [(p, p.count(b" ") - 1, sorted(o)) for p, o in owners.items()]
        bounds = [*CLASSES, 1 << 62]
        self.classes = []
        for low, high in zip(bounds, bounds[1:]):
            own = [(p, [k]) for k, (p, _, _) in enumerate(self.windows) if low <= len(p) < high]
            if own:
                self.classes.append(PatternClass(own))

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
        """Words of each text, and for texts with occurrences their word spans and item ids."""
        text, places, firsts = spaced(data, offsets)
        out: dict[int, tuple[list, set]] = {}
        for c in self.classes:
            for place, pattern in c.search(text):
                _, n, owners = self.windows[c.patterns[pattern][1][0]]
                word = int(np.searchsorted(places, place + 1))
                row = int(np.searchsorted(firsts, word, "right")) - 1
                spans, items = out.setdefault(row, ([], set()))
                spans.append((word - int(firsts[row]), word - int(firsts[row]) + n))
                items.update(self.ids[o] for o in owners)
        return np.diff(firsts), out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def searched(docs: DataFrame, patterns: Patterns, keep_text: bool) -> DataFrame:
    """Add n_words, spans and items of one part of the benchmark to those of the parts before."""
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "spans", "items") and (keep_text or f.name != "text")]
    before = "spans" in docs.columns
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = [], [], []
            for first, last, data, offsets in text_chunks(batch.column("text")):
                n_words, found = patterns.hits(data, offsets)
                counts.append(n_words)
                for row in range(last - first):
                    s, i = found.get(row, ((), ()))
                    if before:
                        s = [*s, *((x["a"], x["b"]) for x in batch.column("spans")[first + row].as_py())]
                        i = {*i, *batch.column("items")[first + row].as_py()}
                    spans.append([{"a": a, "b": b} for a, b in merged(s)] if s else [])
                    items.append(sorted(i))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept]
                + [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(spans, span),
                   pa.array(items, pa.list_(pa.string()))],
                names=[f.name for f in kept] + ["n_words", "spans", "items"])

    return docs.mapInArrow(run, schema_of(kept, "n_words long, spans array<struct<a:long,b:long>>, items array<string>"))


def find_items(docs: DataFrame, benchmark: DataFrame, keys: list[str], doc_text: str = "text",
               item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
               limit: int = LIMIT_BYTES, text: bool = False) -> DataFrame:
    """``keys`` of every document, n_words, ``spans`` of hit words (disjoint, end exclusive) and the
    ids of the items found, as sorted text; with ``text`` also the text.

    Null and empty texts have no words and no hits; an item without words has no window; an item
    without id counts under the empty id; repeated items count once; repeated documents are judged
    row by row; other columns of either table are not read.
    """
    arrow_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                             F.col(item_text).alias("item_text")).filter(F.col("item_text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    passes = max(1, -(-size // limit))
    rows = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(doc_text).alias("text"))
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item", "item_text"), F.lit(passes)) == k)
        patterns = Patterns([(r["item"], r["item_text"]) for r in part.toLocalIterator()], window)
        last = k == passes - 1
        rows = searched(rows, patterns, keep_text=text or not last)
        if not last:
            rows = materialise(rows)
    return rows.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *(["text"] if text else []),
                       "n_words", "spans", "items")


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])


def contaminated(words_hit: Column, words_all: Column, one_in: int = 20) -> Column:
    """Any hit word, and at least one word in ``one_in``."""
    return (words_hit > 0) & (one_in * words_hit >= words_all)
