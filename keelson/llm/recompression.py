"""Removal of repeated passages by recompression.

Naming.  The words of a text are rewritten in rounds: a run of one symbol becomes a new symbol, then
every symbol of the left class that stands before one of the right class becomes one with it.  The
classes and the new names are fixed functions of the symbols, so every task names equal
runs and pairs alike without asking any other, and equal passages get equal symbols except near their
ends.  After ``ROUNDS`` rounds a symbol stands for a phrase of some 18 words.

Phrases.  The windows that start in a phrase are determined by the phrase and the 12 words after it.
That key (symbol and following words, verified by a second digest over all of it) is compared over the
corpus: where a smaller document has it, all its windows are repeats, and nothing below that symbol is
looked at again.  So text that is copied costs one row per phrase, however often it is copied.

Windows.  Repeats that are too short, or cut too differently, to share a phrase are decided window by
window (80 bits of digest).  Only windows that can be repeats are: each window has one of its sequences
of ``ANCHOR`` words, the one of least digest, as its anchor, so equal windows have equal anchors, and
anchors that no two documents share rule out all their windows.  About one word in five begins an anchor.

Scale.  Every task works through slabs of about ``SLAB`` words: repeats inside a slab are settled there
and what goes on are the occurrences in the smallest document of the slab (of an anchor, two occurrences).
So a phrase, anchor or window that a third of all documents share reaches its group a few times per
slab, not once per document.  Anchors and windows travel as packed arrays, dealt by the range of their
digest into buckets of about ``BUCKET`` entries; settled ones go round the buckets and pass through.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.arrow_text import SPACES, arrow_batches, mixed, schema_of, text_chunks, word_hashes, words
from keelson.session import fresh_path, materialise, remove

WINDOW = 13
ANCHOR = 5
ROUNDS = 10
SLAB = 1_000_000
BUCKET = 1_000_000
CHUNK = 50_000
NO_ID = 2**63 - 1

U = np.uint64
ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]


def phrases(names: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the last round and the word each begins with; ``first`` marks words that begin a text."""
    names, start, edge = names.copy(), np.arange(len(names)), first
    for r in range(rounds):
        if len(names) < 2:
            break
        same = (names[1:] == names[:-1]) & ~edge[1:]
        if same.any():
            lead = np.flatnonzero(np.concatenate([[True], ~same]))
            times = np.diff(np.append(lead, len(names)))
            runs = mixed(names[lead] * ODD[0] + times.astype(U) * ODD[1] + U(2 * r))
            names, start, edge = np.where(times > 1, runs, names[lead]), start[lead], edge[lead]
        right = (names * (ODD[2] + U(2 * r)) >> U(63)).astype(bool)
        at = np.flatnonzero(~right[:-1] & right[1:] & ~edge[1:])
        names[at] = mixed(names[at] * ODD[1] + names[at + 1] * ODD[2] + U(2 * r + 1))
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names, start, edge = names[keep], start[keep], edge[keep]
    return names, start


class Digests:
    """64-bit digests of any range of a sequence of word hashes."""

    powers: dict[int, np.ndarray] = {}

    def __init__(self, hashes: np.ndarray, odd: int):
        self.back = self.power(pow(odd, -1, 1 << 64), len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * self.power(odd, len(hashes)), dtype=U)])

    @classmethod
    def power(cls, base: int, n: int) -> np.ndarray:
        known = cls.powers.get(base)
        if known is None or len(known) < n:
            known = np.full(max(n, 1 << 17), base, U)
            known[0] = 1
            known = cls.powers[base] = np.multiply.accumulate(known)
        return known[:n]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def digested(hashes: np.ndarray) -> tuple[Digests, Digests]:
    return Digests(hashes, 0xD6E8FEB86659FD93), Digests(mixed(hashes + ODD[0]), 0xA0761D6478BD642F)


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk, and the number of the first word of each text with all words last."""
    starts, ends, firsts = words(~SPACES[data], offsets)
    return word_hashes(data, starts, ends), firsts


def smallest(keys: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """For every row whether a row of equal keys has a smaller id."""
    order = np.lexsort((ids, *reversed(keys)))
    edge = np.zeros(len(order), bool)
    edge[:1] = True
    for k in keys:
        edge[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(edge)
    least = np.repeat(ids[order][first], np.diff(np.append(first, len(order))))
    out = np.empty(len(order), bool)
    out[order] = ids[order] > least
    return out


def shared(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row whether its key has two ids, and whether it is the first or last of its key."""
    order = np.lexsort((ids, *reversed(keys)))
    edge = np.ones(len(order) + 1, bool)
    edge[1:-1] = False
    for k in keys:
        edge[1:-1] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(edge[:-1])
    size = np.diff(np.append(first, len(order)))
    two, end = np.empty(len(order), bool), np.empty(len(order), bool)
    two[order] = np.repeat(ids[order][first] != ids[order][first + size - 1], size)
    end[order] = edge[:-1] | edge[1:]
    return two, end


def anchors(digests: Digests, begins: np.ndarray, stop: np.ndarray, window: int, size: int) -> np.ndarray:
    """The word at which the anchor of the window that starts at each of ``begins`` begins."""
    at = np.arange(len(stop))
    values = np.full(len(stop), U(2**64 - 1))
    whole = at + size <= stop
    values[whole] = digests(at[whole], at[whole] + size)
    best, least = begins, values[begins]
    for d in range(1, window - size + 1):
        other = values[begins + d]
        less = other < least
        best, least = np.where(less, begins + d, best), np.where(less, other, least)
    return best


def packed(values: np.ndarray) -> bytes:
    """Differences of neighbours, which are small in document order, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values, prepend=values.dtype.type(0)).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind), dtype=kind)


PACKED = "bucket int, settled boolean, w binary, v binary, pid binary, pth binary, ps binary"
PACKED_NAMES = ("bucket", "settled", "w", "v", "pid", "pth", "ps")
PACKED_KINDS = (pa.int32(), pa.bool_(), *[pa.binary()] * 5)


def packs(digest: np.ndarray, w: np.ndarray, v: np.ndarray, ids: np.ndarray, ths: np.ndarray, s: np.ndarray,
          settled: np.ndarray, buckets: int) -> list[pa.Array]:
    """Entries of a slab: open ones as one row per bucket with their digest, ``settled`` ones without.

    Settled entries are compared with nothing, so they are dealt in chunks round the buckets, from one
    that the slab's first entry names: those of one digest do not meet."""
    group = ((digest >> U(32)) * U(buckets) >> U(32)).astype(np.int64) * 2
    done = np.flatnonzero(settled)
    if len(done):
        first = mixed(digest[done[:1]] ^ mixed(ids[done[:1]].view(U) ^ ths[done[:1]].view(U)))[0]
        group[done] = (int(first % U(buckets)) + np.arange(len(done)) // CHUNK) % buckets * 2 + 1
    order = np.argsort(group, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
    rows = []
    for a, b in zip(edges, edges[1:]):
        at = order[a:b]
        done = bool(group[at[0]] & 1)
        rows.append((int(group[at[0]] >> 1), done, b"" if done else w[at].tobytes(), b"" if done else v[at].tobytes(),
                     packed(ids[at]), packed(ths[at]), packed(s[at])))
    columns = list(zip(*rows)) or [()] * len(PACKED_NAMES)
    return [pa.array(c, k) for c, k in zip(columns, PACKED_KINDS)]


def first_rows(docs: DataFrame, window: int, slab: int, buckets: int) -> DataFrame:
    """Phrases and anchors in one reading.  Phrases: k1, k2 (key), id, th (document), s, n (first window
    and number of windows), ``repeat`` where the slab has the key in a smaller document.  Anchors: packed."""
    size = min(ANCHOR, window)
    plain = (("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("s", pa.int32()),
             ("n", pa.int32()), ("repeat", pa.bool_()))
    names = [n for n, _ in plain] + list(PACKED_NAMES)

    def settle(found: list[tuple[np.ndarray, ...]], anchored: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        k1, k2, ids, ths, s, n = (np.concatenate(p) for p in zip(*found))
        repeat = smallest([k1, k2], ids)
        columns = [pa.array(x, k) for x, (_, k) in zip(
            (k1.view(np.int64), k2.view(np.int64), ids, ths, s.astype(np.int32), n.astype(np.int32), repeat), plain)]
        yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(k1), k) for k in PACKED_KINDS], names=names)
        digest, ids, ths, s = (np.concatenate(p) for p in zip(*anchored))
        two, end = shared([digest], ids)
        # where two documents of the slab have it, all are settled and two go on to tell the others
        at = np.concatenate([np.flatnonzero(~two | end), np.flatnonzero(two)])
        done = np.arange(len(at)) >= len(at) - two.sum()
        w, v = (digest & U(0xFFFFFFFF)).astype(np.uint32), (digest >> U(32) & U(0xFFFF)).astype(np.uint16)
        columns = packs(digest[at], w[at], v[at], ids[at], ths[at], s[at], done, buckets)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), k) for _, k in plain] + columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, anchored, held = [], [], 0
        for batch in batches:
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            for first, last, data, offsets in text_chunks(batch.column("text")):
                h, firsts = hashed(data, offsets)
                if not len(h):
                    continue
                begins = np.zeros(len(h) + 1, bool)
                begins[firsts] = True
                names_, s = phrases(h, begins[:-1])
                row = np.searchsorted(firsts, s, "right") - 1
                end, stop = np.append(s[1:], len(h)), firsts[row + 1]
                reach = np.minimum(end + window - 1, stop)
                n = np.minimum(end, stop - window + 1) - s
                some = n > 0
                d1, d2 = digested(h)
                k1 = mixed(names_ * ODD[0] + d1(end, reach) * ODD[1] + (reach - s).astype(U))
                k2 = d2(s, reach) + (reach - s).astype(U)
                found.append(tuple(x[some] for x in (
                    k1, k2, ids[first:last][row], ths[first:last][row], s - firsts[row], n)))
                row = np.repeat(np.arange(last - first), np.diff(firsts))
                stop = firsts[row + 1]
                a = np.unique(anchors(d1, np.flatnonzero(np.arange(len(h)) + window <= stop), stop, window, size))
                row = row[a]
                anchored.append((d1(a, a + size), ids[first:last][row], ths[first:last][row], (a - firsts[row]).astype(np.int32)))
                held += len(h)
                if held >= slab:
                    yield from settle(found, anchored)
                    found, anchored, held = [], [], 0
        if found:
            yield from settle(found, anchored)

    return docs.mapInArrow(run, "k1 long, k2 long, id long, th long, s int, n int, repeat boolean, " + PACKED)


def marked(ranges: pa.Array, first: int, last: int, firsts: np.ndarray, longer: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a chunk lie in the (s, n + longer) ranges of their texts, and at which an anchor
    (a range of no windows) begins."""
    places = ranges.offsets.to_numpy()[first: last + 1]
    rows = np.repeat(firsts[:-1], np.diff(places))
    cut = slice(places[0], places[-1])
    s = ranges.values.field(0).to_numpy(zero_copy_only=False)[cut] + rows
    n = ranges.values.field(1).to_numpy(zero_copy_only=False)[cut]
    hot = np.zeros(firsts[-1], bool)
    hot[s[n == 0]] = True
    s, n = s[n > 0], n[n > 0] + longer
    cover = np.zeros(firsts[-1] + 1, np.int64)
    np.add.at(cover, s, 1)
    np.add.at(cover, s + n, -1)
    return np.cumsum(cover)[:-1] > 0, hot


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Documents with the ranges of (id, th) as an array; their number is bounded by the text."""
    per_text = ranges.groupBy("id", "th").agg(F.collect_list(F.struct("s", "n")).alias("ranges"))
    none = F.array().cast("array<struct<s:int,n:int>>")
    return docs.join(per_text.hint("shuffle_hash"), ["id", "th"], "left").withColumn("ranges", F.coalesce("ranges", none))


def window_rows(docs: DataFrame, window: int, slab: int, buckets: int) -> DataFrame:
    """Windows that start in no range of their text and have a shared anchor, packed by slab and bucket;
    ``settled`` entries are repeats of a smaller document of the slab."""
    size = min(ANCHOR, window)

    def settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        w, v, ids, ths, s = (np.concatenate(p) for p in zip(*parts))
        columns = packs(w, w, v, ids, ths, s, smallest([w, v], ids), buckets)
        yield pa.RecordBatch.from_arrays(columns, names=list(PACKED_NAMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "th"))
            for first, last, data, offsets in text_chunks(batch.column("text")):
                h, firsts = hashed(data, offsets)
                if not len(h):
                    continue
                row = np.repeat(np.arange(last - first), np.diff(firsts))
                known, hot = marked(batch.column("ranges"), first, last, firsts)
                stop = firsts[row + 1]
                at = np.flatnonzero(~known & (np.arange(len(h)) + window <= stop))
                d1, d2 = digested(h)
                at = at[hot[anchors(d1, at, stop, window, size)]]
                row = row[at]
                parts.append((d1(at, at + window), (d2(at, at + window) >> U(48)).astype(np.uint16),
                              ids[first:last][row], ths[first:last][row], (at - firsts[row]).astype(np.int32)))
                held += len(at)
                if held >= slab:
                    yield from settle(parts)
                    parts, held = [], 0
        if held:
            yield from settle(parts)

    return docs.mapInArrow(run, PACKED)


def decided(entries: DataFrame, buckets: int, kind: type, rule: Callable, n: int) -> DataFrame:
    """(id, th, s, n) of the settled entries and of those that ``rule`` picks among the others of a bucket."""
    names = ["id", "th", "s", "n"]

    def places(row: tuple) -> list[np.ndarray]:
        return [unpacked(row[4], np.int64), unpacked(row[5], np.int64), unpacked(row[6], np.int32)]

    def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, np.full(len(columns[0]), n, np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1]:
                    yield batch_of(places(row))
                else:
                    group.append(row)
        if group:
            columns = [np.concatenate(x) for x in zip(*map(places, group))]
            w = np.concatenate([np.frombuffer(g[2], kind) for g in group])
            v = np.concatenate([np.frombuffer(g[3], np.uint16) for g in group])
            chosen = rule([w, v], columns[0])
            yield batch_of([x[chosen] for x in columns])

    # one bucket to a task, where hashing the numbers would put several together
    return entries.repartitionById(buckets, "bucket").mapInArrow(run, "id long, th long, s int, n int")


def settled(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a step; the shuffle files of the steps before go when the driver forgets their plans."""
    out = materialise(df, path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def repeats(docs: DataFrame, window: int = WINDOW, slab: int = SLAB, bucket: int = BUCKET) -> DataFrame:
    """(id, th, s, n) for (id, th, text): every window that starts at a word s to s + n - 1 of the
    document occurs in a document with a smaller id."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(1, size // (32 * bucket)))  # about one anchor in 32 bytes
    spark, first = docs.sparkSession, fresh_path(docs.sparkSession)
    found = settled(first_rows(docs, window, slab, buckets), first)
    plain = found.filter("bucket is null")
    group = Window.partitionBy("k1", "k2")
    known = settled(
        plain.filter("not repeat").withColumn("least", F.min("id").over(group)).filter("id > least")
        .select("id", "th", "s", "n").unionByName(plain.filter("repeat").select("id", "th", "s", "n")))
    hot = settled(decided(found.filter("bucket is not null").select(*PACKED_NAMES), buckets, np.uint32,
                          lambda keys, ids: shared(keys, ids)[0], 0))
    remove(spark, first)
    buckets = max(1, 6 * hot.count() // bucket)
    entries = window_rows(with_ranges(docs, known.unionByName(hot)), window, slab, buckets)
    return known.unionByName(settled(decided(entries, buckets, U, smallest, 1)))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, id, th, text: ``id`` stands for a null id behind all others; ``th`` tells texts of one
    id apart, and is 0 for all if no id is repeated."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    repeated = not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    return rows.withColumn("th", F.xxhash64("text") if repeated else F.lit(0).cast("long"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """id, th, text, each once: rows that repeat have the same ranges, which are worked out for one of them.  Copies
    go on the map side; without a repeated id there are none, and nothing is shuffled."""
    texts = rows.select("id", "th", "text")
    return texts if texts.filter("th <> 0").isEmpty() else texts.groupBy("id", "th").agg(F.first("text").alias("text"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                    slab: int = SLAB, bucket: int = BUCKET, keep_text: bool = True) -> DataFrame:
    """doc id, n_words, n_removed, kept_sha256 and, with ``keep_text``, ``kept``: the words that no
    window covers which also starts in a document with a smaller id, joined by single blanks.

    Null and empty texts, and those of fewer words than a window, keep all words.  Rows with one id
    are not smaller than each other, so repeated rows keep what each keeps; a null id is larger than
    any other.  Other columns are not read; an empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    rows = keyed(docs, doc_id, text)
    ranges = repeats(distinct_texts(rows), window, slab, bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            texts = batch.column("text")
            for first, last, data, offsets in text_chunks(texts):
                _, _, firsts = words(~SPACES[data], offsets)
                covered, _ = marked(batch.column("ranges"), first, last, firsts, window - 1)
                for k in range(last - first):
                    own = covered[firsts[k]: firsts[k + 1]]
                    all_words = data[offsets[k]: offsets[k + 1]].tobytes().split()
                    if own.any():
                        all_words = [all_words[i] for i in np.flatnonzero(~own)]
                    n_words.append(len(own))
                    n_removed.append(len(own) - len(all_words))
                    kept.append(b" ".join(all_words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    out = with_ranges(rows, ranges).select("doc_id", "text", "ranges").mapInArrow(
        run, schema_of([rows.schema["doc_id"]], "n_words long, n_removed long, kept string"))
    return out.select(F.col("doc_id").alias(doc_id), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"),
                      *(["kept"] if keep_text else []))
