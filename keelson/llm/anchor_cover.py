"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks whose thresholds add up so that two fingerprints within the
threshold are within the block's threshold in at least one block (sum of thresholds plus one each
exceeds the whole threshold).  In a block, the words of a covering code are the anchors: a Hamming
code over 2^r - 1 bits and all values of the other bits, covering radius 1.  A fingerprint is at
home at the anchor nearest to it, and is replicated to every anchor that can be the home of a
fingerprint within the block's threshold; all of these are within radius plus threshold.  Of a
linked pair each visits the other's home, so comparing the fingerprints of every anchor finds all
links.

Scale: equal fingerprints are one node, however many documents have it.  With the default blocks a
node is replicated about 28 times whatever the input.  An anchor emits the links of a spanning
forest, never all pairs: comparisons leave out what is already reached, so a dense group costs little
more than its size.  An anchor with more than ``LIMIT`` visitors is cut into chunks, and every pair
of chunks is compared in a task of its own.  Larger corpora want fewer, longer blocks: ``(32, 5, 2),
(32, 5, 1)`` has 2^27 anchors at about 190 replicas.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.arrow_text import arrow_batches, schema_of
from keelson.llm.components import components
from keelson.session import materialise

SHINGLE = 4
SEED = 42
THRESHOLD = 4
#: (bits, parity bits of the Hamming code, threshold of the block), from the low bits up.
BLOCKS = ((21, 4, 1), (21, 4, 1), (22, 4, 0))
LIMIT = 20_000
SMALL = 64
SLAB = 1 << 20


def slabs(text: bytes) -> Iterator[bytes]:
    """A long text in pieces cut at white space."""
    at = 0
    while len(text) - at > SLAB:
        cut = at + SLAB
        while cut < len(text) and text[cut: cut + 1] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over XXH64 of the shingles, repeats included; 0 for a text without words."""
    ones, n, carried = np.zeros(64, np.int64), 0, []
    for slab in slabs((text or "").encode().lower()):
        words = carried + slab.split()
        if len(words) < shingle:
            carried = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())],
                          np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        carried = words[len(words) - shingle + 1:]
    if n == 0:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and fp (long, the 64 bits) of every row."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"))
    names = [f.name for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("_text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(found.view(np.int64))], names=[*names, "fp"])

    return rows.mapInArrow(run, schema_of(rows.schema.fields[:-1], "fp long")).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "fp")


def masks(bits: int, parity: int, threshold: int) -> tuple[list[int], list[list[int]]]:
    """By syndrome: what to flip to get home, and to get to every home within the threshold.

    Bit i of the coded part (i below 2^parity - 1) has the syndrome i + 1; the others have none."""
    coded = (1 << parity) - 1
    syndrome = [i + 1 if i < coded else 0 for i in range(bits)]
    home = [1 << (s - 1) if s else 0 for s in range(coded + 1)]
    visits = []
    for s in range(coded + 1):
        reached = set()
        for n in range(threshold + 1):
            for flips in combinations(range(bits), n):
                other, moved = s, 0
                for i in flips:
                    other, moved = other ^ syndrome[i], moved ^ (1 << i)
                reached.add(moved ^ home[other])
        visits.append(sorted(reached))
    return home, visits


def anchored(nodes: DataFrame, blocks: tuple = BLOCKS) -> DataFrame:
    """(block, anchor, fp, home): every fingerprint at all its anchors."""
    parts, low = [], 0
    for number, (bits, parity, threshold) in enumerate(blocks):
        home, visits = masks(bits, parity, threshold)
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
        # parity p checks the coded bits whose syndrome has bit p
        checks = [sum(1 << i for i in range((1 << parity) - 1) if (i + 1) >> p & 1) for p in range(parity)]
        syndrome = sum(((F.bit_count(value.bitwiseAND(F.lit(c))) % 2) * (1 << p) for p, c in enumerate(checks)), F.lit(0))
        rows = nodes.select("fp", value.alias("_value"), syndrome.cast("int").alias("_s"))
        go = F.get(F.array(*[F.array(*[F.lit(m).cast("long") for m in v]) for v in visits]), F.col("_s"))
        back = F.get(F.array(*[F.lit(m).cast("long") for m in home]), F.col("_s"))
        parts.append(rows.select("fp", "_value", back.alias("_home"), F.explode(go).alias("_go")).select(
            F.lit(number).alias("block"), F.col("_value").bitwiseXOR(F.col("_go")).alias("anchor"), "fp",
            (F.col("_go") == F.col("_home")).alias("home")))
        low += bits
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def tiled(visits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add ``tile``: 0, or for an anchor with more than ``limit`` visitors every pair of chunks a
    visitor's chunk is in."""
    crowded = (visits.groupBy("block", "anchor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
               .withColumn("_chunks", F.ceil(F.col("_n") / limit)).drop("_n"))
    own = F.pmod(F.xxhash64("fp"), F.col("_chunks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1),
                        lambda j: F.least(own, j) * F.col("_chunks") + F.greatest(own, j))
    tiles = F.when(F.col("_chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    return visits.join(crowded, ["block", "anchor"], "left").withColumn("tile", F.explode(tiles)).drop("_chunks")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links node - root with the same components as the links a - b."""
    if len(a) == 0:
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def spanning(fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one large anchor: each fingerprint reached is compared with the rest only."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = (np.bitwise_count(fp[left] ^ fp[u]) <= threshold) & (home[left] | home[u])
            found = left[near]
            a.append(np.full(len(found), fp[u]))
            b.append(fp[found])
            queue.extend(found.tolist())
            left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def anchor_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within anchors; ``key`` numbers the anchors and is ascending."""
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    size = np.diff(np.append(first, len(key)))
    a, b = [fp[:0]], [fp[:0]]
    for k in np.flatnonzero(size > SMALL):
        s = slice(first[k], first[k] + size[k])
        x, y = spanning(fp[s], home[s], threshold)
        a.append(x)
        b.append(y)
    ends = np.repeat(np.where(size > SMALL, 0, first + size), size)
    at = np.arange(len(key))
    for d in range(1, SMALL):
        at = at[at + d < ends[at]]
        if not len(at):
            break
        near = (home[at] | home[at + d]) & (np.bitwise_count(fp[at] ^ fp[at + d]) <= threshold)
        a.append(fp[at[near]])
        b.append(fp[at[near] + d])
    return forest(np.concatenate(a), np.concatenate(b))


def links(nodes: DataFrame, threshold: int = THRESHOLD, blocks: tuple = BLOCKS, limit: int = LIMIT) -> DataFrame:
    """(u, v): links with the same components as all pairs within the threshold."""
    assert sum(t + 1 for _, _, t in blocks) > threshold and sum(n for n, _, _ in blocks) == 64
    keys = ["block", "anchor", "tile"]
    dealt = tiled(materialise(anchored(nodes, blocks)), limit).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_a, found_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        held: list[np.ndarray] | None = None

        def take(part: list[np.ndarray]) -> None:
            edge = np.zeros(len(part[0]), bool)
            for k in part[:3]:
                edge[1:] |= k[1:] != k[:-1]
            x, y = anchor_links(np.cumsum(edge), part[3].view(np.uint64), part[4], threshold)
            found_a.append(x)
            found_b.append(y)

        for batch in batches:
            part = [batch.column(n).to_numpy(zero_copy_only=False) for n in (*keys, "fp", "home")]
            if held is not None:
                part = [np.concatenate(z) for z in zip(held, part)]
            if not len(part[0]):
                continue
            # the last anchor may go on in the next batch
            last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in part[:3]]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                take([z[:cut] for z in part])
            held = [z[cut:] for z in part]
        if held is not None and len(held[0]):
            take(held)
        a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD,
                    blocks: tuple = BLOCKS, limit: int = LIMIT) -> DataFrame:
    """doc id, fingerprint (16 hex digits) and component_id: the smallest id reachable over links.

    Texts without words, null ones too, have fingerprint zero and link like any other.  Repeated rows
    get equal results.  A row without id is linked but names no component; a component without any id
    has the id null.  Other columns are not read; an empty table gives an empty result.
    """
    marked = materialise(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]))
    named = grouped(marked, F.min("doc_id"), threshold, blocks, limit).select("fp", F.col("first").alias("component_id"))
    return marked.join(named, "fp").select(
        F.col("doc_id").alias(doc_id), written(F.col("fp")).alias("fingerprint"), "component_id")


def grouped(marked: DataFrame, first: Column, threshold: int = THRESHOLD, blocks: tuple = BLOCKS,
            limit: int = LIMIT) -> DataFrame:
    """fp, root and ``first`` of every fingerprint: the component, and the least value of the rows in it
    (``first`` is a minimum over rows of ``marked``)."""
    nodes = materialise(marked.groupBy("fp").agg(first.alias("_first")))
    roots = components(links(nodes.select("fp"), threshold, blocks, limit))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "_first", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("_first").alias("first")), "root").select("fp", "root", "first")


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``keys`` of one row of each component of (text, keys, columns of ``order``): the first by
    ``order``, then by the keys, which identify the row."""
    plain = rows.select(*keys, "text", *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    names = [*[f"_o{i}" for i in range(len(order))], *keys]
    marked = materialise(fingerprints(plain, names))
    kept = grouped(marked, F.min(F.struct(*names))).groupBy("root").agg(F.min("first").alias("first"))
    return kept.select(*[F.col(f"first.{k}").alias(k) for k in keys])


def written(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
