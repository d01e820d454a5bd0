"""Language of a text by cross-parsing entropy.

For every language a suffix automaton of labelled text is built.  Cross-parsing reads a text from left
to right and cuts it into phrases, each the longest match found anywhere in the language's labelled text (a
byte that does not occur there is a phrase of its own).  A phrase costs the bits of a place in the
labelled text, so phrases times its logarithm over the length of the text is an entropy; the language
that needs fewest bits wins.

Texts are read as UTF-8 bytes, A-Z lower-cased, every run of other ASCII characters one blank, so any script is read.
They are parsed in blocks of ``BLOCK`` bytes, whose parses are independent: a batch of blocks goes
through all automata in step, one numpy operation for all of them.

Scale: one pass over the texts without a shuffle.  What travels is the automata, built from at most
``TOTAL`` bytes of labelled text over all languages and ``PER_LANGUAGE`` in each (some 80 bytes of table a byte,
so at most about 84 MB).  Labelled texts are chosen by hash over all rows: at most ``ROWS`` distinct texts a language, of
each a passage of ``PASSAGE`` characters that starts at a place drawn by the same hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.arrow_text import LOWER, arrow_batches, schema_of, text_chunks
from keelson.plans.ordering import top_k
from keelson.session import materialise

PER_LANGUAGE, TOTAL = 1 << 16, 1 << 20
ROWS, PASSAGE = 1024, 512
BLOCK = 512
#: A byte that no UTF-8 text holds, between passages: no match goes across.
BREAK = 0xFF
UNKNOWN = "und"
LETTER = r"\p{L}"

#: Letters and all bytes beyond ASCII stay; everything else is a blank.
FOLDED = LOWER.copy()
FOLDED[:128][~((LOWER[:128] >= 97) & (LOWER[:128] <= 122))] = 0x20


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with every run of blanks as one, and the new offsets."""
    low = FOLDED[data]
    blank = low == 0x20
    again = np.zeros(len(low), bool)
    again[1:] = blank[1:] & blank[:-1]
    starts = offsets[:-1]
    again[starts[starts < len(low)]] = False
    kept = ~again
    before = np.concatenate([[0], np.cumsum(kept)])
    return low[kept], before[offsets]


class Automaton:
    """Suffix automaton as flat tables.

    State ``s`` has the bytes it goes on with as a set of 256 bits in ``has[4 * s: 4 * s + 4]``; the
    targets of each of the four words stand together in ``targets`` from ``first`` on, by byte.  The root is state 0.
    """

    def __init__(self, text: bytes):
        go, link, length, last = [{}], [-1], [0], 0
        for c in text:
            new = len(go)
            go.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = new
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(go)
                    go.append(go[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        edges = np.array([(s, c, t) for s, d in enumerate(go) for c, t in d.items()], np.int64).reshape(-1, 3)
        edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
        word = edges[:, 0] * 4 + (edges[:, 1] >> 6)
        self.has = np.zeros(4 * len(go), np.uint64)
        np.bitwise_or.at(self.has, word, np.uint64(1) << (edges[:, 1] & 63).astype(np.uint64))
        self.first = np.searchsorted(word, np.arange(4 * len(go))).astype(np.int32)
        self.targets = edges[:, 2].astype(np.int32)


class Parser:
    """The automata of all languages in one set of tables; states of each follow those of the one before."""

    def __init__(self, parts: list[dict]):
        has, first, targets, roots, edges, states = [], [], [], [], 0, 0
        for p in parts:
            has.append(p["has"])
            first.append(p["first"].astype(np.int64) + edges)
            targets.append(p["targets"].astype(np.int64) + states)
            roots.append(states)
            edges += len(p["targets"])
            states += len(p["has"]) // 4
        self.has = np.concatenate(has)
        self.first = np.concatenate(first)
        self.targets = np.concatenate([*targets, [0]])  # a place to read where nothing is found
        self.roots = np.array(roots)

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the state goes on with the byte, the target if it does)."""
        word = state * 4 + (c >> 6)
        bits, bit = self.has[word], np.uint64(1) << (c & 63).astype(np.uint64)
        hit = (bits & bit) != 0
        return hit, self.targets[self.first[word] + np.bitwise_count(bits & (bit - np.uint64(1)))]

    def phrases(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Number of phrases of every text (rows) in every language (columns)."""
        lengths = np.diff(offsets)
        n_blocks = -(-lengths // block)
        text = np.repeat(np.arange(len(lengths)), n_blocks)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = offsets[text] + place * block
        size = np.minimum(block, offsets[text + 1] - start)
        order = np.argsort(-size, kind="stable")
        start, size, text = start[order], size[order], text[order]
        n = len(self.roots)
        # blocks by rows and languages by columns, longest block first: those still live are the first rows
        state = np.broadcast_to(self.roots, (len(start), n)).copy()
        counts = np.zeros((len(start), n), np.int64)
        live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
        for t, rows in enumerate(live):
            c = np.broadcast_to(data[start[:rows] + t].astype(np.int64)[:, None], (rows, n))
            now = state[:rows]
            hit, target = self.step(now, c)
            begins = ~hit | (now == self.roots)
            counts[:rows] += begins
            if not hit.all():
                # the byte that ends a phrase begins the next one, or is one of its own
                missed = ~hit
                root = np.broadcast_to(self.roots, (rows, n))[missed]
                known, fresh = self.step(root, c[missed])
                target[missed] = np.where(known, fresh, root)
            state[:rows] = target
        out = np.zeros((len(lengths), n), np.int64)
        np.add.at(out, text, counts)
        return out


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_passages(docs: DataFrame, rows: int = ROWS, passage: int = PASSAGE, per_language: int = PER_LANGUAGE,
                      total: int = TOTAL, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, n, passage): passages of the ``rows`` distinct texts of least hash in every language, as
    many as its share of ``total`` bytes holds.  Rows that are held out, or lack id, language or a
    letter, teach nothing; a text that repeats counts once in a language."""
    usable = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("lang")).filter(
        F.col("_id").isNotNull() & ~held_out(F.col("_id")) & F.col("lang").isNotNull() & F.col("_text").rlike(LETTER))
    marked = usable.withColumn("order", F.xxhash64("_text"))
    # narrow keys first: of a text that repeats one entry a task is left
    chosen = materialise(top_k(marked.select("lang", "order").distinct(), ["lang"], ["order"], rows).select("lang", "order"))
    share = min(per_language, total // max(1, chosen.select("lang").distinct().count()))
    start = F.pmod(F.xxhash64("order"), F.greatest(F.length("_text") - passage + 1, F.lit(1))) + 1
    taken = marked.join(chosen, ["lang", "order"]).select(
        "lang", "order", F.substring("_text", start.cast("int"), F.lit(passage)).alias("passage")).dropDuplicates(["lang", "order"])
    # at most `rows` rows a language
    before = Window.partitionBy("lang").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    return (taken.withColumn("_before", F.coalesce(F.sum(F.octet_length("passage") + 1).over(before), F.lit(0)))
            .filter(F.col("_before") < share)
            # the last one is cut, so that no language exceeds its share
            .select("lang", "order", F.substring("passage", F.lit(1), (F.lit(share) - F.col("_before")).cast("int")).alias("passage")))


def fit(passages: DataFrame) -> tuple[list[str], list[dict]]:
    """Languages by code point and their automata, each built by one task from its bounded passages."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for p in rows.sort_values("order")["passage"]:
            data = np.frombuffer(p.encode(), np.uint8)
            parts.append(folded(data, np.array([0, len(data)]))[0].tobytes())
        text = bytes([BREAK]).join(parts)
        a = Automaton(text)
        return pd.DataFrame({"lang": [key[0]], "n": [len(text)], "has": [a.has.tobytes()], "first": [a.first.tobytes()],
                             "targets": [a.targets.tobytes()]})

    built = passages.groupBy("lang").applyInPandas(build, "lang string, n long, has binary, first binary, targets binary")
    rows = sorted(built.toLocalIterator(), key=lambda r: r["lang"])
    return [r["lang"] for r in rows], [
        {"n": r["n"], "has": np.frombuffer(r["has"], np.uint64), "first": np.frombuffer(r["first"], np.int32),
         "targets": np.frombuffer(r["targets"], np.int32)} for r in rows]


def chances(bits: np.ndarray) -> np.ndarray:
    """Share of each language where a text of so many bits has the chance two to the minus bits."""
    p = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0))
    return p / p.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: tuple[list[str], list[dict]], keys: list[str], text: str = "text",
            block: int = BLOCK) -> DataFrame:
    """``keys``, lang_pred and score for every row: the language of fewest bits over the whole text, ties
    to the smaller name, and its chance against the others.

    A null text, one without a letter and any text when nothing was learned is ``und`` with score 0.
    Other columns are not read; rows that repeat get the same answer; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    names, automata = model
    rows = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"),
                       F.coalesce(F.col(text).rlike(LETTER), F.lit(False)).alias("_letter"))
    kept = [f.name for f in rows.schema.fields[:-2]]
    if not names:
        return rows.select(*[F.col(n).alias(k) for n, k in zip(kept, keys)], F.lit(UNKNOWN).alias("lang_pred"),
                           F.lit(0.0).alias("score"))
    tables = spark.sparkContext.broadcast(automata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(tables.value)
        cost = np.log2([a["n"] + 1 for a in tables.value])
        for batch in batches:
            bits = [np.zeros((0, len(names)))]
            for _, _, data, offsets in text_chunks(batch.column("_text")):
                bits.append(parser.phrases(*folded(data, offsets), block) * cost)
            bits = np.concatenate(bits)
            best, share = bits.argmin(axis=1), chances(bits)
            lettered = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            found = [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            score = np.where(lettered, share[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(found, pa.string()), pa.array(score)],
                                             names=[*kept, "_lang", "_score"])

    return rows.mapInArrow(run, schema_of(rows.schema.fields[:-2], "_lang string, _score double")).select(
        *[F.col(n).alias(k) for n, k in zip(kept, keys)], F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
