"""Token counts: greedy word pieces by a linear longest-match automaton.

The vocabulary is a trie.  Matching reads a word once, byte by byte.  Where the trie has no way on,
the longest piece of what was read is popped and a failure link leads to the node of what is left of
it; both are worked out when the automaton is built: every node holds its failure link and the
number of pieces popped on the way.  A word's count is the sum of pops, so no piece is ever built and
the time is linear in the word, however long it is.

Counts of words are remembered per task up to ``REMEMBERED`` words.  No shuffle; the automaton is
what the vocabulary file determines, so its size does not depend on the input.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.arrow_text import arrow_batches, schema_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
REMEMBERED = 200_000


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file (base64 of the bytes, then a number, on every line)."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie with failure links; ``pops[node]`` pieces are emitted when its link is taken.

    Every piece but single bytes may be missing: a byte that is no piece counts as a piece by itself.
    """

    def __init__(self, pieces: Iterable[bytes]):
        known = {p for p in pieces if p} | {bytes([b]) for b in range(256)}
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in sorted(known):
            node = 0
            for byte in piece:
                child = self.next[node].get(byte)
                if child is None:
                    child = len(self.next)
                    self.next[node][byte] = child
                    self.next.append({})
                    ends.append(False)
                node = child
            ends[node] = True
        self.fail, self.pops = [0] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:  # by depth, as links lead to smaller depths
            below = []
            for parent in level:
                for byte, node in self.next[parent].items():
                    below.append(node)
                    if ends[node]:  # the node's own string is the longest piece
                        self.pops[node] = 1
                        continue
                    link, popped = self.fail[parent], self.pops[parent]
                    while byte not in self.next[link]:
                        popped += self.pops[link]
                        link = self.fail[link]
                    self.fail[node], self.pops[node] = self.next[link][byte], popped
            level = below

    def count(self, word: bytes) -> int:
        """Number of pieces of greedy longest matching."""
        node, total, following, fail, pops = 0, 0, self.next, self.fail, self.pops
        for byte in word:
            while byte not in following[node]:
                total += pops[node]
                node = fail[node]
            node = following[node][byte]
        while node:
            total += pops[node]
            node = fail[node]
        return total


def count_tokens(docs: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY,
                 words_begin: bytes = b" ") -> DataFrame:
    """``keys``, n_words and n_tokens of every whole text.

    A word is a run of other characters than ASCII white space; its pieces are matched over
    ``words_begin`` and its UTF-8 bytes, since in the vocabulary the pieces that begin a word begin
    with a blank.  Null and empty texts have no words and no tokens; repeated rows are counted one by
    one; other columns are not read; an empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary(path)))
    rows = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"))
    names = [f.name for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = automaton.value.count, {}
        for batch in batches:
            n_words, n_tokens = [], []
            for value in batch.column("_text"):
                words = (value.as_py() or "").encode().split()
                total = 0
                for word in words:
                    n = seen.get(word)
                    if n is None:
                        n = count(words_begin + word)
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        if len(word) <= 64:
                            seen[word] = n
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=[*names, "n_words", "n_tokens"])

    return rows.mapInArrow(run, schema_of(rows.schema.fields[:-1], "n_words long, n_tokens long")).select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], "n_words", "n_tokens")
