"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into lines, and its prefix, middle and suffix into pieces of whole lines of about
``PIECE`` bytes (a longer line is a piece of its own).  Pieces are keyed by document and by their
place in the output, so ``repartitionAndSortWithinPartitions`` brings them to one task in output
order: the task streams them through an incremental digest and never holds an output.  Output pieces
are then told apart again by the marks in that stream alone, given their place in the original text and
sorted once more, which restores the text into a second digest.  Both sorts use the same
partitioner, so texts are shuffled once.

Scale: texts are dealt to tasks of about ``TASK_BYTES``, which sort in Python, spilling beyond
``spark.python.worker.memory``.  The key of a document is a digest of its id, its text and the number of the task
that read it: rows that repeat spread over as many keys as there are reading tasks, and inside a task their
text travels once (``RECENT`` texts back) with one head for every copy.  Lost executors are made up for by
the lineage, keys being the same then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16
TASK_BYTES = 64 << 20
RECENT = 10_000
#: How often a text is changed, and how often a changed one has its suffix first, of 100.
RATE, SUFFIX_FIRST = 100, 50

# fixed values: the marks and the order of the segments in each form
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"plain": (), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
RESTORED = ("prefix", "middle", "suffix")

#: Place of a document's heads before its pieces.
HEAD = -1


def unit_ends(data: bytes) -> np.ndarray:
    """Byte offsets where the lines of a text end; the last line may lack its newline."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A) + 1
    if data and not data.endswith(b"\n"):
        ends = np.append(ends, len(data))
    return ends


def n_chars(data: bytes) -> int:
    """Code points of UTF-8 bytes: all bytes that do not continue a character."""
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that the seed and the id (null: nothing) decide."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]


def plan(data: bytes, doc_id: int | None, seed: int, rate: int, suffix_first: int) -> tuple[str, int, tuple[int, int], np.ndarray]:
    """Form, number of lines, byte offsets of both cuts and the ends of the lines."""
    ends = unit_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or any(m in data for m in MARKS.values()) or h3 % 100 >= rate:
        return "plain", n, (0, 0), ends
    at = np.concatenate([[0], ends])
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < suffix_first else "psm", n, (int(at[cuts[0]]), int(at[cuts[1]])), ends


def pieces(data: bytes, ends: np.ndarray, first: int, last: int, size: int) -> Iterator[bytes]:
    """The bytes from ``first`` to ``last`` in runs of whole lines of about ``size`` bytes."""
    while first < last:
        k = int(np.searchsorted(ends, min(first + size, last), "right")) - 1
        stop = int(ends[k]) if k >= 0 and ends[k] > first else int(ends[np.searchsorted(ends, first, "right")])
        yield data[first:stop]
        first = stop


def output_pieces(data: bytes, form: str, cuts: tuple[int, int], ends: np.ndarray, size: int) -> Iterator[bytes]:
    """The output in order, cut into pieces."""
    if form == "plain":
        yield from pieces(data, ends, 0, len(data), size)
    bounds = {"prefix": (0, cuts[0]), "middle": cuts, "suffix": (cuts[1], len(data))}
    for segment in ORDERS[form]:
        yield MARKS[segment]
        yield from pieces(data, ends, *bounds[segment], size)


def segments(stream: Iterable[bytes], form: str) -> Iterator[tuple[str, bytes]]:
    """(segment, bytes) of an output that arrives in pieces of any size: the marks of the form, in
    their order, are found in the stream, also across pieces.  At most two bytes are held back."""
    marks = [(s, MARKS[s]) for s in ORDERS[form]]
    segment, held = "prefix", b""
    for piece in stream:
        held += piece
        while marks:
            name, mark = marks[0]
            at = held.find(mark)
            if at < 0:
                break
            if at:
                yield segment, held[:at]
            segment, held = name, held[at + len(mark):]
            marks.pop(0)
        keep = min(len(held), len(marks[0][1]) - 1) if marks else 0
        if len(held) > keep:
            yield segment, held[: len(held) - keep]
            held = held[len(held) - keep:]
    if held:
        yield segment, held


def sorting_tasks(docs: DataFrame, text: str) -> int:
    """How many tasks hold the texts, from their bytes: compressed sizes of files say little about them."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0
    return -(-total // TASK_BYTES)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
                   keep_text: bool = True, piece: int = PIECE, doc_id: str = "doc_id", text: str = "text",
                   partitions: int | None = None) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, and with
    ``keep_text`` output: one row for every row.

    A text is cut into ``n`` lines; the seed and the id draw two cuts between lines and the form: ``plain`` (the
    text; also for texts that are empty or hold a mark), ``psm`` or ``spm``.  The digests are those of
    the output and of the text rebuilt from output and form.

    Null texts read as empty.  A null id draws like an empty one.  Rows that repeat give as many equal rows;
    different texts under one id are cut by the same draws, each on its own lines.  Other columns are not
    read; an empty table gives an empty result.  A text must fit in memory, as any value must; a line
    longer than ``piece`` bytes travels whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).rdd
    n_parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), sorting_tasks(docs, text))

    def cut(task: int, part: Iterable) -> Iterator[tuple]:
        sent = set()
        for row_id, row_text in part:
            data = (row_text or "").encode()
            mark = f"{task}:{row_id}:".encode()
            key = hashlib.sha256(mark + hashlib.sha256(data).digest()).digest()
            form, n, cuts, ends = plan(data, row_id, seed, rate, suffix_first)
            sizes = (None, None) if form == "plain" else (n_chars(data[: cuts[0]]), n_chars(data[cuts[0]: cuts[1]]))
            yield (key, HEAD), (row_id, n, form, *sizes)
            if key in sent:
                continue
            if len(sent) == RECENT:
                sent.clear()
            sent.add(key)
            for place, chunk in enumerate(output_pieces(data, form, cuts, ends, piece)):
                yield (key, place), chunk

    def document(place: tuple) -> int:
        return int.from_bytes(place[0][:8], "big")

    def written(part: Iterable) -> Iterator[tuple]:
        """Digests of the outputs; pieces leave with their place in the original text."""
        for key, mine in groupby(part, lambda kv: kv[0][0]):
            head, stream = heads(mine)
            digest, whole = hashlib.sha256(), []

            def digested() -> Iterator[bytes]:
                for chunk in stream:
                    digest.update(chunk)
                    if keep_text:
                        whole.append(chunk)
                    yield chunk

            form = head[0][2]
            for place, (segment, chunk) in enumerate(segments(digested(), form)):
                yield (key, RESTORED.index(segment), place), chunk
            found = (digest.hexdigest(), b"".join(whole).decode() if keep_text else None)
            yield (key, HEAD, 0), (*head, *found)

    def restored(part: Iterable) -> Iterator[tuple]:
        for _, mine in groupby(part, lambda kv: kv[0][0]):
            _, (row, copies, sha, output) = next(mine)
            digest = hashlib.sha256()
            for _, chunk in mine:
                digest.update(chunk)
            line = (*row, sha, digest.hexdigest(), *((output,) if keep_text else ()))
            for _ in range(copies):
                yield line

    in_output_order = rows.mapPartitionsWithIndex(cut).repartitionAndSortWithinPartitions(n_parts, document)
    # the same partitioner: the second sort stays inside its task
    in_text_order = in_output_order.mapPartitions(written, True).repartitionAndSortWithinPartitions(n_parts, document)
    schema = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
              "restored_sha256 string") + (", output string" if keep_text else "")
    return spark.createDataFrame(in_text_order.mapPartitions(restored, True), schema, verifySchema=False)


def heads(mine: Iterator[tuple]) -> tuple[tuple, Iterator[bytes]]:
    """((row of the document, number of copies), its pieces once each) from its sorted entries."""
    row, copies, first = None, 0, []
    for (_, place), value in mine:
        if place != HEAD:
            first = [(place, value)]
            break
        row, copies = value, copies + 1

    def once() -> Iterator[bytes]:
        last = HEAD
        for place, value in first:
            last = place
            yield value
        for (_, place), value in mine:
            # a row that repeats far apart in its task sends its pieces again
            if place != last:
                last = place
                yield value

    return (row, copies), once()
