"""Continuous lead intake: validate, de-duplicate, route, store and enqueue, exactly once.

The lead ids seen so far are keyed state (RocksDB), so a batch costs what it holds, however large the
store is.  The store is three logs that fold their batches (``sources.batchlog``): files stay few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators import attempts as A
from ..operators import leads as L
from ..operators.validation import lead_document_rules, with_errors
from ..sources import batchlog

CREATED, DUPLICATE, REJECTED = "created", "duplicate", "rejected"
PASSING = 256
#: Rows, or bytes, of Arrow batches in which the copies of a lead are sought together.
GATHERED_ROWS, GATHERED_BYTES = 10_000, 16 << 20


def checked_documents(documents: DataFrame) -> DataFrame:
    """Documents of (ordinal, value) with their lead id as key and the failed rules; unusable ones, which need no
    state, share ``PASSING`` keys.  Texts travel as they came: only those that make a lead are taken apart."""
    checked = with_errors(L.parse_documents(documents), lead_document_rules())
    bad = F.size("errors") > 0
    passing = F.pmod(F.xxhash64("ordinal"), F.lit(PASSING)).cast("string")
    return checked.select(bad.alias("rejected"), F.when(bad, passing).otherwise(F.col("doc.lead.id")).alias("key"),
                          "ordinal", F.array_join("errors", "|").alias("errors"), "value", F.lit(1).cast("long").alias("copies"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together, so that their size does not hang on the session's, which other jobs may have lowered."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= GATHERED_ROWS or size >= GATHERED_BYTES:
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def first_copies(rows: DataFrame) -> DataFrame:
    """Of the copies of a lead inside gathered Arrow batches the first, with their number: an id that holds a third
    of all documents sends one row for ``GATHERED_ROWS`` or ``GATHERED_BYTES`` to its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            order = pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in ("rejected", "key", "ordinal")])
            mine = batch.select(["rejected", "key"]).take(order)
            flags, keys = mine.column("rejected").to_pylist(), mine.column("key").to_pylist()
            firsts = [i for i in range(len(keys)) if i == 0 or flags[i] or keys[i] != keys[i - 1] or flags[i - 1]]
            copies = [b - a for a, b in zip(firsts, [*firsts[1:], len(keys)])]
            kept = batch.take(order.take(pa.array(firsts)))
            yield kept.set_column(kept.schema.get_field_index("copies"), "copies", pa.array(copies, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


class FirstUsable(StatefulProcessor):
    """State per lead id: the ordinal of the document that made the lead.  The first usable document of an
    id becomes a lead, later ones are reported with the lead's id; unusable ones pass and leave no state.
    Without ``keep_hours`` an id is remembered for ever."""

    def __init__(self, keep_hours: float | None = None):
        self.keep_ms = None if keep_hours is None else int(keep_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ordinal long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0]:
            for row in rows:
                yield Row(**row.asDict(), outcome=REJECTED)
            return
        first, copies = None, 0
        for row in rows:
            copies += row["copies"]
            if first is None or row["ordinal"] < first["ordinal"]:
                first = row
        known = self.seen.exists()
        if not known:
            self.seen.update((first["ordinal"],))
        yield Row(**(first.asDict() | {"copies": copies, "value": None if known else first["value"],
                                       "outcome": DUPLICATE if known else CREATED}))

    def close(self) -> None:
        pass


def outcomes(documents: DataFrame, keep_hours: float | None = None) -> DataFrame:
    """Stream of (ordinal, value) to (rejected, key, ordinal, errors, value, copies, outcome): one row for every
    unusable document, and one a batch for every lead id in it."""
    rows = first_copies(checked_documents(documents))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]).add("outcome", "string")
    return rows.groupBy("rejected", "key").transformWithState(
        statefulProcessor=FirstUsable(keep_hours), outputStructType=schema, outputMode="Append",
        timeMode="None" if keep_hours is None else "ProcessingTime")


def store_batch(batch: DataFrame, batch_id: int, store: str, brokers: DataFrame, aliases: DataFrame,
                now: Column, domains: tuple[str, str] | None = None, fold_at: int = batchlog.FOLD_AT) -> None:
    """One micro-batch of outcomes: rejected documents, duplicates, new leads with owner, one attempt per new
    lead.  A log that has the batch already is left as it is, so a batch that failed half-way can be repeated."""
    # read by all four logs, so the state is asked once
    rows = batch.persist()
    try:
        batchlog.append(rows.filter(F.col("outcome") == REJECTED).select("ordinal", F.col("value").alias("raw_payload"), "errors"),
                        f"{store}/rejected", batch_id, fold_at)
        repeats = F.col("copies") - F.when(F.col("outcome") == CREATED, 1).otherwise(0)
        batchlog.append(rows.filter((F.col("outcome") != REJECTED) & (repeats > 0)).select(
            F.col("key").alias("source_lead_id"), repeats.alias("copies")), f"{store}/duplicates", batch_id, fold_at)
        documents = rows.filter(F.col("outcome") == CREATED).select("ordinal", "value")
        created = L.flatten_documents(L.parse_documents(documents), now, keep=("ordinal",))
        batchlog.append(L.route(created, brokers, aliases, now, domains), f"{store}/leads", batch_id, fold_at)
        batchlog.append(A.enqueue(created, now, key="source_lead_id"), f"{store}/attempts", batch_id, fold_at)
    finally:
        rows.unpersist()


def intake_stream(documents: DataFrame, store: str, checkpoint: str, brokers: DataFrame, aliases: DataFrame,
                  now: Column, domains: tuple[str, str] | None = None, keep_hours: float | None = None,
                  fold_at: int = batchlog.FOLD_AT) -> DataStreamWriter:
    """Writer for a stream of (ordinal, value); start it with a trigger.

    Repeated ids are settled after validation, so an unusable copy never displaces a usable one: by
    ordinal inside a batch, by arrival across batches.  The session needs RocksDB as its state store
    (``session.tune``)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, store, brokers, aliases, now, domains, fold_at)

    return outcomes(documents, keep_hours).writeStream.outputMode("append").foreachBatch(run).option(
        "checkpointLocation", checkpoint)
