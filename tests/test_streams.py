import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators.attempts import ACTIONS, next_state
from keelson.operators.attempts import lifecycle as lifecycle_job
from keelson.sources import batchlog, filed
from keelson.streaming import counter, intake, lifecycle
from tests.test_tables import BROKERS, document


SOURCE = "ordinal long, value string"
BATCHES = [[(1, document("A", "Ann", email="a@x.co")), (2, document("B", office="")), (3, document("A", "Cy"))],
           [(4, document("A", "Cy")), (5, document("B", "Cy", {"display": "N"}, "b@x.co")), (6, "{cut")]]


def write_files(folder, batches, first=0):
    """One file a batch; the file source takes files in order of their modification time."""
    folder.mkdir(exist_ok=True)
    for i, batch in enumerate(batches, first):
        file = folder / f"{i}.json"
        file.write_text("\n".join(json.dumps(r) for r in batch))
        os.utime(file, (time.time() - 10_000 + 50 * i,) * 2)


def lead_files(folder, batches, first=0):
    write_files(folder, [[{"ordinal": o, "value": v} for o, v in batch] for batch in batches], first)


def lead_writer(spark, rows, tmp_path, **options):
    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    brokers = rows(BROKERS, "id string, broker_name string, email string")
    aliases = rows([("none", "none@one.example")], "alias_key string, email string")
    now = F.lit("2026-01-01").cast("timestamp")
    return intake.intake_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp"), brokers, aliases, now, **options)


def finish(writer):
    assert writer.trigger(availableNow=True).start().awaitTermination(240) is True


def stored(spark, tmp_path, log, *columns):
    found = batchlog.read(spark, str(tmp_path / "store" / log))
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)


def test_intake_in_batches_equals_one_batch(rows, spark, tmp_path):
    """Two files, one per micro-batch, with repeated ids inside and across them."""
    lead_files(tmp_path / "in", BATCHES)
    finish(lead_writer(spark, rows, tmp_path))
    assert stored(spark, tmp_path, "leads", "source_lead_id", "broker_id", "ordinal") == [("A", "1", 1), ("B", "4", 5)]
    assert stored(spark, tmp_path, "attempts", "lead_id", "status") == [("A", "pending"), ("B", "pending")]
    assert stored(spark, tmp_path, "rejected", "ordinal") == [(2,), (6,)]
    assert stored(spark, tmp_path, "duplicates", "source_lead_id", "copies") == [("A", 1), ("A", 1)]


def test_intake_goes_on_after_a_stop_and_after_a_failure(rows, spark, tmp_path, monkeypatch):
    lead_files(tmp_path / "in", BATCHES[:1])
    finish(lead_writer(spark, rows, tmp_path))
    assert stored(spark, tmp_path, "leads", "source_lead_id") == [("A",)]
    # the next batch fails after its leads were stored
    lead_files(tmp_path / "in", [*BATCHES[1:], [(7, document("C", "Cy")), (8, document("B", "Cy"))]], 1)
    append = batchlog.append

    def failing(df, path, *rest):
        if path.endswith("attempts"):
            raise RuntimeError("lost")
        append(df, path, *rest)

    monkeypatch.setattr(batchlog, "append", failing)
    with pytest.raises(Exception, match="lost"):
        finish(lead_writer(spark, rows, tmp_path))
    assert stored(spark, tmp_path, "leads", "source_lead_id") == [("A",), ("B",)]
    monkeypatch.setattr(batchlog, "append", append)
    finish(lead_writer(spark, rows, tmp_path))
    assert stored(spark, tmp_path, "leads", "source_lead_id") == [("A",), ("B",), ("C",)]
    assert stored(spark, tmp_path, "attempts", "lead_id") == [("A",), ("B",), ("C",)]
    assert stored(spark, tmp_path, "duplicates", "source_lead_id", "copies") == [("A", 1), ("A", 1), ("B", 1)]


def test_an_id_that_holds_most_documents_sends_few_rows_to_its_task(spark):
    docs = spark.range(0, 20_000, 1, 2).selectExpr("id AS ordinal", """concat('{"lead": {"id": "', CASE WHEN id % 10 > 0 THEN 'hot' ELSE CAST(id AS STRING) END,
        '", "source": "s"}, "contact": {"name": {"display": "N"}}, "recipient": {"officeName": "o", "officeId": "1"}}') AS value""")
    rows = intake.first_copies(intake.checked_documents(docs)).collect()
    hot = [r for r in rows if r["key"] == "hot"]
    assert len(hot) <= 4 and sum(r["copies"] for r in hot) == 18_000 and min(r["ordinal"] for r in hot) == 1
    assert len(rows) == 2_000 + len(hot) and not any(r["rejected"] for r in rows)


def test_small_arrow_batches_send_no_more_rows_of_a_hot_id(spark):
    docs = spark.range(0, 6_000, 1, 2).selectExpr("id AS ordinal", """concat('{"lead": {"id": "', CASE WHEN id % 10 > 0 THEN 'hot' ELSE CAST(id AS STRING) END,
        '", "source": "s"}, "contact": {"name": {"display": "N"}}, "recipient": {"officeName": "o", "officeId": "1"}}') AS value""")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    spark.conf.set(size, "100")
    try:
        rows = intake.first_copies(intake.checked_documents(docs)).collect()
    finally:
        spark.conf.set(size, was)
    hot = [r for r in rows if r["key"] == "hot"]
    assert len(hot) == 2 and sum(r["copies"] for r in hot) == 5_400 and min(r["ordinal"] for r in hot) == 1
    assert len(rows) == 600 + len(hot)


def test_counter_keeps_one_row_an_owner_and_few_files(rows, spark, tmp_path):
    path = str(tmp_path / "counts")
    for i in range(12):
        batch = rows([(None, i, i), ("a", i, 2 * i)] + [(f"o{i}", 1, 1)], "broker_id string, new_leads long, total_leads long")
        counter.store_counts(batch, i, path, buckets=4)
        if i == 5:
            counter.store_counts(rows([("a", 99, 99)], "broker_id string, new_leads long, total_leads long"), i, path, buckets=4)
    got = sorted(map(tuple, counter.current(spark, path).collect()), key=str)
    assert got == sorted([(None, 11, 11), ("a", 11, 22)] + [(f"o{i}", 1, 1) for i in range(12)], key=str)
    folders = [f for g in os.listdir(path) if g.startswith("gen=") for f in os.listdir(f"{path}/{g}") if f.startswith("_bucket")]
    assert len(folders) <= 8


def test_recovery_by_event_time_does_not_depend_on_batches(spark, tmp_path):
    r, minute = random.Random(3), 60_000
    events, at = [], 0
    for i in range(400):
        at += r.choice((1, 2, 5, 40)) * minute
        events.append((f"k{r.randrange(120)}", i, r.choice((*ACTIONS, "claim", "claim", "claim", "noop", "noop")), at))
    want = {}
    for key in {e[0] for e in events}:
        state, last, n = ("pending", 0), None, 0
        for _, _, action, t in [e for e in events if e[0] == key]:
            if last is not None and state[0] == "running" and t - last > 90 * minute:
                state = next_state(state, "fail", 3)
            state, last, n = next_state(state, action, 3), t, n + 1
        if state[0] == "running" and last + 90 * minute < at:
            state = next_state(state, "fail", 3)
        want[key] = (n, *state)
    assert {"pending", "running"} <= {w[1] for w in want.values()}
    for files in (1, 5):
        base = tmp_path / str(files)
        base.mkdir()
        lines = [{"id": k, "ordinal": o, "action": a, "ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(t / 1000))} for k, o, a, t in events]
        size = len(lines) // files
        write_files(base / "in", [lines[i * size: (i + 1) * size] for i in range(files)])
        stream = spark.readStream.schema("id string, ordinal long, action string, ts timestamp").option(
            "maxFilesPerTrigger", 1).json(str(base / "in"))

        def run(batch, batch_id):
            batchlog.append(batch.withColumn("batch", F.lit(batch_id)), str(base / "out"), batch_id)

        finish(lifecycle.recovery_stream(stream, 90).writeStream.outputMode("update").foreachBatch(run).option(
            "checkpointLocation", str(base / "cp")))
        changes = batchlog.read(spark, str(base / "out"))
        last = changes.groupBy("id").agg(F.max_by(F.struct("events", "status", "retry_count"), "batch").alias("s")).collect()
        assert {x["id"]: tuple(x["s"]) for x in last} == want


def test_a_silent_attempt_is_recovered_by_its_timer(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "0.json").write_text('{"id": "A", "ordinal": 1, "action": "claim"}\n{"id": "B", "ordinal": 1, "action": "complete"}')
    events = spark.readStream.schema("id string, ordinal long, action string").json(str(source))
    states = lifecycle.lifecycle_stream(events, stale_minutes=0.02)
    query = states.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: batchlog.append(batch.withColumn("batch_id", F.lit(batch_id)), out, batch_id)).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            found = batchlog.read(spark, out)
            seen = [(r.status, r.retry_count) for r in found.filter("id = 'A'").orderBy("batch_id").collect()] if found else []
            if len(seen) > 1:
                break
    finally:
        query.stop()
    assert seen[0] == ("running", 1) and seen[-1] == ("pending", 1)


def test_batches_folded_into_the_table_of_states(spark, tmp_path):
    """Many batches, some repeated, an id that is null, and one attempt with most events."""
    r = random.Random(6)
    events = [(r.choice(["hot"] * 6 + [None, "a", "b"]) if i % 3 else f"k{r.randrange(30)}", i,
               r.choice((*ACTIONS, "claim", "claim", "claim", "fail", "noop"))) for i in range(600)]
    want = {}
    for key, _, action in events:
        n, *state = want.get(key, (0, "pending", 0))
        want[key] = (n + 1, *next_state(tuple(state), action, 3))
    path = str(tmp_path / "states")
    for b in range(6):
        batch = spark.createDataFrame(events[b * 100: (b + 1) * 100], "id string, ordinal long, action string")
        for _ in range(1 + b % 2):
            lifecycle.store_events(batch, b, path, buckets=4)
    got = {x["id"]: tuple(x)[1:] for x in filed.read(spark, path).collect()}
    assert got == want and filed.read(spark, path).count() == len(want)


def test_long_event_sequences_fold_to_the_same_state():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 1000):
        actions = [r.choice(ACTIONS) for _ in range(n)]
        state = ("pending", 0)
        for a in actions:
            state = next_state(state, a, 3)
        codes = np.array([lifecycle.CODES[a] for a in actions], np.int8)
        assert lifecycle.Lifecycle(3).after(("pending", 0), codes) == state


def test_sparse_ordinals_are_folded_in_levels(spark):
    events = spark.range(100_000).selectExpr(
        "'A' AS id", "id * 1000003 - 7000000000 AS ordinal", "element_at(array('claim', 'fail', 'noop'), CAST(id % 3 + 1 AS INT)) AS action")
    row = lifecycle_job(events, "id", "ordinal", "action").first()
    state = ("pending", 0)
    for i in range(100_000):
        state = next_state(state, ("claim", "fail", "noop")[i % 3], 3)
    assert (row.events, row.status, row.retry_count) == (100_000, *state)
