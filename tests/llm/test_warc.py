import base64
import gzip
import hashlib
import os

import pytest

from keelson.llm.archive import page_of, records, round_trip
from keelson.llm.warc import END, record


def expected(rows):
    out, body = [], lambda h: (h or "").encode()
    for page, _, html in rows:
        ids = [p for p, _, h in rows if body(h) == body(html) and p is not None]
        winner = max(ids, default=None)
        revisit = winner is not None and page != winner
        digest = base64.b32encode(hashlib.sha1(body(html)).digest()).decode()
        out.append((page, len(body(html)), digest, "revisit" if revisit else "response", winner if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "http://c/", ""),
        (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "n", "<p>é</p>"), (None, "n", "alone"), (6, "big", "z" * 300_000),
        (7, "big", "q%s" * 100_000), (7, "big", "q%s" * 100_000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x", b"y") for r in ROWS], "page_id long, url string, html string, record_type string, payload binary")


def written(df):
    return sorted(((r["page_id"], r["payload_length"], r["payload_digest"], r["record_type"], r["refers"]) for r in df.select(
        page_of("record_id").alias("page_id"), "payload_length", "payload_digest", "record_type",
        page_of("refers_to").alias("refers")).collect()), key=str)


def test_round_trip(spark, pages, tmp_path):
    df = round_trip(pages, str(tmp_path / "w"))
    assert written(df) == expected(ROWS)
    # other gzip readers can read the files
    files = [f for f in os.listdir(tmp_path / "w") if f.endswith(".warc.gz")]
    assert files and all(gzip.open(tmp_path / "w" / f).read().startswith(b"WARC/1.1") for f in files)


def test_payloads_and_pushed_predicates(spark, pages, tmp_path):
    round_trip(pages, str(tmp_path / "w"))
    df = spark.read.format("warc").load(str(tmp_path / "w"))
    got = {bytes(r["payload"]) for r in df.filter("record_type = 'response'").collect()}
    assert got == {(h or "").encode() for _, _, h in ROWS}
    some = df.filter("record_type in ('response') and target_uri like 'http://%'")
    assert sorted(r["target_uri"] for r in some.collect()) == ["http://b/%0D%0AX: y", "http://c/"]
    skipped = spark.read.format("warc").option("payload", "skip").load(str(tmp_path / "w"))
    assert skipped.filter("payload is not null").count() == 0 and skipped.count() == len(ROWS)


def test_plain_and_foreign_files(spark, tmp_path):
    data = [record("response", f"urn:x-page:{i}", "http://a/", None, b"p" * i * 5000) for i in range(4)]
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc" + END
    (tmp_path / "a.warc").write_bytes(info + b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in [info, *data]))
    (tmp_path / ".c.warc.gz").write_bytes(b"not finished")
    df = spark.read.format("warc").load(str(tmp_path))
    assert df.count() == 10 and df.filter("record_type = 'warcinfo'").count() == 2
    lengths = sorted(r["payload_length"] for r in df.filter("record_type = 'response'").collect())
    assert lengths == sorted([0, 5000, 10000, 15000] * 2)


def test_a_changed_payload_is_noticed(spark, tmp_path):
    data = record("response", "urn:x-page:1", "http://a/", None, b"payload").replace(b"payload" + END, b"PAYLOAD" + END)
    (tmp_path / "a.warc").write_bytes(data)
    with pytest.raises(Exception, match="digest"):
        spark.read.format("warc").option("payload", "verify").load(str(tmp_path)).collect()


def test_small_payloads_and_empty_tables(spark, pages, tmp_path):
    kinds = {r["record_id"]: r["record_type"] for r in records(pages, least_bytes=20).collect()}
    assert kinds["urn:x-page:1"] == "response" and kinds["urn:x-page:3"] == "response"
    assert round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0
