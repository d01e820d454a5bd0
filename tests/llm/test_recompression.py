import hashlib
import random

import numpy as np

from keelson.llm.recompression import first_rows, hashed, keyed, phrases, unpacked, window_rows, with_ranges, without_repeats
from tests.llm.conftest import AWKWARD, prose


def brute(rows, window=13):
    where = {}
    for d, t, _ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            where[key] = min(where.get(key, 1 << 63), 1 << 63 if d is None else d)
    out = []
    for d, t, _ in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if where[tuple(w[i:i + window])] < (1 << 63 if d is None else d):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def run(df, **options):
    return sorted(map(tuple, without_repeats(df, **options).collect()), key=str)


def test_planted_passages(docs):
    shared = [prose(1000 + i, 13 + 9 * i).split() for i in range(8)]
    r = random.Random(4)
    rows = []
    for i in range(60):
        p = r.choice(shared)
        a = r.randrange(len(p))
        rows.append((100 - i, " ".join([prose(i, r.randrange(40)), *p[a:], prose(-i, 9), *r.choice(shared)]), "s"))
    rows += [(200 + i, prose(7, 400), "s") for i in range(5)] + AWKWARD
    rows += [(300, "same " * 14, "s"), (301, "same " * 13, "s"), (302, "x " + "same " * 40, "s"), (303, "a b " * 30, "s"),
             (304, "b a " * 30, "s")]
    want = brute(rows)
    assert run(docs(*rows)) == want
    assert run(docs(*rows), slab=50, bucket=37) == want


def test_small_alphabet(docs):
    r = random.Random(9)
    rows = [(r.randrange(20), " ".join(r.choice("ab") for _ in range(r.randrange(60))), "s") for _ in range(80)]
    assert run(docs(*rows), window=5, slab=64) == brute(rows, 5)


def test_equal_passages_get_equal_symbols():
    passage = prose(1, 300)
    parts = []
    for text in (prose(2, 50) + " " + passage, passage + " " + prose(3, 80)):
        data = np.frombuffer(text.encode(), np.uint8)
        h, firsts = hashed(data, np.array([0, len(data)]))
        first = np.zeros(len(h), bool)
        first[0] = True
        parts.append(set(phrases(h, first)[0].tolist()))
    assert len(parts[0] & parts[1]) >= 8


def test_settled_entries_of_a_common_passage_are_dealt_out(docs):
    common = prose(5000, 13)
    rows = [(i, f"{prose(i, 20)} {common} {prose(-i - 1, 20)}", "s") for i in range(2000)]
    texts = keyed(docs(*rows), "doc_id", "text").select("id", "th", "text").repartition(100, "id")
    buckets, found = 16, first_rows(texts, 13, 500, 16)
    hot = texts.selectExpr("id", "th", "explode(sequence(0, 48)) s", "0 n")
    for entries in (found.filter("bucket is not null"), window_rows(with_ranges(texts, hot), 13, 500, buckets)):
        load = [0] * buckets
        for r in entries.filter("settled").select("bucket", "ps").collect():
            load[r["bucket"]] += len(unpacked(r["ps"], np.int32))
        assert sum(load) >= 1500 and max(load) < sum(load) / 4


def test_empty(docs):
    assert without_repeats(docs()).count() == 0


def test_many_equal_rows_and_copies_of_them(spark):
    """A third of all rows are one row: its ranges are worked out once."""
    shared, own = prose(1, 40), prose(2, 30)
    rows = [(1, shared + " " + prose(3, 20)), (7, own + " " + shared), (9, own)]
    hot = spark.range(0, 100_000, 1, 8).selectExpr("CAST(7 AS BIGINT) AS doc_id", f"'{own} {shared}' AS text")
    some = spark.createDataFrame([(1, rows[0][1]), (9, own), (None, shared)], "doc_id long, text string")
    out = without_repeats(hot.unionByName(some), keep_text=False)
    got = {tuple(r) for r in out.groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()}
    want = {r[0]: r for r in brute([(1, rows[0][1], ""), (7, rows[1][1], ""), (9, own, ""), (None, shared, "")])}
    assert got == {(*want[d][:4], n) for d, n in ((1, 1), (7, 100_000), (9, 1), (None, 1))}
