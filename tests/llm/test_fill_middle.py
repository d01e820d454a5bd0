import hashlib
import random
import re

import pytest

from keelson.llm.fill_middle import fill_in_middle, output_pieces, plan, segments
from tests.llm.conftest import AWKWARD, prose


def brute(doc_id, text, seed=7, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i: 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text), text
    form = "spm" if h4 % 100 < suffix_first else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text), out


def run(df, **options):
    return sorted((tuple(r) for r in fill_in_middle(df, **options).collect()), key=str)


ROWS = AWKWARD + [
    (20, "one\n", "a"), (21, "\n", "a"), (22, "\n\n\n", "a"), (23, "é\nü ß\r\n\x00\nlast", "a"), (24, "has <S> inside\nx\n", "a"),
    (25, "a<\nP>b\n<", "a"), (26, "ends with <P", "a"), (27, "<<<\nS>\nM>\n<M", "a"), (28, "x\n" * 5000 + "y" * 300_000 + "\nz", "a"),
    (29, "𝒳" * 40 + "\n" + "tail", "a")] + [(100 + i, "\n".join(prose(i, 9).split(" ")) + "\n", "s") for i in range(120)]


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_equals_brute_force_at_every_piece_size(docs, piece):
    assert run(docs(*ROWS), piece=piece) == sorted((brute(i, t) for i, t, _ in ROWS), key=str)


def test_rates_and_digests_alone(docs):
    want = sorted((brute(i, t, 3, 40, 90) for i, t, _ in ROWS), key=str)
    assert run(docs(*ROWS), seed=3, rate=40, suffix_first=90) == want
    assert {"plain", "spm", "psm"} == {w[2] for w in want}
    assert run(docs(*ROWS), seed=3, rate=40, suffix_first=90, keep_text=False) == sorted((w[:-1] for w in want), key=str)


def test_marks_are_found_however_the_stream_is_cut():
    r = random.Random(5)
    for n in range(200):
        data = "".join(r.choice(["<", "P>", "S", ">", "M>", "a", "é", "\n"]) for _ in range(r.randrange(1, 30))).encode()
        form, _, cuts, ends = plan(data, n, 7, 100, 50)
        if form == "plain":
            continue
        whole = b"".join(output_pieces(data, form, cuts, ends, 5))
        size = r.randrange(1, 6)
        found = {"prefix": b"", "middle": b"", "suffix": b""}
        for segment, chunk in segments((whole[i: i + size] for i in range(0, len(whole), size)), form):
            found[segment] += chunk
        assert found == {"prefix": data[: cuts[0]], "middle": data[cuts[0]: cuts[1]], "suffix": data[cuts[1]:]}


def test_many_equal_rows_and_many_texts_under_one_id(spark):
    same = spark.range(30_000).selectExpr("CAST(5 AS BIGINT) AS doc_id", "concat(repeat('line of text\\n', 50), 'end') AS text")
    other = spark.range(3_000).selectExpr("CAST(6 AS BIGINT) AS doc_id", "concat('a\\nb\\n', id) AS text")
    got = fill_in_middle(same.unionByName(other), keep_text=False).groupBy("doc_id", "restored_sha256").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 3_000 + [30_000]


def test_copies_that_return_after_the_memory_of_a_task(spark, monkeypatch):
    import keelson.llm.fill_middle as fm
    monkeypatch.setattr(fm, "RECENT", 1)
    rows = [(i % 3, f"t\n{i % 3}\nu\n") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert run(df, piece=2) == sorted((brute(*r) for r in rows), key=str)


def test_empty_table_and_one_shuffle(docs, spark):
    assert run(docs()) == []
    out = fill_in_middle(docs(*ROWS[:5]), keep_text=False)
    lineage = out.rdd.toDebugString().decode()
    assert lineage.count("ShuffledRDD") + lineage.count("PairwiseRDD") <= 2  # one exchange: its two sides
