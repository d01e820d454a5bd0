import math
import re

from keelson.llm.order_sample import mix, mixed
from tests.llm.conftest import AWKWARD, prose


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """The water level by rounds: full sources keep their room, the rest share what is left."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, pool, out = set(names), share * sum(sizes.values()), {}
    while left:
        level = pool / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > most * sizes[s]}
        for s in full or left:
            out[s] = most * sizes[s] if full else level * weight[s]
        pool -= sum(out[s] for s in full)
        left = left - full if full else set()
    return out


def check(rows, result):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    by = {}
    for (_, _, s), n in zip(rows, size):
        by[s] = by.get(s, 0) + n
    want = targets(by)
    assert sorted(r["size"] for r in result) == sorted(size)
    for r in result:
        assert r["source_size"] == by[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    return by, want


def test_targets_and_words_come_near(docs):
    rows = [(i, prose(i, 5 + i % 40), ("a", "b", "c", "d", None)[i % 5 if i % 3 else 0]) for i in range(600)]
    result = mix(docs(*rows)).collect()
    by, want = check(rows, result)
    for s in by:
        taken = sum(r["taken"] for r in result if r["source"] == s)
        assert abs(taken - want[s]) <= 23, (s, taken, want[s])  # half of the longest document
    whole = {r["doc_id"]: (r["copies"], r["text"]) for r in mixed(docs(*rows)).collect()}
    assert whole == {r["doc_id"]: (r["copies"], rows[r["doc_id"]][1]) for r in result if r["copies"]}
    again = {r["doc_id"]: r["copies"] for r in mix(docs(*rows[::-1])).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in result}


def test_awkward_rows(docs):
    check(AWKWARD, mix(docs(*AWKWARD)).collect())


def test_empty(docs):
    assert mix(docs()).count() == 0


def test_preference_shifts_inclusion(docs, spark):
    rows = [(i, "a b c d", ("big", "small")[i % 2]) for i in range(2000)]
    df = docs(*rows).selectExpr("*", "if(doc_id % 4 < 2, 8.0D, 1.0D) as likes")
    taken = {r["doc_id"]: r["copies"] for r in mix(df, weights=(1, 1), share=0.5, preference="likes").collect()}
    high, low = (sum(n for d, n in taken.items() if (d % 4 < 2) == want) for want in (True, False))
    assert high > 2 * low and abs(high + low - 1000) <= 2
