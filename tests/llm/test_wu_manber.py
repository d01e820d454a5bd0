import random
import re

import numpy as np

from keelson.llm.wu_manber import Patterns, contaminated, find_items, n_hit
from tests.llm.conftest import AWKWARD, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    out = []
    for doc, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(window, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == b[k:k + n]:
                        hit.update(range(p, p + n))
                        found.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["hit"], sorted(r["items"])) for r in df.select(
        "doc_id", "n_words", n_hit().alias("hit"), "items").collect()), key=str)


def items_of(spark, items):
    return spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, spans int")


ITEMS = [(1, prose(1, 20)), (10, prose(2, 14)), (2, "Of the"), (3, "x"), (4, None), (5, "  ...  "), (None, prose(3, 13)),
         (6, prose(1, 20)), (7, "of the"), (7, "of the"), (8, "é à")]


def test_planted_windows(spark, docs):
    inside = prose(1, 20).split()
    rows = [(20, prose(90, 30) + " " + " ".join(inside[2:17]).upper() + " " + prose(91, 9), "s"),
            (21, "-".join(inside), "s"), (22, " ".join(inside[:12]), "s"), (23, "the of the of THE x", "s"),
            (24, prose(3, 13) + "\n" + prose(3, 13), "s"), (25, "É à é À", "s"), *AWKWARD]
    assert result(find_items(docs(*rows), items_of(spark, ITEMS), ["doc_id"])) == brute(rows, ITEMS)


def test_several_passes_give_the_same(spark, docs):
    rows = [(i, prose(i, 40) + " of the " + prose(1, 20), "s") for i in range(30)] + AWKWARD
    one = find_items(docs(*rows), items_of(spark, ITEMS), ["doc_id"])
    many = find_items(docs(*rows), items_of(spark, ITEMS), ["doc_id"], limit=60)
    assert result(one) == result(many) == brute(rows, ITEMS)


def test_random_small_alphabet():
    r = random.Random(5)
    for trial in range(40):
        make = lambda n: " ".join(r.choice(("a", "b", "ab", "ba", "é")) for _ in range(n))
        items = [(str(i), make(r.randint(0, 8))) for i in range(6)]
        texts = [make(r.randint(0, 60)) for _ in range(8)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        n, found = Patterns(items, window=3).hits(data, offsets)
        for k, want in enumerate([brute([(k, t)], items, 3)[0] for k, t in enumerate(texts)]):
            spans, ids = found.get(k, ([], set()))
            assert (n[k], len({q for a, b in spans for q in range(a, b)}), sorted(ids)) == want[1:], (trial, k)


def test_rule_and_empty(spark, docs):
    df = spark.createDataFrame([(0, 0), (0, 5), (1, 20), (1, 21)], "h int, n int")
    assert [r[0] for r in df.select(contaminated(df.h, df.n)).collect()] == [False, False, True, False]
    assert find_items(docs(), items_of(spark, ITEMS), ["doc_id"]).count() == 0
    none = find_items(docs((1, "a b", "s")), items_of(spark, []), ["doc_id"]).collect()
    assert none[0]["n_words"] == 2 and none[0]["items"] == []
