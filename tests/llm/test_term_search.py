import math
import random

from keelson.llm.term_search import top_k


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in sorted({(i, tuple(v)) for i, v in ok if i % every == 0}):
        scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, w string")
    return sorted(map(tuple, top_k(df, **options).collect()))


def test_random_and_ties(spark):
    r = random.Random(1)
    rows = [(i, [r.choice((0.0, 0.25, -0.5, 1.0)) for _ in range(6)]) for i in range(400)]
    rows += [(500 + i, [0.5] * 6) for i in range(200)] + [(900, None), (950, []), (1000, [1.0, None]), (1050, [float("nan")]),
             (1100, [float("inf"), 1.0]), (None, [1.0] * 6), (1150, [2.0, 1.0]), (1200, [1.0] * 9)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, block=64, query_block=5) == want


def test_repeated_rows_and_few_candidates(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [0.5]), (1, [0.5]), (2, [-1.0])]
    assert run(spark, rows) == [(0, 1, 1, 32768), (0, 2, 1, 32768), (0, 3, 2, -65536)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_one_query_id_that_holds_a_third_of_all_rows(spark):
    r = random.Random(2)
    rows = [(i + 1, [r.uniform(-1, 1) for _ in range(4)]) for i in range(400)] + [(0, [r.uniform(-1, 1) for _ in range(4)]) for _ in range(200)]
    # queries that share an id get the best of all of them
    best = {}
    for q, w in [(i, v) for i, v in rows if i % 50 == 0]:
        for i, v in rows:
            if i != q:
                score = sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(w, v))
                best.setdefault(q, {}).setdefault(i, []).append(score)
    want = []
    for q, found in best.items():
        pairs = sorted((-s, i) for i, scores in found.items() for s in scores)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(pairs)]
    assert run(spark, rows, query_block=16, block=64) == sorted(want)
