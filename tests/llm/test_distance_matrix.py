import hashlib
import math
import random

import numpy as np
import pytest

from keelson.llm.distance_matrix import LIMIT, clustered, moved, with_inertia


def brute(rows, k, rounds, width):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width
          and all(x is not None and math.isfinite(x) and abs(x) < LIMIT / 256 for x in v)]
    order = sorted(ok, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [w for _, w in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(w, c)), j) for j, c in enumerate(centroids)) for _, w in ok]

    for _ in range(rounds):
        found = [j for _, j in assign()]
        for j in set(found):
            mine = [w for (_, w), f in zip(ok, found) if f == j]
            centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    last = assign()
    per = {j: sum(d for d, f in last if f == j) for _, j in last}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, per[j], sum(per.values()), digest[j]) for (i, _), (d, j) in zip(ok, last)), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                               "vec_id long, embedding array<double>, cluster int, w string, dots int")
    out = with_inertia(*clustered(df, **options))
    return sorted(map(tuple, out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                        "centroid_sha256").collect()), key=str)


def test_random_vectors_repeated_rows_and_empty_clusters(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(7, [0.5] * 6)] * 150 + [(500 + i, [0.5] * 6) for i in range(50)]  # equal starts leave clusters empty
    for rounds in (0, 1, 5):
        assert run(spark, rows, k=12, rounds=rounds, width=6) == brute(rows, 12, rounds, 6)


def test_awkward_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("-inf"), 1.0]), (6, [1.0, 2.0, 3.0]),
            (7, [1e30, 0.0]), (None, [0.25, -0.25]), (None, None), (8, [-0.001, 400000.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0])]
    got = run(spark, rows, k=40, rounds=5, width=2)
    assert got == brute(rows, 40, 5, 2) and len(got) == 4
    assert run(spark, [], width=2) == [] and run(spark, rows[:3], width=2) == []


def test_rounds_end_early_without_a_change(spark):
    rows = [(i, [float(i % 2 * 10), 0.0]) for i in range(10)]
    assert run(spark, rows, k=2, rounds=50, width=2) == brute(rows, 2, 50, 2)


@pytest.mark.parametrize("size", [50, LIMIT - 1])
def test_only_changed_components_move_dot_products(size):
    r = np.random.default_rng(3)
    w = r.integers(-size, size, (40, 8))
    old = r.integers(-size, size, (5, 8))
    new = old.copy()
    new[1, 3], new[4] = old[1, 3] + 7, r.integers(-size, size, 8)
    dots = w @ old.T
    kept = dots.copy()
    moved(dots, w, new - old)
    assert (dots == w @ new.T).all() and (dots[:, [0, 2, 3]] == kept[:, [0, 2, 3]]).all()
    # a component that has not changed is not read
    w[:, [0, 1, 2, 4, 5, 6, 7]] = 0
    dots = kept.copy()
    moved(dots, w, (new - old) * (np.arange(5) == 1)[:, None])
    assert (dots[:, 1] == kept[:, 1] + 7 * w[:, 3]).all()


def test_no_exchange_of_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    plan = clustered(df, k=3, rounds=1, width=2)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
