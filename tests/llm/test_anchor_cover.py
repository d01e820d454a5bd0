import random

import numpy as np
import pytest
import xxhash

from keelson.llm.anchor_cover import BLOCKS, fingerprint, links, masks, near_duplicates, spanning
from tests.llm.conftest import AWKWARD, prose


def slow(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    counts = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(s))


def groups(fps, threshold=4):
    left, out = set(fps), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if bin(x ^ y).count("1") <= threshold}
            left -= near
            todo += near
        out.append(group)
    return out


def test_fingerprints(monkeypatch):
    texts = [prose(1, n) for n in (1, 2, 3, 4, 5, 60)] + [None, "", " \n", "A b\x1cC É", "w " * 500]
    assert [fingerprint(t) for t in texts] == [slow(t) for t in texts]
    monkeypatch.setattr("keelson.llm.anchor_cover.SLAB", 37)
    assert [fingerprint(t) for t in texts] == [slow(t) for t in texts]


@pytest.mark.parametrize("bits, parity, threshold", [*BLOCKS, (32, 5, 2), (9, 3, 3)])
def test_visits_reach_every_home(bits, parity, threshold):
    home, visits = masks(bits, parity, threshold)
    coded = (1 << parity) - 1

    def syndrome(x):
        s = 0
        for i in range(coded):
            s ^= (i + 1) * (x >> i & 1)
        return s

    r = random.Random(bits)
    for _ in range(300):
        x = r.getrandbits(bits)
        y = x
        for i in r.sample(range(bits), threshold):
            y ^= 1 << i
        assert syndrome(x ^ home[syndrome(x)]) == 0
        anchor = x ^ home[syndrome(x)]
        assert y ^ anchor in visits[syndrome(y)]
        assert all(bin(m).count("1") <= threshold + 1 for m in visits[syndrome(y)])


@pytest.mark.parametrize("limit", [20_000, 7])
def test_links_join_the_same_groups(spark, limit):
    r = random.Random(limit)
    fps = {r.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    for centre in list(fps)[:6]:  # dense groups and chains
        x = centre
        for _ in range(60):
            for i in r.sample(range(64), r.choice((1, 2, 4))):
                x ^= 1 << i
            fps.add(x)
            x = centre if r.random() < 0.6 else x
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit=limit).collect()
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in found:
        parent[root(u % (1 << 64))] = root(v % (1 << 64))
    mine = {}
    for x in fps:
        mine.setdefault(root(x), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups(fps)))


def test_spanning_needs_a_home():
    fp = np.array([0, 1, 3], np.uint64)
    a, _ = spanning(fp, np.array([False, False, False]), 4)
    assert len(a) == 0
    a, _ = spanning(fp, np.array([True, False, False]), 4)
    assert len(a) == 2


def test_documents(docs):
    rows = [(10 + i, prose(i % 5, 200) + f" tail{i}", "s") for i in range(20)] + AWKWARD + [(4, "A  b", "s"), (99, "a B", "t")]
    got = near_duplicates(docs(*rows)).collect()
    fps = {}
    for d, t, _ in rows:
        fps.setdefault(slow(t), []).append(d)
    want = []
    for group in groups(fps):
        ids = [d for f in group for d in fps[f]]
        first = min((d for d in ids if d is not None), default=None)
        want += [(d, format(f, "016x"), first) for f in group for d in fps[f]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert near_duplicates(docs()).count() == 0
