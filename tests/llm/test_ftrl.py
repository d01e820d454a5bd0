import numpy as np

from keelson.llm.ftrl import BITS, Ftrl, buckets, fit, score, training_rows
from tests.llm.conftest import AWKWARD, prose


def learn(spark, docs, bad="vile"):
    rows = [(i, prose(i, 30) + (f" {bad} " if i % 4 == 0 else " ") + prose(-i, 20), "s") for i in range(800)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "t") for i in range(800)] + [(None, 0, 1, "t"), (3, 0, None, "t")],
                                   "doc_id long, quality int, toxic int, text string")
    return rows, labels, fit(training_rows(docs(*rows), labels))


def test_learns_and_stays_sparse(spark, docs):
    rows, _, weights = learn(spark, docs)
    assert 0 < len(weights) < 2000 and max(weights) < 1 << BITS
    fresh = [(i, prose(5000 + i, 40) + (" VILE. " if i % 2 else ""), "s") for i in range(100)]
    got = {r["doc_id"]: r["score"] for r in score(docs(*fresh), weights, ["doc_id"]).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in got) and all(0 <= p <= 1 for p in got.values())


def test_held_out_labels_teach_nothing(spark, docs):
    import zlib

    rows, labels, _ = learn(spark, docs)
    taught = training_rows(docs(*rows), labels).count()
    assert taught == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(800))
    some = training_rows(docs(*rows), labels, sample=100).count()
    assert 40 < some < 170


def test_awkward_rows_and_empty(spark, docs):
    got = score(docs(*AWKWARD), {0: -1.0, 7: 2.0}, ["doc_id", "spans"]).collect()
    assert len(got) == len(AWKWARD)
    bias = 1 / (1 + np.exp(1))
    assert all(abs(r["score"] - bias) < 1e-12 for r in got if r["doc_id"] in (1, 2, 3))
    assert score(docs(), {}, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit(training_rows(docs(*AWKWARD), labels)) == {}


def test_features_do_not_cross_texts():
    data = np.frombuffer(b"a b ca b c", np.uint8)
    rows, found = buckets(data, np.array([0, 5, 10]))
    one = {k: sorted(found[rows == k].tolist()) for k in (0, 1)}
    assert one[0] == one[1] and len(one[0]) == 3 + 2 + 1


def test_l1_keeps_rare_noise_at_zero():
    model = Ftrl()
    for i in range(50):
        model.learn(np.array([1, 100 + i]), i % 2)
    assert (model.weights(np.arange(100, 150)) == 0).all()


def test_weights_equal_a_plain_learner(spark, docs):
    """Per-coordinate FTRL-proximal, one coordinate at a time, over the same order of rows."""
    import math

    from keelson.llm.ftrl import ALPHA, BETA, EPOCHS, L1, L2

    rows = [(i, prose(i % 40, 12) + (" vile words here" if i % 3 == 0 else ""), "s") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    taught = training_rows(docs(*rows), labels)
    got = fit(taught)
    lines = []
    for r in taught.orderBy("order", "label", "text").collect():
        data = np.frombuffer(r["text"].encode(), np.uint8)
        lines.append((sorted({0, *buckets(data, np.array([0, len(data)]))[1].tolist()}), r["label"]))
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= L1:
            return 0.0
        return (math.copysign(L1, zi) - zi) / ((BETA + math.sqrt(n.get(i, 0.0))) / ALPHA + L2)

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(lines)):
            at, label = lines[k]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if weight(i) != 0}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want) and len(want) > 3


def test_an_id_that_holds_many_rows_is_bounded(spark, docs):
    same = spark.range(20_000).selectExpr("CAST(1 AS BIGINT) AS doc_id", "'one text' AS text")
    many = spark.range(5_000).selectExpr("CAST(2 AS BIGINT) AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    rows = training_rows(same.unionByName(many), labels, sample=500)
    assert 300 < rows.count() < 700 and {r["label"] for r in rows.collect()} == {1}
    assert training_rows(same, labels).count() == 1
