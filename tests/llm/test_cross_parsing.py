import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm.cross_parsing import Automaton, Parser, chances, fit, folded, held_out, labelled_passages, predict
from keelson.llm.language_query import op13_cross_parsing
from tests.llm.conftest import AWKWARD
from tests.test_plans import SF

SCHEMA = "doc_id long, text string, lang string, n long, score string, `_text` int, lang_pred int, `order` string, passage int"


@pytest.fixture
def labelled(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "s", 2, 3, "o", 4) for r in rows], SCHEMA)


def plain(text):
    return re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").encode().lower())


def brute_phrases(data, text, block):
    """Greedy longest matches, found by substring search, block by block."""
    count = 0
    for b in range(0, len(data), block):
        part, i = data[b: b + block], 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[i: j + 1] in text:
                j += 1
            count, i = count + 1, j
    return count


def tables(text):
    a = Automaton(text)
    return {"n": len(text), "has": a.has, "first": a.first, "targets": a.targets}


@pytest.mark.parametrize("alphabet", [b"ab", b"ab \xc3\xa9\xff", bytes(range(256))])
def test_phrases_equal_substring_search(alphabet):
    r = random.Random(2)
    for n in (0, 1, 5, 60, 400):
        texts = [bytes(r.choice(alphabet) for _ in range(n)) for _ in range(3)]
        docs = [bytes(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(20)] + [b"", texts[0]]
        data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
        for block in (1, 7, 512):
            got = Parser([tables(t) for t in texts]).phrases(data, offsets, block)
            assert got.tolist() == [[brute_phrases(d, t, block) for t in texts] for d in docs]


def test_automaton_holds_every_substring_and_no_other():
    text = b"abracadabra abrac"
    parser = Parser([tables(text)])
    parts = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for p in parts | {p + bytes([c]) for p in parts for c in b"abcdr z"}:
        assert (parser.phrases(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0, 0] == 1) == (p in text)


def test_folding_stays_inside_texts():
    texts = ["A, B!", "  x", "", "É 12 \n", "y "]
    raw = [t.encode() for t in texts]
    data, offsets = folded(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
    assert got == [plain(t) for t in texts] == [b"a b ", b" x", b"", "É ".encode(), b"y "]


WORDS = {"aa": "ka ti mo re sul".split(), "bb": "vem qor pli dant".split(), "cc": "øre ål sjø bær".split()}


def speech(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang]) + r.choice(WORDS[lang]) for _ in range(n))


def corpus():
    return [(i, speech(lang, i, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]


def brute_predict(text, model):
    if not re.search(r"[^\W\d_]", text or ""):
        return "und", 0.0
    names, automata = model
    data = np.frombuffer((text or "").encode(), np.uint8)
    bits = Parser(automata).phrases(*folded(data, np.array([0, len(data)]))) * np.log2([a["n"] + 1 for a in automata])
    return names[int(bits.argmin())], float(chances(bits).max())


def test_learns_and_predicts(labelled):
    rows = corpus()
    model = fit(labelled_passages(labelled(rows)))
    assert model[0] == ["aa", "bb", "cc"]
    fresh = [(1000 + i, speech(lang, -i - 1, 1 + i % 7), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(labelled(fresh), model, ["doc_id"]).collect()}
    assert all(got[i][0] == lang and 0 < got[i][1] <= 1 for i, _, lang in fresh)
    assert all(math.isclose(got[i][1], brute_predict(t, model)[1]) for i, t, _ in fresh)


def test_only_labelled_rows_that_are_not_held_out_teach(labelled):
    rows = corpus() + [(None, "zz zz", "zz"), (500, "no language", None), (501, "12 34", "dd"), (502, None, "dd")]
    ids = {i for i in range(180) if zlib.crc32(str(i).encode()) % 3 != 1}
    taught = labelled_passages(labelled(rows))
    assert taught.groupBy("lang").count().count() == 3 and taught.count() == len(ids)
    assert labelled_passages(labelled(rows), rows=4).count() == 12
    few = labelled_passages(labelled(rows), total=300, passage=40).collect()
    assert {r["lang"] for r in few} == {"aa", "bb", "cc"}
    assert all(sum(len(r["passage"]) + 1 for r in few if r["lang"] == x) <= 101 for x in WORDS)
    marks = {r["doc_id"]: r["h"] for r in labelled(rows).select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert marks[None] is False and all(marks[i] == (i not in ids) for i in range(180))


def test_one_row_that_is_a_third_of_all_teaches_once(labelled):
    same = labelled([(0, speech("aa", 0, 30), "aa")]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).unionByName(
        labelled(corpus()))
    assert labelled_passages(same).exceptAll(labelled_passages(labelled(corpus()))).count() == 0


def test_awkward_rows_and_nothing_learned(labelled):
    model = fit(labelled_passages(labelled(corpus())))
    rows = [(i, t, s) for i, t, s in AWKWARD] + [(20, "12 !? 34", "aa"), (21, "Σ", None), (22, "katimo " * 20_000, "aa"), (23, "😀", "aa")]
    got = predict(labelled(rows), model, ["doc_id", "lang", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_predict(r["text"], model)
        assert r["lang_pred"] == want[0] and math.isclose(r["score"], want[1])
    assert predict(labelled([]), model, ["doc_id"]).collect() == []
    nothing = fit(labelled_passages(labelled([])))
    assert nothing == ([], [])
    assert {(r["lang_pred"], r["score"]) for r in predict(labelled(rows), nothing, ["doc_id"]).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op13_cross_parsing(spark, SF).join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
