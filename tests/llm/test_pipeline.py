import corpus_pipeline
import pytest

from tests.llm.conftest import AWKWARD, prose
from tests.test_plans import SF


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "b", prose(1, 20))], "item_id long, x string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(
        f"{at}/labels.parquet")
    return at


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", 3, "r") for d, t, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, `_text` string, "
                                 "spans int, row string")


def test_each_decision_takes_effect(spark, inputs):
    training = [(i, prose(i, 30) + (" vile" if i % 4 == 0 else ""), "a") for i in range(600)]
    rows = training + [(1000, prose(2000, 40) + " vile", "a"), (1001, prose(2001, 300), "a"),
                       (1002, prose(2001, 300).upper().replace(" ", "\n"), "b"), (1003, prose(1, 20) + " " + prose(2002, 30), "b"),
                       (1004, "my password = abcdefghijklmnop " + prose(2003, 40), "b")]
    docs, seen = table(spark, rows), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, inputs).toPandas().to_dict("records"), schema=docs.schema) \
            if name != "mixing" else stage(spark, docs, inputs)
        if name != "mixing":
            assert docs.columns == columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert 1000 not in seen["toxicity"] and len(seen["toxicity"]) >= 440
    assert 1001 in seen["near_dedup"] and 1002 not in seen["near_dedup"]
    assert 1003 in seen["near_dedup"] and 1003 not in seen["decontamination"]
    assert seen["secrets"][1004]["text"].startswith("my [SECRET] ")
    assert seen["secrets"][1004]["n_chars"] == len(seen["secrets"][1004]["text"])
    assert all(r["copies"] in (1, 2) for r in seen["mixing"].values()) and set(seen["mixing"]) <= set(seen["secrets"])


def test_near_dedup_judges_rows(spark, inputs):
    texts = [prose(3000 + i, 200) for i in range(5)]
    rows = [(7, texts[0], "a"), (7, texts[1], "a"), (7, texts[2], "a"), (7, texts[2], "a"), (7, texts[2], "b"), (3, texts[1], "a"),
            (None, texts[3], "a"), (None, texts[3].upper(), "b"), (None, texts[4], "a"), (8, texts[4], None)]
    got = [(r["doc_id"], r["text"].lower()) for r in corpus_pipeline.near_dedup(spark, table(spark, rows), inputs).collect()]
    assert sorted(got, key=str) == sorted([(7, texts[0]), (3, texts[1]), (7, texts[2]), (None, texts[3]), (8, texts[4])], key=str)


def test_awkward_rows_and_empty(spark, inputs):
    for rows in (AWKWARD, []):
        docs = table(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, inputs)
            got = out.collect()
            assert len(got) <= len(rows)
            if name == "secrets":
                assert len(got) == len(rows)


def test_whole_run(spark):
    df = corpus_pipeline.run(spark, SF)
    assert "copies" in df.columns and df.count() > 0
