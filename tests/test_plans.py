"""Plan shapes that have to hold at any size."""

from pyspark.sql import functions as F

from keelson.functions import money, urls
from keelson.functions.text import fold
from keelson.operators import catalogue as C
from keelson.operators.evidence import score_evidence
from keelson.plans.ordering import top_k

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_an_equi_join(lead, docs):
    text = plan(score_evidence(docs(("https://a.example", "t", "other")), lead()))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_rank_filter_runs_before_the_shuffle(spark):
    text = plan(top_k(spark.read.parquet(f"{SF}/lineitem.parquet"), ["l_suppkey"], [F.col("l_orderkey")], 2))
    assert text.count("WindowGroupLimit") == 2


def test_a_hot_lead_is_cut_before_its_shuffle(spark, lead, docs):
    """The lead join leaves the rows spread, so the top-k after it keeps its map-side limit."""
    from keelson.operators.identity import document_facts, top_sources
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(top_sources(document_facts(score_evidence(docs(("https://a.example", "t", "other")), lead()), lead())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    text = plan(C.filter_catalogue(part, min_length=5, columns={"length": "p_size"}).select("p_partkey"))
    assert "GreaterThanOrEqual(p_size,5)" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in text


def test_no_python_in_column_jobs(rows):
    df = rows([("x",)], "t string")
    for out in (money.with_price(df, "t", "p"), urls.with_safe(df, "t", "u"), df.select(fold(F.col("t")))):
        text = plan(out)
        assert "Python" not in text and "Arrow" not in text


def test_derived_filter_is_not_copied_below(rows):
    """A text is folded once although the filter reads several columns made from it."""
    out = C.filter_price(rows([("1M",)], "t string"), "t", 1, 2_000_000)
    text = plan(out)
    assert text.count("_price_number") > 0 and text.index("Filter") < text.index("Project", text.index("Filter"))
    assert text.count("upper(") <= 2


def test_lead_documents_are_parsed_once(spark):
    """The optimized plan holds one parse however many rules and columns read the document."""
    from keelson.operators import leads as L
    from keelson.operators.validation import lead_document_rules, split, with_errors
    raw = spark.range(5).selectExpr("id AS ordinal", "CAST(id AS STRING) AS value")
    good, bad = split(with_errors(L.parse_documents(raw), lead_document_rules()))
    now = F.lit("2026-01-01").cast("timestamp")
    for out in (L.flatten_documents(good, now), bad.select("errors")):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_profiles_are_folded_once_and_scored_in_one_pass(spark, lead):
    from keelson.operators.providers import select_profiles
    profiles = spark.createDataFrame([("L1", 1, "text")], "lead_id string, ordinal long, profile_text string")
    text = select_profiles(profiles, lead(), 3)._jdf.queryExecution().optimizedPlan().toString()
    # one scan of the profiles, one of the leads; one fold of the text, one per context column
    assert text.count("LogicalRDD [lead_id") == 2
    assert text.count("translate(") <= 4


def test_texts_cross_the_network_once(spark, lead, docs):
    """Typing and scoring share one join, and no later exchange holds a text."""
    from keelson.operators.report import evidence_facts
    untyped = docs(("https://a.example", "t", "other")).drop("source_type")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(evidence_facts(untyped, lead()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("SortMergeJoin") + text.count("ShuffledHashJoin") == 1 and text.count("Exchange") == 2


def test_budget_numbers_lengths_not_texts(spark, docs):
    from keelson.operators.evidence import pack_budget
    text = plan(pack_budget(docs(("https://a.example", "t", "other"))))
    windows = [line for line in text.splitlines() if "Window [" in line or "Window (" in line]
    assert windows and not any(" text#" in line or ",text#" in line for line in windows)
