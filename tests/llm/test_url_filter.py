import pytest

from keelson.llm.url_filter import judge


@pytest.fixture
def rules(spark):
    return spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
                                  ("net", "/es/", "block"), ("net", "/fr/", "block"), ("odd.org", "/pre", "block"),
                                  ("odd.org", "/pre", "allow"), ("any.io", "", "block")], "host string, path string, verdict string")


CASES = {
    "http://Example.COM/en/1?x=/#y": ("example.com", "/en/1", "example.com/en/", "block"),
    "https://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
    "ftp://x.net/fr/a://b": ("x.net", "/fr/a://b", "net/fr/", "block"),
    "http://x.net/fr": ("x.net", "/fr", None, "allow"),
    "http://odd.org/prefix/1": ("odd.org", "/prefix/1", "odd.org/pre", "block"),
    "http://any.io?q": ("any.io", "", "any.io", "block"),
    "no scheme/en/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
    "http://" + "a." * 3000 + "net/es/" + "b/" * 3000: ("a." * 3000 + "net", "/es/" + "b/" * 3000, "net/es/", "block"),
}


def test_cases(spark, rules):
    urls = list(CASES) + [next(iter(CASES))] * 3
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)],
                                  "page_id long, url string, _prefix string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(pages, rules).collect()}
    assert got == {i: CASES[u] for i, u in enumerate(urls)}


def test_empty(spark, rules):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert judge(pages.limit(0), rules).count() == 0
    assert judge(pages, rules.limit(0)).collect()[0]["verdict"] == "allow"


def test_native_plan(spark, rules):
    pages = spark.createDataFrame([], "page_id long, url string")
    plan = judge(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("ExistingRDD", "") and "CartesianProduct" not in plan
