"""Order-dependent jobs against brute force, with one group holding most rows."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from keelson.operators import attempts as A
from keelson.operators import evidence as E
from keelson.plans.ordering import first_per_key, numbered, top_k


def skewed(n=600, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else rng.choice("abc") if rng.random() < .9 else None, i, rng.randrange(5)) for i in range(n)]


def test_numbered_equals_brute_force(rows):
    data = skewed()
    got = {(r.g, r.o): r["rank"] for r in numbered(rows(data, "g string, o long, s int"), ["g"], "o", [-F.col("s")], block=7).collect()}
    want = {}
    for g in {d[0] for d in data}:
        for i, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (-d[2], d[1])), 1):
            want[(g, d[1])] = i
    assert got == want


def test_top_k_and_first(rows):
    data = skewed(seed=2)
    df = rows(data, "g string, o long, s int")
    got = sorted((str(r.g), r.o) for r in top_k(df, ["g"], [F.col("s").desc(), F.col("o")], 3).collect())
    want = sorted((str(g), d[1]) for g in {d[0] for d in data}
                  for d in sorted((d for d in data if d[0] == g), key=lambda d: (-d[2], d[1]))[:3])
    assert got == want
    assert first_per_key(df, ["g"], [F.col("o")]).count() == len({d[0] for d in data})


def test_budget_equals_brute_force(rows):
    rng = random.Random(3)
    data = [("L1" if rng.random() < .7 else "L2", i, f"https://x.example/{i}", "t" * rng.randrange(0, 90), "other") for i in range(80)]
    got = {(r.lead_id, r.ordinal): r.header + r.body for r in E.pack_budget(
        rows(data, "lead_id string, ordinal long, url string, text string, source_type string"), 900).collect()}
    want = {}
    for lead in ("L1", "L2"):
        used = 0
        for i, d in enumerate([d for d in data if d[0] == lead], 1):
            header = f"[S{i}] type={d[4]} url={d[2]}\n"
            room = 900 - used - len(header)
            if room <= 0:
                break
            want[(lead, d[1])] = header + d[3][:room]
            used += len(header) + len(d[3][:room])
    assert got == want


def test_lifecycle_equals_brute_force(rows):
    rng = random.Random(4)
    actions = [*A.ACTIONS, "noise"]
    data = [(("hot" if rng.random() < .5 else f"a{rng.randrange(9)}"), i, rng.choices(actions, [6, 1, 1, 5, 0.2, 3])[0]) for i in range(500)]
    got = {r.id: (r.status, r.retry_count, r.events) for r in A.lifecycle(
        rows(data, "id string, o long, action string"), "id", "o", "action", block=8).collect()}
    want = {}
    for key, items in groupby(sorted(data), key=lambda d: d[0]):
        state, n = ("pending", 0), 0
        for _, _, action in items:
            state, n = A.next_state(state, action, 3), n + 1
        want[key] = (*state, n)
    assert got == want


def test_host_diversity(rows):
    links = ["https://www.social.example/1", "https://fr.social.example/2", "https://social.example/3",
             "https://corp.example2/x", "https://news.other/y"]
    df = rows([("L1", i, u) for i, u in enumerate(links)], "lead_id string, i int, url string")
    out = E.diverse_hosts(df, ["lead_id"], "url", "i", limit=4).orderBy("rank").collect()
    assert [r.i for r in out] == [0, 3, 4]


def test_distinct_in_order(rows):
    df = rows([(1, 1, " A "), (1, 2, "a"), (1, 3, " "), (1, 4, "B"), (2, 5, "a")], "k int, o int, v string")
    out = E.distinct_in_order(df, ["k"], "v", "o").orderBy("o").collect()
    assert [(r.k, r.v) for r in out] == [(1, "A"), (1, "B"), (2, "a")]


def test_evidence_union_keeps_the_place(rows):
    schema = "lead_id string, ordinal long, url string, text string, source_type string"
    snippets = rows([("L", 1, "https://a.example/", "s1", "other"), ("L", 2, "https://b.example/", "s2", "other")], schema)
    crawled = rows([("L", 1, "https://c.example/", "c1", "other"), ("L", 2, "https://A.example", "c2", "other"),
                    ("L", 3, "http://u:p@d.example", "bad", "other")], schema)
    out = E.merge_evidence(snippets, crawled).orderBy("place_kind", "ordinal").collect()
    assert [r.text for r in out] == ["c2", "s2", "c1"]


def test_hit_ranking(rows):
    hits = [
        ("https://music.example/a", "Example Person", "drummer and musician"),
        ("https://corp.example/b", "Example Person", "founder and CEO"),
        ("https://search.brave.com/x", "Example Person", ""), ("https://imgs.example/i", "Example Person", ""),
        ("https://files.example/a.pdf", "Example Person", ""), ("https://www.youtube.com/v", "Example Person", ""),
        ("https://other.example/", "Someone Else", "yacht"), ("https://corp.example/b/", "Example Person", "again"),
    ]
    df = rows([("L1", i, *h, "Example Person") for i, h in enumerate(hits)],
              "lead_id string, ordinal int, url string, title string, content string, wanted string")
    out = E.rank_hits(df, 5, required_name="wanted").orderBy("rank").collect()
    assert [r.canonical_url for r in out] == ["https://corp.example/b", "https://music.example/a"]
    assert [r.score for r in out] == [5, -8]


def test_own_domain_first(rows):
    df = rows([("L", 1, "https://a.example/"), ("L", 2, "https://shop.corp.example/"), ("L", 3, "https://notcorp.example/")],
              "lead_id string, o int, url string")
    out = E.own_domain_first(df, ["lead_id"], "url", F.lit("corp.example"), "o", 2).orderBy("rank").collect()
    assert [r.o for r in out] == [2, 1]


def test_search_queries(rows, lead):
    out = [r.query for r in E.search_queries(lead(), "profile").orderBy("ordinal").collect()]
    assert out[0] == '"Example Person" site:example.com' and out[1] == '"Example Person" Example Co FR' and len(out) == 5
    assert [r.query for r in E.search_queries(lead(email="x@gmail.com", company_name="", country=""), "primary").collect()] == ['"Example Person"']
    assert E.search_queries(lead(), "broad").count() == 11
    short = [r.query for r in E.search_queries(lead(company_name="", country=""), "short").orderBy("ordinal").collect()]
    assert short == ['"Example Person" "example.com"', '"Example Person"', '"person@example.com"']
