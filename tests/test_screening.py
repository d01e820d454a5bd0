import json

from pyspark.sql import functions as F

from keelson.operators import contract as K
from keelson.operators import providers as P
from keelson.operators import report as R
from keelson.operators.evidence import headline, prefixed_field, score_evidence, statement
from keelson.operators.identity import identity_short
from keelson.schemas import ADVERSE_RECORD, COMPANY_ITEM, PROFILE_ITEM, REPORT

PROFILE = ("https://www.linkedin.com/in/example", "# Example Person\nCEO and founder at Example Co\nMétier: CEO\nEntreprise: Example Co\nLocation: Nice", "linkedin")
SITE = ("https://example.com/about", "Example Person is the director of Example Co in FR", "company_website")


def one(reports):
    found = reports.select(F.to_json("report").alias("j")).collect()
    assert len(found) == 1
    report = json.loads(found[0].j)
    prudent(report)
    return report


def prudent(report):
    """Never clear, always a human review, nothing cited for an unresolved identity without sources."""
    for part in report["risk_screening"].values():
        assert part["status"] != "clear"
    assert report["kyc_assessment"]["overall_risk"] != "low"
    assert report["kyc_assessment"]["recommended_review"] != "standard"
    assert len(report["sources"]) <= 5


def test_two_sources_are_probable(lead, docs):
    r = one(R.assemble(docs(PROFILE, SITE), lead()))
    assert r["identity_resolution"]["status"] == "probable" and r["identity_resolution"]["confidence_score"] == 75
    assert r["kyc_assessment"]["overall_risk"] == "medium" and r["kyc_assessment"]["recommended_review"] == "manual_review"
    assert r["person_profile"]["current_title"] == "CEO" and r["person_profile"]["location"] == "Nice"
    assert r["person_profile"]["profiles"] == {"linkedin": PROFILE[0], "company_profile": SITE[0], "other": []}
    assert r["economic_coherence"]["level"] == "medium"
    assert [s["url"] for s in r["sources"]] == [PROFILE[0], SITE[0]]
    assert any(line == "Métier : CEO." for line in r["kyc_assessment"]["executive_summary"])


def test_exact_email_is_confirmed(lead, docs):
    r = one(R.assemble(docs(("https://a.example/", "Example Person person@example.com", "other")), lead()))
    assert r["identity_resolution"]["status"] == "confirmed" and r["identity_resolution"]["confidence_score"] == 95
    assert r["person_profile"]["emails"] == ["person@example.com"]


def test_name_only_keeps_candidates_apart(lead, docs):
    alone = lead(email="person@gmail.com", company_name="", country="", city="")
    r = one(R.assemble(docs(("https://a.example/1", "Example Person one thing", "other"),
                            ("https://b.example/2", "Example Person another", "other")), alone))
    assert r["identity_resolution"]["status"] == "ambiguous" and r["identity_resolution"]["confidence_score"] == 45
    assert [p["evidence"] for p in r["identity_resolution"]["matched_persons"]] == [["https://a.example/1"], ["https://b.example/2"]]
    assert r["person_profile"]["full_name"] == ""


def test_nothing_relevant_is_blank(lead, docs):
    r = one(R.assemble(docs(("https://a.example/1", "unrelated", "other")), lead()))
    assert r["identity_resolution"] == {"status": "unresolved", "confidence_score": 0, "matched_persons": [], "selected_profile_rationale": ""}
    assert r["kyc_assessment"]["recommended_review"] == "insufficient_data" and r["sources"] == []


def test_list_match_is_only_a_possible_homonym(lead, docs):
    r = one(R.assemble(docs(PROFILE, ("https://lists.example/1", "Example Person listed", "sanctions_db")), lead()))
    assert r["risk_screening"]["sanctions"]["status"] == "possible_homonym"
    assert len(r["risk_screening"]["sanctions"]["details"]) == 1
    assert r["risk_screening"]["pep"]["status"] == "not_enough_data"


def test_scores(lead, docs):
    out = score_evidence(docs(PROFILE, ("https://m.example/", "Person Example chess player", "other"),
                              ("https://shop.example.com/", "nothing", "other")), lead()).orderBy("ordinal").collect()
    assert [r.score for r in out] == [35 + 15 + 4 + 4 + 5 - 4, 22 - 20, 25]
    assert out[1].signals == ["nom complet"]


def test_short_rules(rows, lead):
    schema = "lead_id string, ordinal int, url string, title string, snippet string"
    own = rows([("L1", 1, "https://x.example/", "Example", ""), ("L1", 2, "https://example.com/team", "Example Person", "person@example.com")], schema)
    r = identity_short(own, lead()).first()
    assert (r.identity_status, r.confidence_score, r.sources, r.recommended_review) == ("probable", 70, 2, "manual_review")
    r = identity_short(own, lead(email="")).first()
    assert (r.identity_status, r.confidence_score, r.recommended_review) == ("unresolved", 0, "insufficient_data")
    r = identity_short(own.filter("ordinal = 9"), lead()).first()
    assert (r.identity_status, r.recommended_review) == ("unresolved", "insufficient_data")
    # a name may span two sources
    r = identity_short(rows([("L1", 1, "https://x.example/person", "", "Example"), ("L1", 2, "https://y.example/", "", "")], schema).withColumn(
        "url", F.when(F.col("ordinal") == 1, F.lit("https://x.example/p")).otherwise(F.col("url"))), lead(full_name="p Https")).first()
    assert r.name_found is True


def test_lines_and_fields(rows):
    text = "## cookie notice here\n* Short\n> Jane is the chairman of things. \nLocation:  Nice \n"
    r = rows([(text,)], "t string").select(
        headline(F.col("t")).alias("h"), statement(F.col("t"), F.lit("other")).alias("s"),
        prefixed_field(F.col("t"), "Location:").alias("l")).first()
    assert (r.h, r.s, r.l) == ("Jane is the chairman of things.", "Jane is the chairman of things", "Nice")


def candidate(**parts):
    base = {"identity_resolution": {"status": "probable", "confidence_score": 70},
            "kyc_assessment": {"overall_risk": "low", "recommended_review": "standard"},
            "sources": [{"type": "x", "url": "https://A.example//p/", "note": " n "}, {"url": "https://a.example/p"}, {"url": "https://no.example"}]}
    return json.dumps({**base, **parts})


def normalised(rows, lead, docs, **parts):
    found = rows([("L1", "Sure:\n```json\n" + candidate(**parts) + "\n```")], "lead_id string, reply string")
    found = found.select("lead_id", K.recover_json(F.col("reply")).alias("candidate"))
    return one(K.normalise(found, lead(), docs(("https://a.example/p", "t", "sanctions_db"))))


def test_contract_is_grounded(rows, lead, docs):
    r = normalised(rows, lead, docs, extra=1, adverse_media=[
        {"source_url": "https://a.example/p", "category": "odd", "title": "T"}, {"source_url": "https://x.example"}],
        maritime_screening={"status": "confirmed_link", "assets": [{"vessel_name": "V", "source_url": "https://x.example"}]},
        person_profile={"websites": ["https://a.example/p", "https://x.example"], "profiles": {"linkedin": "https://x.example"}})
    assert r["sources"] == [{"type": "sanctions_db", "url": "https://a.example/p", "note": "n"}]
    assert [a["category"] for a in r["adverse_media"]] == ["reputational"]
    assert r["maritime_screening"] == {"status": "non_determinable", "assets": []}
    assert r["person_profile"]["websites"] == ["https://a.example/p"] and r["person_profile"]["profiles"]["linkedin"] == ""
    assert "extra" not in r and list(r) == REPORT.names
    # low needs four clears, which are never claimed
    assert r["kyc_assessment"]["overall_risk"] == "medium"


def test_contract_screening_rules(rows, lead, docs):
    hit = {"status": "hit", "details": ["d"]}
    screening = {"sanctions": hit, "pep": {"status": "clear", "details": ["d"]}, "watchlists": hit, "offshore_leaks": hit}
    r = normalised(rows, lead, docs, risk_screening=screening)["risk_screening"]
    assert [r[k]["status"] for k in r] == ["hit", "not_enough_data", "hit", "not_enough_data"]
    r = normalised(rows, lead, docs, risk_screening=screening, identity_resolution={"status": "ambiguous", "confidence_score": 900})
    assert r["risk_screening"]["sanctions"]["status"] == "possible_homonym"
    assert r["identity_resolution"]["confidence_score"] == 100


def test_contract_without_sources_is_blank(rows, lead, docs):
    r = normalised(rows, lead, docs, sources=[{"url": "https://no.example"}])
    assert r["kyc_assessment"]["key_reasons"] == ["No model claim matched a crawled source URL."]
    assert r["query_input"]["full_name"] == "Example Person"


def test_unreadable_reply(rows):
    out = rows([("no object",), ("} {",), ("{broken",), ('x {"a": 1} y',)], "t string").select(K.recover_json(F.col("t")).alias("j")).collect()
    assert [r.j for r in out] == [None, None, None, '{"a": 1}']


def test_adverse_items(rows, spark):
    hit = lambda url, **x: {"url": url, "title": "t", "riskCategory": "Money-Laundering", "severity": "HIGH", **x}
    data = [(1, json.dumps({"country": "FR", "hits": [hit("https://a.example"), hit("https://v.example", entityRole="Victim"), hit("https://l.example", entityMatchConfidence="low"), hit("")]})),
            (2, json.dumps({"country": "DE", "hits": [hit("https://a.example"), hit("https://b.example", riskCategory="zzz", severity="?")]}))]
    df = rows(data, "record int, j string").select(F.lit("L1").alias("lead_id"), "record", F.from_json("j", ADVERSE_RECORD).alias("item"))
    out = P.adverse_items(df, ["lead_id"]).orderBy("record").collect()
    assert [(r.source_url, r.category, r.confidence, r.jurisdiction) for r in out] == [
        ("https://a.example", "criminal", "high", "FR"), ("https://b.example", "reputational", "low", "DE")]


def test_company_and_enrichment(rows, lead, docs):
    item = {"name": "Example Co", "website": "https://co.example", "industries": [{"name": "Boats"}], "employeeCount": 12,
            "locations": [{"line1": "1 rue", "city": "Nice", "country": "FR"}], "foundedOn": {"year": 1999}, "companyType": "SA"}
    facts = rows([("L1", json.dumps(item))], "lead_id string, j string").select(
        "lead_id", P.company_facts(F.from_json("j", COMPANY_ITEM)).alias("company"))
    reports = R.assemble(docs(PROFILE, SITE), lead())
    r = one(K.enrich_company(reports, facts))["company_profile"]
    assert (r["website"], r["industry"], r["address"], r["jurisdiction"]) == (SITE[0], "Boats", "1 rue, Nice, FR", "FR")
    assert (r["incorporation_date"], r["financials"]["employees"], r["lei"]) == ("1999", "12", "")
    # an unresolved person is not touched
    assert one(K.enrich_company(R.assemble(docs(("https://q.example/", "x", "other")), lead()), facts))["company_profile"]["industry"] == ""


def test_adverse_merge_is_gated_and_cites(rows, lead, docs):
    item = "lead_id string, ordinal int, category string, title string, summary string, date string, jurisdiction string, confidence string, status_type string, source_url string"
    items = rows([("L1", i, "civil", "t", "s", "", "", "low", "media_report", u) for i, u in enumerate(["https://n.example/1", "https://n.example/1", SITE[0]])], item)
    reports = R.assemble(docs(PROFILE, SITE), lead())
    r = json.loads(K.merge_adverse(reports, items).select(F.to_json("report").alias("j")).first().j)
    assert [a["source_url"] for a in r["adverse_media"]] == ["https://n.example/1", SITE[0]]
    assert [s["url"] for s in r["sources"]] == [PROFILE[0], SITE[0], "https://n.example/1"]
    closed = rows([("L1", False)], "lead_id string, passes_gate boolean")
    assert one(K.merge_adverse(reports, items, gate=closed))["adverse_media"] == []
    many = rows([("L1", i, "civil", "t", "s", "", "", "low", "media_report", f"https://m.example/{i}") for i in range(150)], item)
    for bound, want in ((None, 150), (20, 20)):
        merged = json.loads(K.merge_adverse(reports, many, max_hits=bound).select(F.to_json("report").alias("j")).first().j)
        assert [a["source_url"] for a in merged["adverse_media"]] == [f"https://m.example/{i}" for i in range(want)]


def test_profiles(rows, lead):
    def item(url, headline, place="Paris", **x):
        return json.dumps({"name": "Example Person", "headline": headline, "linkedinUrl": url, "location": {"linkedinText": place}, **x})
    data = [("L1", 1, item("u1", "Baker")), ("L1", 2, item("u2", "Manager")), ("L1", 3, item("u3", "Founder", currentPosition=[
        {"position": "Founder", "companyName": "Co", "description": "a  b", "companyLinkedinUrl": "cu"}])), ("L1", 4, item("", "CEO"))]
    profiles = P.flatten_profiles(rows(data, "lead_id string, ordinal int, j string").select("lead_id", "ordinal", F.from_json("j", PROFILE_ITEM).alias("item")))
    text = profiles.filter("ordinal = 3").first().profile_text
    assert text == "Example Person\nFounder\nMétier: Founder\nEntreprise: Co\nEntrepriseUrl: cu\nMissions: a b\nLocation: Paris\nFounder - Co"
    alone = lead(company_name="", country="", city="")
    assert [r.ordinal for r in P.select_profiles(profiles, alone, 5).orderBy("rank").collect()] == [3, 2]
    assert [r.ordinal for r in P.select_profiles(profiles, lead(city="PARIS"), 2).orderBy("rank").collect()] == [1, 2]
    rich = rows([("L1", 1, "u3", "rich")], "lead_id string, ordinal int, profile_url string, profile_text string")
    picked = P.swap_richer(P.select_profiles(profiles, alone, 1), rich, ["lead_id"]).first()
    assert picked.profile_text == "rich"
