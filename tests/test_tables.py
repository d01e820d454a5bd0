"""Catalogue, maintenance, lead, attempt and file jobs on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from keelson.operators import attempts as A
from keelson.operators import catalogue as C
from keelson.operators import leads as L
from keelson.operators import maintenance as M
from keelson.operators import validation as R
from keelson.sources import bodies, files



def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


BROKERS = [("1", "Ann", "ann@one.example"), ("2", "bob", "bob@two.example"), ("3", "BOB", "x@one.example"), ("4", "Cy", "cy@one.example")]


@pytest.fixture
def brokers(rows):
    return rows(BROKERS, "id string, broker_name string, email string")


@pytest.fixture
def boats(rows):
    return rows([("a", "Blue Star", "Maker", 10.0, "1", "Nice", True, 2, "1M€"), ("b", "Red", "Stellar", 20.0, "2", "Cannes", False, 0, "POA"),
                 ("c", "50% off", None, 30.0, None, "nice port", None, None, "500K€")],
                "id string, nom_bateau string, constructeur string, longueur_m double, broker_id string, localisation string, etoile boolean, nombre_cabines int, prix_actuel string")


def ids(df):
    return [r.id for r in df.collect()]


def test_catalogue_filters(boats, brokers):
    assert sorted(ids(C.filter_catalogue(boats, search="ST"))) == ["a", "b"]
    assert ids(C.filter_catalogue(boats, search="%")) == ["c"]  # wildcards are literal
    assert sorted(ids(C.filter_catalogue(boats, location="NICE"))) == ["a", "c"]
    assert ids(C.filter_catalogue(boats, location="Nice", match="exact")) == ["a"]
    assert len(ids(C.filter_catalogue(boats, min_length=0, max_length=0))) == 3  # 0 is "not set"
    assert ids(C.filter_catalogue(boats, min_length=15, max_length=25)) == ["b"]
    assert ids(C.filter_catalogue(boats, starred=True)) == ["a"]
    assert ids(C.filter_catalogue(boats, brokers, broker="ANN")) == ["a"]
    assert ids(C.filter_catalogue(boats, brokers, broker="Bob")) == []  # two matches
    assert ids(C.filter_catalogue(boats, brokers, broker="nobody")) == []
    assert sorted(ids(C.filter_price(boats, "prix_actuel", 400_000, None))) == ["a", "c"]
    assert ids(C.filter_cabins(boats, "nombre_cabines", None, 5)) == ["a"]
    assert ids(C.sort_catalogue(C.filter_price(boats, "prix_actuel", None, None), "price-asc", "price", "id")) == ["b", "c", "a"]


def test_filter_parameters():
    assert C.sanitise_filters({"search": " x ", "min_length": "5", "max_length": "2", "broker": ""}) == {"search": "x"}
    assert C.sanitise_filters({"min_length": "-1", "max_length": "1000", "location": "y" * 200}) == {"location": "y" * 100, "max_length": 1000.0}


def test_name_resolution(rows, brokers):
    uuid = "0a0b0c0d-0000-4000-8000-000000000001"
    df = rows([(1, " ann "), (2, "Bob"), (3, uuid), (4, "zed"), (5, None)], "i int, n string")
    assert [r.broker_id for r in C.resolve_names(df, "n", brokers).orderBy("i").collect()] == ["1", None, uuid, None, None]
    exact = rows([(1, "BOB"), (2, "boB")], "i int, n string")
    assert [r.broker_id for r in C.resolve_names(exact, "n", brokers, exact_first=True).orderBy("i").collect()] == ["3", None]


def test_watchlist(boats, rows):
    wanted = rows([("blue-star", 2000, False, 0), ("New Boat", None, True, 1)], "nom_bateau string, annee int, etoile boolean, position int")
    out = C.watchlist(boats, wanted)
    assert out.count() == 4 and out.filter("id = 'virtual-new-boat-1'").first().longueur_m == 0
    assert C.watchlist(boats, wanted, other_filters=True).count() == 3
    assert C.watchlist(boats, wanted, search="NEW", starred=True).count() == 4
    assert C.watchlist(boats, wanted, search="zzz").count() == 3


def test_patches_and_deletes(rows):
    base = rows([("1", "a", 1, "old"), ("2", "b", 2, "old")], "id string, name string, n int, updated_at string")
    patches = rows([("1", 1, "x", True, None, False), ("1", 2, None, False, None, True), ("1", 3, "y", True, 9, False)],
                   "id string, seq int, name string, set_name boolean, n int, set_n boolean")
    out = {r.id: (r.name, r.n, r.updated_at) for r in M.apply_patches(base, patches, "id", ["name", "n"], "seq", F.lit("new")).collect()}
    assert out == {"1": ("y", None, "new"), "2": ("b", 2, "old")}
    gone = base.filter("id = '1'").select("id")
    children = rows([(10, "1"), (11, "2"), (12, None)], "c int, id string")
    assert [r.c for r in M.cascade_delete(children, gone, "id", "id").orderBy("c").collect()] == [11, 12]
    assert [r.id for r in M.set_null_children(children, gone, "id", "id").orderBy("c").collect()] == [None, "2", None]
    seeded = M.seed_missing(base.select("id", "name"), rows([("9", "b"), ("8", "new"), ("7", "new")], "id string, name string"), "name", "id")
    assert sorted((r.id, r.name) for r in seeded.collect()) == [("1", "a"), ("2", "b"), ("7", "new")]


def test_listing_rules(rows):
    schema = "nom_bateau string, constructeur string, longueur_m double, annee int, proprietaire string, capitaine string, localisation string, nombre_cabines int, prix_actuel string, prix_precedent string, dernier_message string, commentaire string"
    df = rows([("A", "B", 10.0, 2028, "p", "c", "l", None, None, None, None, None), ("", "B" * 51, 0.0, 1899, "p", "c", None, 0, "x" * 101, None, None, None)], schema)
    good, bad = R.split(R.with_errors(df, R.listing_rules(F.lit(2026))))
    assert good.count() == 1
    assert bad.first().errors == ["nom_bateau", "constructeur", "longueur_m", "annee", "localisation", "nombre_cabines", "prix_actuel"]
    assert R.with_errors(df, R.tracked_rules(F.lit(2026))).filter("size(errors) = 0").count() == 1
    emails = rows([("a@b.co",), ("",), (" ",), ("bad",), ("a..b@c.co",), (".a@c.co",)], "e string")
    assert [r.ok for r in emails.select(R.optional_email(F.col("e")).alias("ok")).collect()] == [True, True, True, False, False, False]


def document(id_, contact="", name=None, email="", office="O", **x):
    return json.dumps({"lead": {"id": id_, "source": "S"}, "contact": {"name": name or {}, "email": email},
                       "recipient": {"officeName": office, "officeId": "1", "contactName": contact}, **x})


def test_intake(rows, brokers):
    aliases = rows([("annie", "ann@two.example")], "alias_key string, email string")
    docs = rows([(1, document("A", "ANNIE", {"first": "F", "last": "L"})), (2, document("A", "Cy")), (3, document("B", "Ännie")),
                 (4, document("C", "cy@one.example")), (5, document("D", "Bob")), (6, document("E", office="")), (7, "{cut"),
                 (8, document("F", "CY", {"display": "Dis"})), (9, document("G", "Unknown"))], "ordinal int, value string")
    stored = rows([("G",)], "source_lead_id string")
    leads, bad = L.intake(docs, stored, brokers, aliases, now(), ("one.example", "two.example"))
    got = {r.source_lead_id: (r.broker_id, r.contact_display_name, r.processed_at is not None) for r in leads.collect()}
    assert got == {"A": ("1", "F L", True), "B": ("1", "Unknown Contact", True), "C": ("4", "Unknown Contact", True),
                   "D": (None, "Unknown Contact", False), "F": ("4", "Dis", True)}
    assert {r.ordinal: r.errors for r in bad.collect()}[6] == ["recipient.officeName"] and bad.count() == 2
    # the stored batch changes nothing the second time
    again, _ = L.intake(docs, leads.select("source_lead_id").union(stored), brokers, aliases, now())
    assert again.count() == 0


def test_funnel(rows, brokers):
    leads = rows([("1", "NEW", "2024-01-01"), ("1", "CONVERTED", "2024-03-01"), ("1", "LOST", "2024-02-01"), (None, "NEW", "2024-01-05")],
                 "broker_id string, status string, received_at string")
    stats = L.funnel(leads)
    assert stats.filter("broker_id is null").first().total_leads == 1
    out = {r.broker_id: r for r in L.zero_filled(brokers, stats).withColumn(
        "rate", L.conversion_rate(F.col("converted_leads"), F.col("total_leads"))).collect()}
    assert (out["1"].total_leads, out["1"].rate, out["1"].latest_lead_date) == (3, 33.3, "2024-03-01")
    assert (out["2"].total_leads, out["2"].rate, out["2"].latest_lead_date) == (0, 0.0, None)


def test_test_rows_are_dropped(rows):
    df = rows([("test-1", "a", "b"), ("1", "test@example.com", "b"), ("2", None, "Test Client"), ("3", None, None)], "id string, e string, n string")
    assert ids(L.without_test_rows(df, "id", "e", "n")) == ["3"]


def test_attempts(rows):
    schema = "id int, lead_id string, status string, created_at string, requested_at string, report string"
    data = rows([(1, "A", "completed", "1", "1", '{"identity_resolution": {"status": "probable", "confidence_score": 75}, "sources": [{}, {}]}'),
                 (2, "A", "pending", "1", "5", None), (3, "B", "pending", "2", "4", None)], schema)
    latest = A.latest(data)
    assert sorted((r.lead_id, r.id) for r in latest.collect()) == [("A", 2), ("B", 3)]
    first = A.latest(data.filter("id = 1"))
    r = L.with_latest_screening(rows([("A",), ("Z",)], "id string"), first).orderBy("id").collect()
    assert (r[0].confidence_score, r[0].source_count, r[0].key_reasons) == (75.0, 2, []) and r[1].kyc_status is None
    assert [x.id for x in A.queue_head(data).collect()] == [3, 2]
    asked = rows([("A", 1), ("C", 3), ("C", 2)], "lead_id string, o int")
    assert [(x.lead_id, x.o) for x in A.guard_one_active(asked, data, "o").collect()] == [("C", 2)]
    queued = A.enqueue(rows([("1", "N", "e@x.co", None), ("2", " ", "e", "FR")], "id string, contact_display_name string, contact_email string, contact_country string"), now())
    assert [(q.status, q.query_input.country, q.completed_at is None) for q in queued.orderBy("lead_id").collect()] == [("pending", "", True), ("insufficient_data", "FR", False)]


def test_stale_recovery(rows):
    df = rows([(1, "running", "2026-01-01 00:00:00", 1), (2, "running", "2026-01-01 00:00:00", 3), (3, "running", "2026-01-01 00:50:00", 1), (4, "pending", None, 0)],
              "id int, status string, started string, retry_count int")
    df = df.select("id", "status", F.col("started").cast("timestamp").alias("started_at"), "retry_count", F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error_code"))
    out = A.recover_stale(df, F.lit("2026-01-01 01:00:00").cast("timestamp")).orderBy("id").collect()
    assert [(r.status, r.recovered, r.error_code is not None, r.completed_at is not None) for r in out] == [
        ("pending", True, True, False), ("failed", True, True, True), ("running", False, False, False), ("pending", False, False, False)]


def test_listing_csv(rows, spark, brokers, tmp_path):
    path = tmp_path / "boats.csv"
    path.write_text("Nom du Bateau,Constructeur,Longueur (M/pieds),Année,Broker,Propriétaire,Capitaine,Localisation,Prix Actuel (€/$),Prix Précédent (€/$),Dernier message,Commentaire\n"
                    'One,Maker,"12,5",2010.0,Ann,,N/A,Nice,1M€,N/A,,\nTwo,,1,2,Ann,,,,,,,\nThree,Maker,0,x,Zed,o,c,l,,,,"a, b"\n')
    raw = files.read_listing_csv(spark, str(path), multi_line=True)
    out = {r.nom_bateau: r for r in files.import_listings(raw, brokers).collect()}
    assert (float(out["One"].longueur_m), out["One"].annee, out["One"].broker_id, out["One"].capitaine, out["One"].prix_precedent) == (12.5, 2010, "1", "N/A", None)
    assert out["Two"].outcome == "skipped" and out["Three"].outcome == "imported" and out["Three"].broker_id is None
    assert out["Three"].longueur_m is None and out["Three"].commentaire == "a, b"
    strict = files.import_listings(raw, brokers, on_unknown="reject")
    assert {r.outcome: r.n for r in R.outcome_counts(strict, "outcome").collect()} == {"imported": 2, "rejected": 1}


def test_json_export_and_import(rows, spark, tmp_path):
    df = rows([("r1", "Boat", "Maker", "2024-01-01T00:00:00.000Z")], "id string, a string, b string, created string").toDF(
        "id", "Nom du Bateau", "Constructeur", "created")
    files.write_export(df, str(tmp_path / "out"), "id", "created")
    back = files.read_export(spark, str(tmp_path / "out")).first()
    assert (back.external_id, back.nom_bateau, back.constructeur, back.created_at.year) == ("r1", "Boat", "Maker", 2024)


def test_reports_are_versioned(rows, spark, tmp_path):
    for version in ("1.0", "1.0", "2.0"):
        files.append_reports(rows([("A", "{}", version)], "lead_id string, report string, schema_version string"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("schema_version").count().count() == 2
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3


def test_result_bodies(rows):
    html = ("<a class='result__a' href='https://a.example/1'>A &amp; <b>b</b></a><div class=\"result__snippet\">snip</div>"
            "<a class=result-link href=https://b.example/>B</a><a href='https://plain.example/'>no</a>"
            "<a class='x result__a' href='http://127.0.0.1/'>bad</a><a class='result__a' href='https://a.example/1/'>dup</a><td class='result-snippet'>late</td>")
    rss = "<rss><channel><item><title><![CDATA[T]]></title><link>https://n.example/x</link><description>&lt;p&gt;d&lt;/p&gt;</description></item></channel></rss>"
    feed = json.dumps(["q", ["T1", "T2"], ["D1", ""], ["https://w.example/1", "http://localhost/"]])
    df = rows([(1, "html", html), (2, "rss", rss), (3, "json", feed)], "id int, format string, body string")
    out = [(r.id, r.url, r.title, r.snippet) for r in bodies.search_hits(df, ["id"]).orderBy("id", "position").collect()]
    assert out == [(1, "https://a.example/1", "A & b", "snip"), (1, "https://b.example", "B", ""),
                   (2, "https://n.example/x", "T", "d"), (3, "https://w.example/1", "T1", "D1")]
    hits = rows([("Jane Doe", "", "https://x.example", '"jané doe" x'), ("Other", "", "https://y.example", '"jane doe"')], "title string, snippet string, url string, query string")
    assert [r.url for r in bodies.matching_hits(hits, "query").collect()] == ["https://x.example"]


def test_manual_leads(rows):
    df = rows([(1, None, "Call", "N"), (2, "Fair", None, "M")], "ordinal int, source string, request_type string, contact_display_name string")
    out = L.manual_leads(df, F.lit("7"), now()).orderBy("ordinal").collect()
    assert [(r.source, r.request_type, r.broker_id, r.status) for r in out] == [("Manual", "Call", "7", "NEW"), ("Fair", "Manual", "7", "NEW")]
    assert out[0].source_lead_id.startswith("MANUAL-") and out[0].source_lead_id != out[1].source_lead_id
