"""Stored searches, global positions and VARIANT reads."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from keelson.operators import searches, variants
from keelson.operators.leads import PAYLOAD_COLUMNS
from keelson.plans.ordering import positions
from tests.test_plans import plan

LISTING = ("id long, nom_bateau string, constructeur string, longueur_m double, broker_id string, localisation string, "
           "etoile boolean, nombre_cabines int, prix_actuel string, search string, kind string")


def catalogue(r, n):
    words = ["Star", "sea", "Blue", "", "É", "a_b%", "x"]
    return [(i, r.choice([None, " ".join(r.choice(words) for _ in range(3))]), r.choice(words), r.choice([None, 0.0, r.uniform(0, 60), -3.0, 1e12]),
             r.choice(["1", "2", None]), r.choice(["Port Star", "sea", None]), r.choice([True, False, None]), r.choice([None, 0, 1, 2, 5]),
             r.choice(["1M", "2,5M €", "POA", "750K", None, "900"]), "clash", "clash") for i in range(n)]


PRICE = {"1M": 1e6, "2,5M €": 2.5e6, "750K": 750e3, "900": 900.0}


def found(s, row, names):
    sid, text, place, broker, min_l, max_l, min_p, max_p, min_c, max_c, starred = s
    _, name, builder, length, owner, location, star, cabins, price = row[:9]
    price = PRICE.get(price)
    has = lambda t, part: t is not None and part.lower() in t.lower()
    if text and not has(name, text) and not has(builder, text) or place and not has(location, place):
        return False
    if broker and broker.strip():
        ids = [i for i, n in names if n.lower() == broker.strip().lower()]
        if len(ids) != 1 or owner != ids[0]:
            return False
    for value, low, high in ((length, min_l, max_l), (price, min_p, max_p), (cabins, min_c, max_c)):
        if low and (value is None or value < low) or high and (value is None or value > high):
            return False
    return not ((min_c or max_c) and not cabins) and not (starred and not star)


def ask(r, i):
    def maybe(*values):
        return r.choice([None, None, *values])
    return (f"s{i}", maybe("sta", "a", "UE", "_b%", "é", "nothing", ""), maybe("Port", "se", "q"), maybe("Ann", " bob ", "Cy", "nobody", ""),
            maybe(0.0, 10.0, 30.5), maybe(0.0, 31.0, 5.0), maybe(0.0, 900.0, 800e3), maybe(1e6, 3e6), maybe(1, 2), maybe(0, 4), maybe(True, False))


SEARCH = ", ".join(f"{n} {t}" for n, t in searches.SEARCH.items())


def test_searches_equal_testing_every_pair(rows):
    r = random.Random(1)
    names = [("1", "Ann"), ("2", "Bob"), ("3", "cy"), ("4", "CY")]
    listed = catalogue(r, 150)
    asked = [ask(r, i) for i in range(120)] + [("none", *[None] * 10), ("star", *[None] * 9, True)]
    out = searches.match_searches(rows(asked, SEARCH), rows(listed, LISTING), rows(names, "id string, broker_name string"))
    want = sorted((s[0], row[0]) for s in asked for row in listed if found(s, row, names))
    assert sorted(map(tuple, out.collect())) == want and len(want) > 500
    text = plan(out)
    assert "NestedLoop" not in text and "Cartesian" not in text
    none = searches.match_searches(rows([], SEARCH), rows(listed, LISTING), rows(names, "id string, broker_name string"))
    assert none.count() == 0


def test_exploded_rows_are_not_broadcast(spark, rows, tmp_path):
    """Files small enough to broadcast by Spark's estimate; what is exploded from them is not."""
    r = random.Random(3)
    names = [("1", "Ann"), ("2", "Bob"), ("3", "cy"), ("4", "CY")]
    listed, asked = catalogue(r, 80), [ask(r, i) for i in range(60)]
    tables = []
    for name, data, schema in (("asked", asked, SEARCH), ("listed", listed, LISTING), ("names", names, "id string, broker_name string")):
        rows(data, schema).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    out = searches.match_searches(*tables)
    before = plan(out)
    assert sorted(map(tuple, out.collect())) == sorted((s[0], row[0]) for s in asked for row in listed if found(s, row, names))
    for text in (before, plan(out)):
        inside, generated = None, 0
        for line in text.splitlines():
            depth = re.match(r"[ :+-]*", line).end()
            if inside is None or depth <= inside:
                inside = depth if line[depth:].startswith("BroadcastExchange") else None
            generated += "Generate " in line
            assert inside is None or "Generate " not in line
        assert generated >= 3


def test_a_key_of_many_pairs_is_cut_into_tiles(rows, monkeypatch):
    """Searches without conditions meet all listings by one key; rows that repeat and a listing without an id count as often as they are there."""
    monkeypatch.setattr(searches, "SMALL", 1000, raising=False)
    monkeypatch.setattr(searches, "TILE", 20, raising=False)
    r = random.Random(4)
    names = [("1", "Ann"), ("2", "Bob"), ("3", "cy"), ("4", "CY")]
    listed = catalogue(r, 160)
    listed += [listed[7], (None, *listed[8][1:])]
    asked = [(f"all{i}", *[None] * 10) for i in range(100)] + [ask(r, i) for i in range(60)] + [("star", *[None] * 9, True)] * 2
    out = searches.match_searches(rows(asked, SEARCH), rows(listed, LISTING), rows(names, "id string, broker_name string"))
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert Counter((g[0], g[1]) for g in got) == Counter((s[0], row[0]) for s in asked for row in listed if found(s, row, names))
    tasks = Counter(g["task"] for g in got if g[0].startswith("all"))
    assert len(tasks) >= 4 and max(tasks.values()) < 0.6 * sum(tasks.values())


def test_listings_of_one_file_are_dealt_out_before_their_keys_are_made(spark, rows, tmp_path):
    r = random.Random(5)
    rows(catalogue(r, 80), LISTING).coalesce(1).write.parquet(f"{tmp_path}/listed")
    out = searches.match_searches(rows([ask(r, i) for i in range(30)], SEARCH), spark.read.parquet(f"{tmp_path}/listed"),
                                  rows([("1", "Ann")], "id string, broker_name string"))
    lines = plan(out).splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "nom_bateau" in line)
    deal = next(i for i, line in enumerate(lines) if "RoundRobinPartitioning" in line)
    keys = max(i for i, line in enumerate(lines[:scan]) if "Generate " in line)
    assert keys < deal < scan


def test_a_listing_sends_few_keys_that_no_search_has(spark):
    asked = spark.range(300).selectExpr("id * 7919 + 5 AS key")
    sent = spark.range(300 * 7919).withColumnRenamed("id", "key")
    kept = sent.filter(searches._marked(searches._marks(asked)))
    assert kept.join(asked, "key").count() == 300 and kept.count() < 0.01 * 300 * 7919
    every = spark.range(searches.BUCKETS * 20).withColumnRenamed("id", "key")  # all bits are set, that of the sign too
    assert every.filter(searches._marked(searches._marks(every))).count() == searches.BUCKETS * 20
    one = every.filter(f"{searches._BUCKET} = 127")  # the highest bit of a word alone
    assert one.filter(searches._marked(searches._marks(one))).count() == one.count() > 0
    assert sent.filter(searches._marked([])).count() == 0


def test_binary_intervals_cover_a_range_once(rows):
    r = random.Random(2)
    cases = [(0, 0), (5, 5), (1, 14), (0, (1 << 32) - 1), (7, 6)] + [tuple(sorted((r.randrange(5000), r.randrange(5000)))) for _ in range(40)]
    probes = sorted({x for a, b in cases for x in (a - 1, a, a + 1, b - 1, b, b + 1)} | set(range(0, 5000, 97)))
    covers = rows([(float(a), float(b)) for a, b in cases], "a double, b double").select(
        searches._cover(F.col("a"), F.col("b")).alias("c")).collect()
    holders = rows([(float(p),) for p in probes], "p double").select(searches._holding(F.col("p")).alias("h")).collect()
    for (a, b), cover in zip(cases, covers):
        assert len(cover["c"]) <= 66
        for p, holder in zip(probes, holders):
            inside = a <= min(max(p, 0), (1 << 32) - 1) <= b
            assert len(set(cover["c"]) & set(holder["h"])) == int(inside)


def test_positions_with_a_value_that_many_rows_share(spark):
    df = spark.range(60_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7.5 WHEN id % 17 = 0 THEN NULL ELSE CAST(id % 1000 AS DOUBLE) END AS price",
                                        "'x' AS `_place`")
    out = positions(df.drop("_place"), [("price", False), ("id", True)], partitions=16)
    got = out.orderBy("position").collect()
    want = sorted(((i, 7.5 if i % 3 == 0 else None if i % 17 == 0 else float(i % 1000)) for i in range(60_000)),
                  key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [(g["id"], g["price"]) for g in got] == want and [g["position"] for g in got] == list(range(1, 60_001))
    text = plan(out)
    assert "Window" not in text and "SinglePartition" not in text
    # the value many rows share lies in several files
    assert out.filter("price = 7.5").select(F.input_file_name()).distinct().count() >= 4
    assert positions(df.drop("_place").limit(0), [("id", True)]).count() == 0


def test_documents_are_parsed_once(rows):
    raw = rows([(1, '{"lead": {"id": 5, "date": ""}, "boat": {"year": "2001", "price": {"amount": "12.5"}}, "contact": {"name": {"last": "L"}}}', 9),
                (2, "{cut", 9), (3, None, 9), (4, "[1, 2]", 9), (5, "{}", 9)], "ordinal long, value string, source int")
    out = variants.lead_columns(raw, F.lit("2026-01-01").cast("timestamp"), keep=("ordinal",), types=variants.TYPED)
    assert plan(out).count("parseJson") == 1 and len(out.columns) == len(PAYLOAD_COLUMNS) + 5 + 1
    got = {r["ordinal"]: r for r in out.collect()}
    assert (got[1]["source_lead_id"], got[1]["boat_year"], float(got[1]["boat_price_amount"]), got[1]["contact_display_name"]) == ("5", 2001, 12.5, "L")
    assert all(got[i]["source_lead_id"] is None and got[i]["contact_display_name"] == "Unknown Contact" and got[i]["lead_date"] for i in (2, 3, 4, 5))
    reports = variants.report_columns(rows([("a", '{"pep": 1}')], "id string, report string"))
    assert plan(reports).count("parseJson") == 1 and reports.first()["pep_status"] is None
