import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from keelson.functions import markup, money, text, urls

PRICES = [  # text, strict, corrected
    ("1.050M€", 1050000.0, 1050000.0), ("1,5M €", 5000000.0, 1500000.0),
    ("499K€ Ex VAT", 499.0, 499000.0), ("1,850,000 €", 1850000.0, 1850000.0),
    ("1.850.000,50", 1850000.5, 1850000.5), ("1850,50", 1850.5, 1850.5),
    ("$2,500,000", 2500000.0, 2500000.0), ("750000", 750000.0, 750000.0),
    ("POA", None, None), ("", None, None), (None, None, None),
    ("1,850,000.50", 1850000.5, 1850000.5), ("1.850,5000", 1850.5, 1850.5), ("1,2,3", 123.0, 123.0),
]


@pytest.mark.parametrize("mode", ["strict", "corrected"])
def test_price_texts(rows, mode):
    df = rows([(i, p[0]) for i, p in enumerate(PRICES)], "i int, p string")
    got = [r.v for r in money.with_price(df, "p", "v", mode).orderBy("i").collect()]
    assert got == [p[1 if mode == "strict" else 2] for p in PRICES]


def test_length_and_year_texts(rows):
    df = rows([("12,5",), ("0",), ("N/A",), (None,), (" 8.2 m",)], "t string")
    out = df.select(money.parse_length(F.col("t")).alias("l"), money.parse_year(F.col("t")).alias("y")).collect()
    assert [r.l for r in out] == [12.5, None, None, None, 8.2]
    assert [r.y for r in out] == [12, None, None, None, 8]
    value, bad = money.form_number(F.col("t"))
    out = df.select(value.alias("v"), bad.alias("b")).collect()
    assert [(r.v, r.b) for r in out] == [(12.5, False), (0.0, False), (None, True), (None, False), (None, True)]


def python_fold(value, variant):
    form, keep = text.FOLD_VARIANTS[variant]
    out = value.casefold() if form == "NFKD" else value.lower()
    if form:
        out = "".join(c for c in unicodedata.normalize(form, out) if not unicodedata.combining(c))
    if keep is None:
        return out
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" + keep else " " for c in out).split())


def alphabet(variant):
    """ASCII, accented and ligature letters; for the compatible forms those that stay Latin letters."""
    chars = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0x300, 0x301, 0xFB01, 0xFF11]]

    def letters(c):
        return "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))

    if variant == "evidence":
        chars = [c for c in chars if len(letters(c)) <= 1 or letters(c).isascii()]
    if variant == "marks":
        chars = [c for c in chars if letters(c).isascii()]
    return chars


@pytest.mark.parametrize("variant", list(text.FOLD_VARIANTS))
def test_fold_equals_unicode_rule(rows, variant):
    rng = random.Random(5)
    chars = alphabet(variant)
    values = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(300)] + ["Straße ﬁn", "", "  A-b@C.d "]
    df = rows([(i, v) for i, v in enumerate(values)], "i int, t string")
    out = df.select(
        "i", text.fold(F.col("t"), variant).alias("f"), text.fold_arrow(variant)(F.col("t")).alias("a")).orderBy("i").collect()
    wrong = [(v, r.f, python_fold(v, variant)) for v, r in zip(values, out) if r.f != python_fold(v, variant)]
    assert not wrong, wrong[:2]


def test_text_helpers(rows):
    df = rows([(" Marie  Anne Curie ",), ("x",), (None,)], "t string")
    out = df.select(text.initials(F.col("t")).alias("i"), text.truncate(F.col("t"), 4).alias("s"),
                    text.squeeze(F.col("t")).alias("q")).collect()
    assert [r.q for r in out] == ["Marie Anne Curie", "x", None]
    assert out[1].i == "X" and out[1].s == "x" and out[0].s == " Mar..."
    out = rows([(1234567.5,)], "n double").select(
        text.format_fr(F.col("n"), 2).alias("a"), text.format_fr(F.col("n"), 2, flexible=True).alias("b"),
        text.metres_to_feet(F.lit(10.0)).alias("f"), text.feet_to_metres(F.lit(32.8084)).alias("m")).first()
    assert (out.a, out.b) == ("1 234 567,50", "1 234 567,5")
    assert round(out.f, 4) == 32.8084 and round(out.m, 4) == 10


def test_redaction(rows):
    df = rows([("call\n failed api_key: abc Authorization=Bearer zzz token : t1 end",), ("x " * 400,)], "t string")
    out = [r.t for r in df.select(text.redact(F.col("t")).alias("t")).collect()]
    assert out[0] == "call failed api_key=[redacted] Authorization=[redacted] token=[redacted] end"
    assert len(out[1]) == 500


def test_email_domains(rows):
    cases = {"A@Corp.Example.": "corp.example", "a@b@c.com": "", "nobody": "", "x@host": "", "x@gmail.com": "gmail.com", None: ""}
    df = rows([(k,) for k in cases], "e string")
    assert [r.d for r in df.select(text.email_domain(F.col("e")).alias("d")).collect()] == list(cases.values())


def test_name_orders(rows):
    df = rows([("Jean de  Vries",), ("Solo",)], "n string")
    out = [r.o for r in df.select(text.name_orders(F.col("n")).alias("o")).collect()]
    assert [(o.first_name, o.last_name) for o in out[0]] == [("Jean", "de Vries"), ("de Vries", "Jean")]
    assert out[1] == []


def test_canonical_urls(rows):
    cases = {
        " HTTPS://It.LinkedIn.com:443//in//a/?": "https://www.linkedin.com/in/a",
        "http://Host.Example./p//q/?a=1#f": "http://host.example/p/q/?a=1",
        "http://u:p@x.example": "", "http://x.example:8080/a": "", "ftp://x.example": "", "not a url": "",
        "https://x.example/a;v=1?b": "https://x.example/a?b", "https://x.example": "https://x.example", None: "",
        "https://fr.linkedin.com/company/c": "https://fr.linkedin.com/company/c",
    }
    df = rows([(i, k) for i, k in enumerate(cases)], "i int, u string")
    out = urls.with_canonical(df, "u", "c").orderBy("i").collect()
    assert [r.c for r in out] == list(cases.values())


def test_unsafe_urls(rows):
    cases = {
        "https://ok.example/a": "https://ok.example/a", "http://127.0.0.1/": None, "http://10.1.2.3/x": None,
        "http://[::1]/": None, "http://localhost/": None, "http://box.local/": None, "https://2130706433/": None,
        "http://x.example:443/": None, "javascript:alert(1)": None,
        "//duckduckgo.com/l/?uddg=https%3A%2F%2Ftarget.example%2Fp&rut=1": "https://target.example/p",
        "https://duckduckgo.com/l/?uddg=http%3A%2F%2F192.168.0.1%2F": None, "https://duckduckgo.com/about": None,
    }
    df = rows([(i, k) for i, k in enumerate(cases)], "i int, u string")
    out = urls.with_safe(df, "u", "s").orderBy("i").collect()
    assert [r.s for r in out] == list(cases.values())


def test_source_types(rows):
    cases = {
        "https://fr.linkedin.com/in/x": "linkedin", "https://www.corp.example/": "company_website",
        "https://www.marinetraffic.com/": "maritime_db", "https://www.opensanctions.org/x": "pep_db",
        "https://www.gov.uk/sanctions": "sanctions_db", "https://www.gov.uk/other": "other",
        "https://find.companieshouse.gov.uk/": "official_registry", "https://court.example/": "court_record",
        "https://www.reuters.com/": "news", "https://blog.example/": "other",
    }
    df = urls.parse_url(rows([(i, k) for i, k in enumerate(cases)], "i int, u string"), "u", "p")
    out = df.select("i", urls.source_type(F.col("p"), F.lit("corp.example")).alias("t")).orderBy("i").collect()
    assert [r.t for r in out] == list(cases.values())


def test_html_to_text(rows):
    page = ("<html><head><title>A &amp; B</title><meta name='description' content='d &quot;q&quot;'>"
            "<style>p{}</style><script>var a='</p>';</script></head><body><p>caf&#233; &#8364;5&#65;</p> x&apos;y</body></html>")
    r = rows([(page,)], "h string").select(
        markup.html_title(F.col("h")).alias("t"), markup.html_description(F.col("h")).alias("d"),
        markup.visible_text(F.col("h")).alias("v")).first()
    assert (r.t, r.d, r.v) == ("A & B", 'd "q"', "A & B café €5A x'y")


def test_description_reads_attributes_in_any_order(rows):
    pages = ['<meta content="first" name="description">', "<META data-name='x' property = og:description content=plain>",
             '<meta name="author" content="no"><meta name=\'Description\' content=\'b "q"\'>',
             '<meta name="description" content=""><meta property="og:description" content="later">', "<p>none</p>"]
    got = rows([(i, p) for i, p in enumerate(pages)], "i int, h string").select(
        "i", markup.html_description(F.col("h")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == ["first", "plain", 'b "q"', "later", ""]
