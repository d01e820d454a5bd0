"""Evidence jobs on pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..functions import vocab as V
from ..functions.text import email_domain, fold, is_free_mail, redact
from ..functions.urls import canonical, parse_url, source_type, source_type_short, with_safe
from ..operators import evidence as E
from ..plans.barrier import filter_computed
from ..sources import bodies
from . import roles
from .roles import (
    dealt,
    EVIDENCE_DOCS_SQL, EVIDENCE_SCORED_SQL, CUSTOMER_EMAIL, q, sql_any, sql_domain,
    sql_fold, sql_host, sql_list, sql_path, sql_source_type, table,
)

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


# page URLs in several spellings; the odd ones are unusable
RAW_URL = (
    "CASE page_id % 8 WHEN 0 THEN concat(' ', replace(url, '.example', '.Example'), '/') "
    "WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN concat(url, '#x') "
    "WHEN 3 THEN replace(replace(url, '.example.com/', '.example.com:443//'), '.example.org/', '.example.org:8080/') "
    "WHEN 4 THEN concat('https://fr.linkedin.com/in/p', cast(page_id AS VARCHAR(20)), '/') "
    "WHEN 5 THEN concat('http://10.0.0.', cast(page_id % 250 AS VARCHAR(20)), '/a') "
    "WHEN 6 THEN concat('https://duckduckgo.com/l/?rut=1&uddg=', replace(replace(url, ':', '%3A'), '/', '%2F')) "
    "ELSE url END"
)
_SPLIT = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#]*)@)?([^:/?#@]*)(?::([^/?#@]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$'"


def _canonical(u: str) -> str:
    def part(i):
        return f"regexp_extract(trim({u}), {_SPLIT}, {i})"
    host = f"rtrim(lower({part(3)}), '.')"
    path = (f"regexp_replace(concat('/', ltrim(regexp_replace({part(5)}, ';[^/]*$', ''), '/')), '/{{2,}}', '/', 'g')")
    host = f"CASE WHEN ends_with({host}, '.linkedin.com') AND starts_with({path}, '/in/') THEN 'www.linkedin.com' ELSE {host} END"
    return f"""CASE WHEN lower({part(1)}) IN ('http', 'https') AND {part(3)} <> '' AND {part(4)} IN ('', '80', '443')
      AND NOT regexp_matches({part(2)}, '[^:]')
      THEN rtrim(concat(lower({part(1)}), '://', {host}, {path}, CASE WHEN {part(6)} = '?' THEN '' ELSE {part(6)} END), '/') ELSE '' END"""


def raw_pages(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", "page_id % 20 AS lead_id", f"{RAW_URL} AS raw")


_PAGES = f"WITH p AS (SELECT page_id, page_id % 20 AS lead_id, {RAW_URL} AS raw FROM pages)"
_UNSAFE_HOST = r"(regexp_matches(h, '(^|\.)(\d+|0x[0-9a-f]*)$') OR h = 'localhost' OR ends_with(h, '.local') OR h = '')"


@query("canonical_urls", f"{_PAGES} SELECT page_id, {_canonical('raw')} AS canonical_url FROM p")
def canonical_urls(spark, sf):
    return parse_url(raw_pages(spark, sf), "raw").select("page_id", canonical(F.col("u")).alias("canonical_url"))


@query("url_safety", f"""{_PAGES},
s AS (SELECT page_id, CASE WHEN contains(raw, 'duckduckgo.com') THEN replace(replace(regexp_extract(raw, 'uddg=([^&]*)', 1), '%3A', ':'), '%2F', '/') ELSE raw END AS u FROM p)
SELECT page_id, CASE WHEN {_UNSAFE_HOST} OR (contains(u, '://') AND regexp_matches(trim(u), '^http://[^/]*:443')) THEN NULL ELSE nullif(c, '') END AS safe_url
FROM (SELECT page_id, u, {sql_host('trim(u)')} AS h, {_canonical('u')} AS c FROM s)""")
def url_safety(spark, sf):
    return with_safe(raw_pages(spark, sf), "raw", "safe_url").select("page_id", "safe_url")


_HOST = sql_host("url")


@query("host_cap", f"""
WITH p AS (SELECT page_id % 20 AS lead_id, page_id, url, lower(url) AS k FROM pages),
d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY lead_id, k ORDER BY page_id) = 1),
b AS (SELECT *, list_aggregate(list_slice(string_split({_HOST}, '.'), -2, -1), 'string_agg', '.') AS host_bucket FROM d),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lead_id, host_bucket ORDER BY page_id) <= 2)
SELECT lead_id, page_id, host_bucket, row_number() OVER (PARTITION BY lead_id ORDER BY page_id) AS rank FROM c
QUALIFY rank <= 4""")
def host_cap(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("page_id % 20 AS lead_id", "page_id", "url")
    out = E.diverse_hosts(pages, ["lead_id"], "url", "page_id", limit=4, per_host=2)
    return out.select("lead_id", "page_id", "host_bucket", "rank")


_OWN = "CASE page_id % 20 % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.org' ELSE '' END"


@query("own_domain_first", f"""
WITH p AS (SELECT page_id % 20 AS lead_id, page_id, {_HOST} AS h, {_OWN} AS d FROM pages)
SELECT lead_id, page_id, (d <> '' AND (h = d OR ends_with(h, concat('.', d)))) AS is_own,
  row_number() OVER (PARTITION BY lead_id ORDER BY (d <> '' AND (h = d OR ends_with(h, concat('.', d)))) DESC, page_id) AS rank
FROM p QUALIFY rank <= 5""")
def own_domain_first(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("page_id % 20 AS lead_id", "page_id", "url", f"{_OWN} AS own")
    return E.own_domain_first(pages, ["lead_id"], "url", F.col("own"), "page_id").select(
        "lead_id", "page_id", "is_own", "rank")


_TYPED_URL = roles.DOCUMENT_URL.replace("doc_id", "page_id").replace("concat(source, '.example.org/')", "concat('press.', CASE page_id % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'x' ELSE 'court' END, '.org/')")


@query("source_types", f"""
WITH p AS (SELECT page_id, {sql_host(_TYPED_URL)} AS h, {sql_path(_TYPED_URL)} AS p FROM pages)
SELECT page_id, {sql_source_type('h', 'p', "'mail5.example.com'")} AS full_type,
  CASE WHEN ends_with(h, '.mail5.example.com') THEN 'company_website' WHEN contains(h, 'linkedin.com') THEN 'linkedin'
    WHEN contains(h, 'sanction') OR contains(h, 'ofac') OR contains(h, 'europa.eu') THEN 'sanctions_db'
    WHEN contains(h, 'company') OR contains(h, 'registry') OR contains(h, 'registre') THEN 'official_registry'
    WHEN contains(h, 'news') OR contains(h, 'press') OR contains(h, 'reuters') THEN 'news' ELSE 'other' END AS short_type FROM p""")
def source_types(spark, sf):
    pages = parse_url(table(spark, sf, "pages").selectExpr("page_id", f"{_TYPED_URL} AS link"), "link")
    own = F.lit("mail5.example.com")
    return pages.select("page_id", source_type(F.col("u"), own).alias("full_type"),
                        source_type_short(F.col("u"), own).alias("short_type"))


def sql_decode(expr: str) -> str:
    out = f"regexp_replace({expr}, '<[^>]*>', ' ', 'g')"
    for pattern, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"regexp_replace({out}, {q(pattern)}, {q(char)}, 'gi')"
    return f"trim(regexp_replace({out}, '[{V.WHITESPACE}]+', ' ', 'g'), '{V.WHITESPACE}')"


@query("outlinks", f"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*>[\\s\\S]*?</a>')) AS a,
  generate_subscripts(regexp_extract_all(html, '(?i)<a\\b[^>]*>[\\s\\S]*?</a>'), 1) AS i FROM pages)
SELECT page_id, CAST(i - 1 AS INT) AS position, {sql_decode("regexp_extract(a, '(?i)href=\"([^\"]*)\"', 1)")} AS href,
  {sql_decode("regexp_extract(a, '(?i)<a\\b[^>]*>([\\s\\S]*?)</a>', 1)")} AS title FROM a""")
def outlinks(spark, sf):
    pages = dealt(spark, sf, "pages").select("page_id", "html")
    return bodies.anchors(pages, "html", ["page_id"], bodies.ANY_ANCHOR).select(
        "page_id", "position", "href", markup.decode_html(F.col("title_html")).alias("title"))


@query("html_text", f"""
WITH t AS (SELECT page_id, {sql_decode("regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1)")} AS title,
  {sql_decode("regexp_replace(regexp_replace(html, '<script[\\s\\S]*?</script>', ' ', 'gi'), '<style[\\s\\S]*?</style>', ' ', 'gi')")} AS body FROM pages)
SELECT page_id, title, body, length(body) AS chars FROM t WHERE length(body) >= 80""")
def html_text(spark, sf):
    out = dealt(spark, sf, "pages").select(
        "page_id", markup.html_title(F.col("html"), None).alias("title"),
        markup.visible_text(F.col("html"), None).alias("body"))
    return filter_computed(out.withColumn("chars", F.length("body")), F.col("chars") >= 80)


# the description is named by either of two attributes, before or after its content; some pages have an empty one first
_META = (
    """CASE page_id % 4 WHEN 0 THEN concat('<meta name="description" content="', about, '">') """
    """WHEN 1 THEN concat('<META content=', chr(39), about, chr(39), ' property=og:description>') """
    """WHEN 2 THEN concat('<meta name="description" content=""><meta property="og:description" content="', about, '">') ELSE '' END""")


@query("page_description", """
SELECT page_id, CASE WHEN page_id % 4 < 3 THEN concat('About "', regexp_extract(html, 'lang="([a-z]+)"', 1), '" & page ', page_id, ' <b>') ELSE '' END AS description
FROM pages""")
def page_description(spark, sf):
    pages = dealt(spark, sf, "pages").withColumn("about", F.concat(
        F.lit("About &quot;"), F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("&quot; &amp; page "),
        F.col("page_id").cast("string"), F.lit(" &lt;b&gt;")))
    named = pages.withColumn("html", F.replace("html", F.lit('<meta charset="utf-8">'), F.concat(
        F.lit('<meta charset="utf-8">'), F.expr(_META))))
    return named.select("page_id", markup.html_description(F.col("html")).alias("description"))


# pages re-cut as result bodies of the three formats; in each, the links of the page are hits
_TITLE_RE = r"<title[^>]*>([^<]*)</title>"
_NAV_RE = r'<a href="(/[^"]*)"[^>]*>([\s\S]*?)</a>'


def result_bodies(spark, sf):
    pages = dealt(spark, sf, "pages")
    title = F.regexp_extract("html", _TITLE_RE, 1)
    link = F.concat(F.lit("https://site"), (F.col("page_id") % 9).cast("string"), F.lit(".example/"), F.col("page_id").cast("string"))
    html = F.concat(
        F.regexp_replace("html", '<a href="/', '<a class="x result__a" href="https://nav.example/'),
        F.lit('<a class="other" href="https://no.example">no</a><a class="result-link" href="//localhost/x">bad</a><a class=\'result__a\' href="'),
        link, F.lit('">'), title, F.lit('</a><td class="result-snippet">snip '), title, F.lit("</td>"))
    hrefs, names = (F.transform(F.regexp_extract_all("html", F.lit(_NAV_RE), F.lit(i)), to) for i, to in (
        (1, lambda h: F.concat(F.lit("https://nav.example"), h)), (2, lambda t: t)))
    json = F.to_json(F.array(
        F.array(F.lit("q")), F.concat(names, F.array(title, F.lit("B"))),
        F.concat(F.transform(names, lambda _, i: F.concat(F.lit("d"), i.cast("string"))), F.array(F.lit("own"), F.lit("d2"))),
        F.concat(F.transform(hrefs, markup.decode_html), F.array(link, F.lit("http://127.0.0.1/")))))
    json = F.regexp_replace(json, r'^\[\["q"\]', '["q"')

    def item(name, href, text):
        return F.concat(F.lit("<item><title><![CDATA["), name, F.lit("]]></title><link>"), href, F.lit("</link><description>"),
                        text, F.lit("</description></item>"))

    items = F.transform(F.arrays_zip(names.alias("name"), hrefs.alias("href")), lambda x, i: item(
        x["name"], x["href"], F.concat(F.lit("&lt;b&gt;desc&lt;/b&gt; "), i.cast("string"))))
    rss = F.concat(F.lit("<rss><channel>"), F.array_join(items, "\n"), item(title, link, F.lit("&lt;b&gt;desc&lt;/b&gt; own")),
                   F.lit("<item><title>dup</title><link>"), link, F.lit("/</link></item></channel></rss>"))
    kind = F.when(F.col("page_id") % 3 == 0, "html").when(F.col("page_id") % 3 == 1, "json").otherwise("rss")
    return pages.select("page_id", kind.alias("format"),
                        F.when(kind == "html", html).when(kind == "json", json).otherwise(rss).alias("body"))


_T = sql_decode(f"regexp_extract(html, '{_TITLE_RE}', 1)")
# an RSS title is read from between CDATA marks, so the tag rule sees the same text
_LINK = "concat('https://site', CAST(page_id % 9 AS VARCHAR), '.example/', CAST(page_id AS VARCHAR))"
_NAV_URL = f"rtrim(concat('https://nav.example', {sql_decode('h')}), '/')"


@query("search_hits", f"""
WITH nav AS (SELECT page_id, unnest(regexp_extract_all(html, '{_NAV_RE}', 1)) AS h, unnest(regexp_extract_all(html, '{_NAV_RE}', 2)) AS t,
    generate_subscripts(regexp_extract_all(html, '{_NAV_RE}', 0), 1) - 1 AS position FROM pages),
hits AS (SELECT page_id, {_NAV_URL} AS url, {sql_decode('t')} AS title,
    CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('d', position) ELSE concat('desc ', position) END AS snippet FROM nav
  QUALIFY row_number() OVER (PARTITION BY page_id, {_NAV_URL} ORDER BY position) = 1),
own AS (SELECT page_id, html, {_LINK} AS url, {_T} AS title,
   trim(concat('snip ', {_T})) AS snip FROM pages)
SELECT page_id, url, title, snippet FROM hits
UNION ALL SELECT page_id, url, title, CASE page_id % 3 WHEN 0 THEN snip WHEN 1 THEN 'own' ELSE 'desc own' END FROM own""")
def search_hits(spark, sf):
    return bodies.search_hits(
        result_bodies(spark, sf), ["page_id"], window=None, title=None, snippet=None).select("page_id", "url", "title", "snippet")


# --- hits ------------------------------------------------------------------------------

_HIT_URL = (
    "CASE page_id % 9 WHEN 0 THEN concat('https://search.brave.com/', cast(page_id AS VARCHAR(20))) "
    "WHEN 1 THEN concat('https://www.youtube.com/', cast(page_id AS VARCHAR(20))) WHEN 2 THEN concat(split_part(url, '?', 1), '.pdf') WHEN 3 THEN concat('https://shared.example/', CAST(page_id % 3 AS VARCHAR(9))) ELSE url END")
_WORDS = (
    "concat(CASE WHEN page_id % 2 = 0 THEN 'Yacht charter ' ELSE '' END, CASE WHEN page_id % 3 = 0 THEN 'Founder of ' ELSE '' END, "
    "CASE WHEN page_id % 5 = 0 THEN 'Fleet logistics ' ELSE '' END, CASE WHEN page_id % 7 = 0 THEN 'music album ' ELSE '' END, "
    "CASE WHEN page_id % 4 = 3 THEN 'Somebody' ELSE 'Jänë Doe' END)")


@query("hit_ranking", f"""
WITH h AS (SELECT page_id, page_id % 20 AS lead_id, {_HIT_URL} AS url, {_WORDS} AS title FROM pages),
c AS (SELECT *, {_canonical('url')} AS cu, {sql_host('url')} AS host,
  {sql_fold("concat_ws(' ', title, title, url)")} AS lab FROM h),
s AS (SELECT lead_id, page_id, cu AS canonical_url,
  CASE WHEN {sql_any('lab', V.HIT_SECTOR)} THEN 12 ELSE 0 END + CASE WHEN {sql_any('lab', V.HIT_BUSINESS)} THEN 8 ELSE 0 END
  + CASE WHEN {sql_any('lab', V.HIT_ROLE)} THEN 5 ELSE 0 END - CASE WHEN {sql_any('lab', V.HIT_MUSIC)} THEN 8 ELSE 0 END AS score
  FROM c WHERE cu <> '' AND host <> 'search.brave.com' AND NOT ends_with(host, '.brave.com') AND NOT starts_with(host, 'imgs.')
   AND NOT {sql_any('host', V.HIT_MEDIA_HOSTS)} AND NOT regexp_matches(lower(split_part(cu, '?', 1)), '(\\.jpg|\\.jpeg|\\.png|\\.gif|\\.svg|\\.webp|\\.pdf)$')
   AND contains(lab, 'jane doe')),
shown AS (SELECT lead_id, cu AS canonical_url, arg_max(title, page_id) AS title FROM c WHERE cu <> '' GROUP BY ALL),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lead_id, lower(canonical_url) ORDER BY score DESC, page_id) = 1)
SELECT d.lead_id, page_id, canonical_url, score, row_number() OVER (PARTITION BY d.lead_id ORDER BY score DESC, page_id) AS rank,
  trim(title) AS title, trim(title) AS content FROM d JOIN shown USING (lead_id, canonical_url) QUALIFY rank <= 8""")
def hit_ranking(spark, sf):
    hits = table(spark, sf, "pages").selectExpr(
        "page_id AS ordinal", "page_id % 20 AS lead_id", f"{_HIT_URL} AS url", f"{_WORDS} AS title", f"{_WORDS} AS content",
        "'Jane Doe' AS wanted")
    out = E.rank_hits(hits, 8, required_name="wanted")
    return out.select("lead_id", F.col("ordinal").alias("page_id"), "canonical_url", "score", "rank", "title", "content")


# --- texts -----------------------------------------------------------------------------


@query("text_fold", f"""
SELECT doc_id, {', '.join(f"md5({sql_fold('text', v)}) AS {v}" for v in ('evidence', 'builder', 'recipient', 'plain', 'marks'))} FROM documents""")
def text_fold(spark, sf):
    return dealt(spark, sf, "documents").select(
        "doc_id", *[F.md5(fold(F.col("text"), v)).alias(v) for v in ("evidence", "builder", "recipient", "plain", "marks")])


@query("email_domains", f"""
WITH m AS (SELECT doc_id, e FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q('[^ ]*@[^ ]*')})) AS e FROM documents)),
c AS (SELECT {CUSTOMER_EMAIL} AS e FROM customer),
d AS (SELECT {sql_domain('e')} AS domain FROM m UNION ALL SELECT {sql_domain('e')} FROM c)
SELECT domain, domain IN {sql_list(V.FREE_MAIL_FULL)} AS free_full, domain IN {sql_list(V.FREE_MAIL_SHORT)} AS free_short, count(*) AS n FROM d GROUP BY domain""")
def email_domains(spark, sf):
    found = dealt(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit("[^ ]*@[^ ]*"), F.lit(0))).alias("e"))
    both = found.unionByName(table(spark, sf, "customer").selectExpr(f"{CUSTOMER_EMAIL} AS e"))
    counts = both.select(email_domain(F.col("e")).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("domain", is_free_mail(F.col("domain"), V.FREE_MAIL_FULL).alias("free_full"),
                         is_free_mail(F.col("domain"), V.FREE_MAIL_SHORT).alias("free_short"), "n")


@query("redact", f"""
SELECT doc_id, md5(regexp_replace(trim(regexp_replace(text, '[{V.WHITESPACE}]+', ' ', 'g'), '{V.WHITESPACE}'),
  {q(V.SECRET_PATTERN)}, '\\1=[redacted]', 'g')) AS redacted FROM documents""")
def redact_texts(spark, sf):
    return dealt(spark, sf, "documents").select("doc_id", F.md5(redact(F.col("text"), None)).alias("redacted"))


_LINES = "string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}]')"


def _bare(x):
    return f"trim(regexp_replace({x}, '^[#>*_`\\s\\-]+', ''), '{V.WHITESPACE}')"


@query("headlines", f"""
WITH l AS (SELECT doc_id, lang, list_transform(list_slice({_LINES}, 1, 30), lambda x: {_bare('x')}) AS h,
  list_transform(list_slice({_LINES}, 1, 20), lambda x: regexp_replace({_bare('x')}, '[{V.WHITESPACE}]+', ' ', 'g')) AS s FROM documents),
k AS (SELECT doc_id, lang, list_filter(h, lambda x: length(x) BETWEEN 8 AND 180 AND NOT regexp_matches(lower(x), '^(cookie|javascript)')) AS h,
  list_filter(s, lambda x: length(x) BETWEEN 8 AND 350 AND NOT regexp_matches(lower(x), '^(cookie|javascript|your cart|we noticed that you are using)')) AS s FROM l)
SELECT doc_id, coalesce(h[1], '') AS headline,
  left(rtrim(coalesce(list_filter(s, lambda x: {sql_any('lower(x)', V.ROLE_LINE_TERMS)})[1], CASE WHEN lang = 'fr' THEN s[1] END, ''), ' .'), 280) AS statement FROM k""")
def headlines(spark, sf):
    docs = dealt(spark, sf, "documents")
    kind = F.when(F.col("lang") == "fr", "linkedin").otherwise("other")
    return docs.select("doc_id", E.headline(F.col("text")).alias("headline"), E.statement(F.col("text"), kind).alias("statement"))


# --- scoring ---------------------------------------------------------------------------


def scored(spark, sf, keep_text=False):
    leads = roles.evidence_leads(spark, sf)
    return E.score_evidence(roles.untyped_documents(spark, sf), leads, keep_text=keep_text)


@query("evidence_score", f"WITH {EVIDENCE_SCORED_SQL} SELECT lead_id, ordinal, source_type, score, signals FROM ev_scored")
def evidence_score(spark, sf):
    return scored(spark, sf).select("lead_id", "ordinal", "source_type", "score", F.array_join("signals", ", ").alias("signals"))


@query("evidence_rank", f"""WITH {EVIDENCE_SCORED_SQL}
SELECT lead_id, ordinal, score, row_number() OVER (PARTITION BY lead_id ORDER BY score DESC, ordinal) AS rank FROM ev_scored WHERE score >= 20""")
def evidence_rank(spark, sf):
    return E.rank_evidence(scored(spark, sf)).select("lead_id", "ordinal", "score", "rank")


@query("evidence_volume", f"""WITH {EVIDENCE_DOCS_SQL}
SELECT lead_id, count(*) AS documents, sum(length(text)) AS chars, coalesce(sum(length(text)) FILTER (WHERE source_type = 'linkedin'), 0) AS kind_chars,
  coalesce(sum(length(text)) FILTER (WHERE source_type = 'linkedin'), 0) >= 600 AS passes_gate FROM ev_docs GROUP BY lead_id""")
def evidence_volume(spark, sf):
    return E.volume(roles.evidence_documents(spark, sf))


@query("evidence_budget", f"""WITH {EVIDENCE_DOCS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY ordinal) AS i FROM ev_docs),
h AS (SELECT *, length(concat('[S', CAST(i AS VARCHAR), '] type=', source_type, ' url=', url, '\n')) AS hl FROM n),
b AS (SELECT *, coalesce(sum(hl + length(text)) OVER (PARTITION BY lead_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM h)
SELECT lead_id, ordinal, i AS "index", used_before, md5(left(text, CAST(60000 - used_before - hl AS BIGINT))) AS body FROM b WHERE 60000 - used_before - hl > 0""")
def evidence_budget(spark, sf):
    out = E.pack_budget(roles.evidence_documents(spark, sf))
    return out.select("lead_id", "ordinal", "index", "used_before", F.md5("body").alias("body"))


@query("evidence_merge", f"""
WITH b AS (SELECT page_id % 20 AS lead_id, page_id AS ordinal, {_canonical('url')} AS cu, 'snippet' AS text, 0 AS pr FROM pages
  UNION ALL SELECT page_id % 20, page_id, {_canonical(RAW_URL)}, concat('crawled ', CAST(page_id AS VARCHAR)), 1 FROM pages),
f AS (SELECT * FROM b WHERE cu <> ''),
p AS (SELECT lead_id, cu, min((pr, ordinal)) AS place, arg_max(text, (pr, ordinal)) AS text FROM f GROUP BY ALL)
SELECT lead_id, cu AS canonical_url, text, row_number() OVER (PARTITION BY lead_id ORDER BY place, cu) AS place FROM p QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY place, cu) <= 12""")
def evidence_merge(spark, sf):
    pages = table(spark, sf, "pages")
    snippets = pages.selectExpr("page_id % 20 AS lead_id", "page_id AS ordinal", "url", "'snippet' AS text")
    crawled = pages.selectExpr("page_id % 20 AS lead_id", "page_id AS ordinal", f"{RAW_URL} AS url",
                               "concat('crawled ', CAST(page_id AS STRING)) AS text")
    out = E.merge_evidence(snippets, crawled)
    from pyspark.sql import Window
    # twelve rows per lead at most
    place = F.row_number().over(Window.partitionBy("lead_id").orderBy("place_kind", "ordinal", "canonical_url"))
    return out.select("lead_id", "canonical_url", "text", place.alias("place"))


@query("snippet_documents", f"""
WITH h AS (SELECT page_id % 20 AS lead_id, page_id AS ordinal, {RAW_URL} AS url, CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('T', CAST(page_id AS VARCHAR)) END AS title,
   CASE WHEN page_id % 10 = 0 THEN NULL ELSE 'c' END AS content FROM pages),
c AS (SELECT *, {_canonical('url')} AS cu FROM h WHERE (title <> '' OR content IS NOT NULL)),
d AS (SELECT * FROM c WHERE cu <> '' QUALIFY row_number() OVER (PARTITION BY lead_id, cu ORDER BY ordinal) = 1),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY ordinal) <= 5)
SELECT lead_id, ordinal, trim(concat('# ', title, '\n', coalesce(content, '')), '{V.WHITESPACE}') AS text,
  {sql_source_type(sql_host('trim(url)'), sql_path('trim(url)'), "'example.com'")} AS source_type FROM k""")
def snippet_documents(spark, sf):
    pages = table(spark, sf, "pages")
    hits = pages.selectExpr(
        "page_id % 20 AS lead_id", "page_id AS ordinal", f"{RAW_URL} AS url",
        "CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('T', CAST(page_id AS STRING)) END AS title",
        "CASE WHEN page_id % 10 = 0 THEN NULL ELSE 'c' END AS content")
    leads = pages.selectExpr("page_id % 20 AS lead_id").distinct().withColumn("email", F.lit("a@example.com"))
    return E.snippet_documents(hits, leads).select("lead_id", "ordinal", "text", "source_type")


_QL = f"""SELECT c_custkey AS lead_id, c_name AS n, {CUSTOMER_EMAIL} AS e, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS co,
  CASE WHEN c_custkey % 3 = 0 THEN concat('C', CAST(c_nationkey AS VARCHAR(20))) ELSE '' END AS cy FROM customer"""


@query("query_generation", f"""
WITH l AS (SELECT *, {sql_domain('e')} AS dom FROM ({_QL})),
w AS (SELECT *, CASE WHEN dom <> '' AND dom NOT IN {sql_list(V.FREE_MAIL_FULL)} THEN dom END AS own, concat('"', n, '"') AS qn,
  concat_ws(' ', nullif(co, ''), nullif(cy, '')) AS cx, split_part(lower(e), '@', 2) AS aa FROM l),
b AS (SELECT lead_id, 'broad' AS template, [qn || ' "' || e || '"', qn || ' ' || cx, qn || ' LinkedIn', qn || ' company director biography',
   qn || ' sanctions PEP watchlist', qn || ' site:opensanctions.org', qn || ' site:offshoreleaks.icij.org', qn || ' lawsuit fraud bankruptcy regulatory',
   qn || ' yacht vessel charter owner', qn || ' site:' || own, '"' || own || '" company registration directors'] AS a FROM w
  UNION ALL SELECT lead_id, 'primary', [concat_ws(' ', qn, nullif(concat_ws(' ', nullif(co, ''), own, nullif(cy, '')), ''))] FROM w
  UNION ALL SELECT lead_id, 'profile', [qn || ' site:' || own, qn || ' ' || nullif(cx, ''), qn || ' site:linkedin.com/in', qn || ' CEO founder director entrepreneur company', qn || ' yacht yachting charter maritime'] FROM w
  UNION ALL SELECT lead_id, 'short', [qn || ' "' || coalesce(nullif(co, ''), nullif(cy, ''), CASE WHEN aa <> '' AND aa NOT IN {sql_list(V.FREE_MAIL_SHORT)} THEN aa END) || '"', qn, '"' || nullif(lower(e), '') || '"'] FROM w)
SELECT lead_id, template, array_to_string(list_transform(list_filter(a, lambda x: x IS NOT NULL), lambda x: trim(x)), ' / ') AS queries FROM b""")
def query_generation(spark, sf):
    leads = table(spark, sf, "customer").selectExpr(
        "c_custkey AS lead_id", "c_name AS full_name", f"{CUSTOMER_EMAIL} AS email",
        "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS company_name",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('C', CAST(c_nationkey AS STRING)) ELSE '' END AS country")
    out = None
    for template in ("broad", "primary", "profile", "short"):
        # eleven strings per lead at most, so the list stays in one row
        part = E.query_lists(leads, template).select(
            "lead_id", F.lit(template).alias("template"), F.array_join("queries", " / ").alias("queries"))
        out = part if out is None else out.unionByName(part)
    return out
