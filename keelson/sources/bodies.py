"""Search hits out of captured result bodies (HTML anchors, OpenSearch JSON, RSS items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.markup import attribute, decode_html, element
from ..functions.text import cap, fold
from ..functions.urls import with_safe
from ..plans.barrier import filter_computed
from ..plans.ordering import first_per_key

_MARK, _SEP = "\u0001", "\u0002"
# fixed values: classes of result links and of their snippets
RESULT_CLASSES = ("result__a", "result-link")
SNIPPET_CLASSES = ("result__snippet", "result-snippet")


def has_class(names: tuple[str, ...]) -> str:
    """Look-ahead inside a start tag for a class attribute with one of the names."""
    any_of = "|".join(names)
    return (rf"""(?=[^>]*\bclass\s*=\s*(?:"(?:[^"]*\s)?(?:{any_of})(?:\s[^"]*)?"|"""
            rf"""'(?:[^']*\s)?(?:{any_of})(?:\s[^']*)?'|(?:{any_of})(?=[\s>]|$)))""")


RESULT_ANCHOR = rf"(?is)<a\b({has_class(RESULT_CLASSES)}[^>]*)>(.*?)</a\s*>"
ANY_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
SNIPPET = rf"(?is)<(a|div|td)\b{has_class(SNIPPET_CLASSES)}[^>]*>(.*?)</\1\s*>"


def _unwrap_cdata(c: Column) -> Column:
    opening, closing = "<![CDATA[", "]]>"
    wrapped = F.startswith(c, F.lit(opening)) & F.endswith(c, F.lit(closing))
    inside = F.substr(c, F.lit(len(opening) + 1), F.length(c) - len(opening) - len(closing))
    return F.when(wrapped, inside).otherwise(c)


def anchors(df: DataFrame, body: str, keys: list[str], pattern: str = RESULT_ANCHOR) -> DataFrame:
    """One row per matching anchor: position, raw href, title html and the html up to the
    next matching anchor."""
    marked = F.regexp_replace(
        F.translate(F.col(body), _MARK + _SEP, ""), pattern, f"{_MARK}$1{_SEP}$2{_SEP}")
    pieces = F.split(marked, _MARK)
    parts = F.split(F.col("_piece"), _SEP)
    return (
        df.select(*keys, F.posexplode(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))))
                  .alias("position", "_piece"))
        .select(*keys, "position",
                decode_html(attribute(F.get(parts, F.lit(0)), "href")).alias("href"),
                F.get(parts, F.lit(1)).alias("title_html"), F.get(parts, F.lit(2)).alias("rest_html")))


def html_hits(df: DataFrame, body: str, keys: list[str], window: int | None = V.BODY_WINDOW,
              title: int | None = V.BODY_TITLE, snippet: int | None = V.BODY_SNIPPET) -> DataFrame:
    """``window``: characters after a link in which its snippet is looked for; None reads all of them."""
    rest = F.col("rest_html") if window is None else F.left("rest_html", F.lit(window))
    return anchors(df, body, keys).select(
        *keys, "position", "href", cap(decode_html(F.col("title_html")), title).alias("title"),
        cap(decode_html(F.regexp_extract(rest, SNIPPET, 2)), snippet).alias("snippet"))


def opensearch_hits(df: DataFrame, body: str, keys: list[str], title: int | None = V.BODY_TITLE,
                    snippet: int | None = V.BODY_SNIPPET) -> DataFrame:
    def part(i):
        return F.from_json(F.get_json_object(F.col(body), f"$[{i}]"), "array<string>")

    zipped = df.select(*keys, F.arrays_zip(
        part(3).alias("href"), part(1).alias("title"), part(2).alias("snippet")).alias("_z"))
    rows = zipped.select(*keys, F.posexplode("_z").alias("position", "_h"))
    return rows.filter(F.col("_h.href").isNotNull()).select(
        *keys, "position", F.col("_h.href").alias("href"),
        cap(decode_html(F.coalesce(F.col("_h.title"), F.lit(""))), title).alias("title"),
        cap(decode_html(F.coalesce(F.col("_h.snippet"), F.lit(""))), snippet).alias("snippet"))


def rss_hits(df: DataFrame, body: str, keys: list[str], title: int | None = V.BODY_TITLE,
             snippet: int | None = V.BODY_SNIPPET) -> DataFrame:
    items = df.select(*keys, F.posexplode(
        F.regexp_extract_all(F.col(body), F.lit(element("item")), F.lit(1))).alias("position", "_item"))

    def tag(name):
        return _unwrap_cdata(F.regexp_extract(F.col("_item"), element(name), 1))

    return items.select(
        *keys, "position", decode_html(tag("link")).alias("href"),
        cap(decode_html(tag("title")), title).alias("title"),
        cap(decode_html(decode_html(tag("description"))), snippet).alias("snippet"))


def search_hits(df: DataFrame, keys: list[str], body: str = "body", kind: str = "format",
                window: int | None = V.BODY_WINDOW, title: int | None = V.BODY_TITLE,
                snippet: int | None = V.BODY_SNIPPET) -> DataFrame:
    """Hits of a mixed table of bodies (``format`` html, json or rss): unsafe links
    dropped, the first hit of a URL kept.  None lifts a bound."""
    hits = (
        html_hits(df.filter(F.col(kind) == "html"), body, keys, window, title, snippet)
        .unionByName(opensearch_hits(df.filter(F.col(kind) == "json"), body, keys, title, snippet))
        .unionByName(rss_hits(df.filter(F.col(kind) == "rss"), body, keys, title, snippet)))
    hits = filter_computed(with_safe(hits, "href", "url"), F.col("url").isNotNull())
    return first_per_key(hits, [*keys, "url"], [F.col("position")]).select(
        *keys, "position", "url", "title", "snippet")


def matching_hits(hits: DataFrame, query: str) -> DataFrame:
    """Hits that name the quoted part of the query (the whole query when none is quoted)."""
    quoted = F.regexp_extract(F.col(query), r'"([^"]+)"', 1)
    needed = fold(F.when(quoted != "", quoted).otherwise(F.col(query)), "builder")
    marked = hits.withColumn("_needed", needed).withColumn(
        "_label", fold(F.concat_ws(" ", "title", "snippet", "url"), "builder"))
    kept = filter_computed(marked, (F.col("_needed") != "") & F.contains(F.col("_label"), F.col("_needed")))
    return kept.drop("_needed", "_label")
