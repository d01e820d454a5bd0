"""Web evidence: hits and documents canonicalised, bounded, scored and ranked per lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.markup import decode_html
from ..functions.text import (
    cap, clean, contains_any, email_domain, fold, name_tokens, strip,
)
from ..functions.urls import (
    bucket, canonical, in_domain, is_profile_person, parse_url, source_type, with_canonical,
)
from ..plans.barrier import fenced, filter_computed
from ..plans.joins import with_group_facts
from ..plans.ordering import first_per_key, numbered, top_k
from ..session import materialise

# --- distinct, caps ----------------------------------------------------------


def distinct_in_order(df: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """First of every case-insensitive distinct value per group; blanks dropped."""
    out = df.withColumn(value, strip(F.col(value))).filter(F.col(value) != "")
    out = out.withColumn("_key", F.lower(F.col(value)))
    return first_per_key(out, [*keys, "_key"], [F.col(ordinal)]).drop("_key")


def diverse_hosts(df: DataFrame, keys: list[str], url: str, ordinal: str, limit: int,
                  per_host: int = 1) -> DataFrame:
    """At most ``per_host`` URLs per host bucket and ``limit`` per group, order kept."""
    out = parse_url(distinct_in_order(df, keys, url, ordinal), url, "_u")
    out = out.withColumn("host_bucket", bucket(F.col("_u")))
    out = filter_computed(out, F.col("host_bucket") != "")
    out = top_k(out, [*keys, "host_bucket"], [F.col(ordinal)], per_host, "_in_host")
    return top_k(out, keys, [F.col(ordinal)], limit, "rank").drop("_u", "_in_host")


def own_domain_first(df: DataFrame, keys: list[str], url: str, domain: Column, ordinal: str,
                     limit: int = 5) -> DataFrame:
    """The group's own-domain URLs first, then arrival order; ``limit`` rows."""
    out = parse_url(df, url, "_u").withColumn("is_own", in_domain(F.col("_u"), domain))
    return top_k(out, keys, [F.col("is_own").desc(), F.col(ordinal)], limit, "rank").drop("_u")


def merge_evidence(snippets: DataFrame, crawled: DataFrame, key: str = "lead_id",
                   max_sources: int | None = 12) -> DataFrame:
    """Snippets and crawled documents of a lead: a crawled document replaces the snippet
    of the same canonical URL but keeps its place; invalid URLs are dropped."""
    both = snippets.withColumn("_priority", F.lit(0)).unionByName(crawled.withColumn("_priority", F.lit(1)))
    both = filter_computed(with_canonical(both, "url", "_canonical"), F.col("_canonical") != "")
    body = [c for c in snippets.columns if c not in (key, "ordinal")]
    merged = both.groupBy(key, F.col("_canonical").alias("canonical_url")).agg(
        F.min(F.struct("_priority", "ordinal")).alias("_place"),
        F.max_by(F.struct(*body), F.struct("_priority", "ordinal")).alias("_doc"),
    )
    order = [F.col("_place._priority"), F.col("_place.ordinal"), F.col("canonical_url")]
    if max_sources is not None:
        merged = top_k(merged, [key], order, max_sources, "_rank").drop("_rank")
    return merged.select(
        key, F.col("_place._priority").alias("place_kind"), F.col("_place.ordinal").alias("ordinal"),
        "canonical_url", *[F.col(f"_doc.{c}").alias(c) for c in body])


def snippet_documents(hits: DataFrame, leads: DataFrame, key: str = "lead_id", limit: int = 5) -> DataFrame:
    """Search hits with a title or content as evidence documents, ``limit`` per lead."""
    out = parse_url(hits, "url", "_u").withColumn("_canonical", canonical(F.col("_u")))
    out = filter_computed(out, (F.col("_canonical") != "")
                          & ((clean(F.col("title")) != "") | (clean(F.col("content")) != "")))
    out = top_k(first_per_key(out, [key, "_canonical"], [F.col("ordinal")]), [key],
                [F.col("ordinal")], limit, "_rank")
    out = out.join(leads.select(key, email_domain(F.col("email")).alias("_domain")), key, "left")
    return out.select(
        key, "ordinal", "url",
        strip(F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n"),
                       F.coalesce("content", F.lit("")))).alias("text"),
        source_type(F.col("_u"), F.coalesce(F.col("_domain"), F.lit(""))).alias("source_type"))


# --- search hits -------------------------------------------------------------


def rank_hits(hits: DataFrame, limit: int, key: str = "lead_id", required_name: str | None = None) -> DataFrame:
    """Filter and rank search hits: engine, media, file and off-name links dropped; sector,
    business and role terms raise the score, music terms lower it.  Of several hits with one
    canonical URL the best that passes gives the rank, the last of all gives title and content,
    without tags and cut to the lengths of the contract."""
    out = parse_url(hits, "url", "_u").withColumn("canonical_url", canonical(F.col("_u")))
    shown = filter_computed(out, F.col("canonical_url") != "").groupBy(key, "canonical_url").agg(
        F.max_by(F.struct("title", "content"), "ordinal").alias("_shown"))
    u = F.col("_u")
    label = fold(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("title", F.lit("")), F.col("url")))
    out = out.withColumn("_label", label)
    keep = (
        (F.col("canonical_url") != "")
        & (u["host"] != V.HIT_ENGINE_HOST)
        & ~F.endswith(u["host"], F.lit(V.HIT_ENGINE_DOMAIN))
        & ~F.startswith(u["host"], F.lit("imgs."))
        & ~contains_any(u["host"], V.HIT_MEDIA_HOSTS)
        & ~F.lower(F.regexp_extract(F.col("canonical_url"), r"^[^?]*", 0))
        .rlike("(?:" + "|".join(s.replace(".", "\\.") for s in V.HIT_FILE_SUFFIXES) + ")$")
    )
    if required_name is not None:
        out = out.withColumn("_needed", fold(F.coalesce(F.col(required_name), F.lit(""))))
        keep = keep & ((F.col("_needed") == "") | F.contains(F.col("_label"), F.col("_needed")))
    out = filter_computed(out, keep)
    label = F.col("_label")

    def points(terms, value):
        return F.when(contains_any(label, terms), value).otherwise(0)

    out = out.withColumn(
        "score",
        points(V.HIT_SECTOR, 12) + points(V.HIT_BUSINESS, 8) + points(V.HIT_ROLE, 5) - points(V.HIT_MUSIC, 8))
    order = [F.col("score").desc(), F.col("ordinal")]
    out = out.withColumn("_key", F.lower(F.col("canonical_url")))
    best = first_per_key(out.drop("_u", "_label", "_needed", "title", "content"), [key, "_key"], order)
    best = top_k(best, [key], order, limit, "rank").drop("_key")
    return best.join(shown, [key, "canonical_url"]).select(
        *best.columns, cap(decode_html(F.coalesce("_shown.title", F.lit(""))), V.HIT_TITLE).alias("title"),
        cap(decode_html(F.coalesce("_shown.content", F.lit(""))), V.HIT_CONTENT).alias("content"))


# --- scoring -------------------------------------------------------------------


def lead_terms(leads: DataFrame, key: str = "lead_id") -> DataFrame:
    """Comparable terms of a lead, derived once per lead before the join."""
    domain = email_domain(F.col("email"))
    return leads.select(
        key,
        fold(clean(F.col("full_name"))).alias("_name"),
        name_tokens(clean(F.col("full_name"))).alias("_tokens"),
        F.lower(clean(F.col("email"))).alias("_email"),
        domain.alias("_domain"),
        fold(clean(F.col("company_name"))).alias("_company"),
        fold(clean(F.col("country"))).alias("_country"),
        fold(clean(F.col("city"))).alias("_city"),
    )


def score_evidence(docs: DataFrame, leads: DataFrame, key: str = "lead_id",
                   word_boundary: bool = False, keep_text: bool = False, keep_terms: bool = False) -> DataFrame:
    """Score every document against its own lead and list its signals.

    The join key is always the lead (an equi join); the documents of a hot lead are spread.
    Documents without ``source_type`` get it here, so one join serves both; ``keep_terms`` leaves
    the lead's name and domain for :func:`identity.document_facts`.
    """
    df = with_group_facts(docs, lead_terms(leads, key), key, "ordinal")
    df = parse_url(df, "url", "_u")
    if "source_type" not in docs.columns:
        df = df.withColumn("source_type", source_type(F.col("_u"), F.col("_domain")))
    df = df.withColumn("_folded", fold(F.coalesce("text", F.lit(""))))
    text, u = F.col("_folded"), F.col("_u")

    def given_in(term: str, c: Column = text) -> Column:
        return (F.col(term) != "") & F.contains(c, F.col(term))

    exact = given_in("_name")
    df = df.withColumns({
        "has_email": given_in("_email", F.lower(F.coalesce("text", F.lit("")))),
        "has_exact_name": exact,
        "has_all_tokens": ~exact & (F.size("_tokens") >= 2)
        & F.forall("_tokens", lambda t: F.contains(F.col("_folded"), t)),
        "has_company": given_in("_company"),
        "has_own_domain": in_domain(u, F.col("_domain")),
        "has_country": given_in("_country"),
        "has_city": given_in("_city"),
        "has_sector": contains_any(text, V.SECTOR_TERMS, word_boundary),
        "has_executive": contains_any(text, V.EXECUTIVE_TERMS, word_boundary),
        "has_off_topic": contains_any(text, V.OFF_TOPIC_TERMS, word_boundary),
        "has_trusted": F.col("source_type").isin(*V.TRUSTED_TYPES),
    })
    score = F.lit(0)
    for name, weight in V.EVIDENCE_WEIGHTS.items():
        score = score + F.when(F.col("has_" + name), weight).otherwise(0)
    signals = F.array_compact(F.array(*[
        F.when(F.col("has_" + name), F.lit(label)) for name, label in V.SIGNALS.items()]))
    df = df.withColumn("score", score).withColumn("signals", signals)
    drop = ["_tokens", "_email", "_company", "_country", "_city", "_u", "_folded"]
    drop += [] if keep_terms else ["_name", "_domain"]
    return df.drop(*drop) if keep_text else df.drop("text", *drop)


def rank_evidence(scored: DataFrame, key: str = "lead_id", threshold: int = V.RELEVANCE_THRESHOLD,
                  reuse: bool = True) -> DataFrame:
    """Relevant documents of every lead numbered by score, ties in arrival order.  Every
    row is numbered, also in a lead that owns a large part of the table.

    Numbering reads the scores twice; with ``reuse`` the scored rows (without text) are
    written once to the checkpoint folder, so the texts are read once."""
    relevant = filter_computed(scored, F.col("score") >= threshold)
    if reuse:
        relevant = materialise(relevant)
    return numbered(relevant, [key], "ordinal", [-F.col("score")], "rank")


def volume(docs: DataFrame, key: str = "lead_id", minimum: int = 600, kind: str = "linkedin") -> DataFrame:
    """Text volume per lead, overall and of one source type, with the gate on the latter."""
    length = F.length(F.coalesce("text", F.lit("")))
    of_kind = F.coalesce(F.sum(F.when(F.col("source_type") == kind, length)), F.lit(0))
    return docs.groupBy(key).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(length).alias("chars"),
        of_kind.alias("kind_chars"), (of_kind >= minimum).alias("passes_gate"))


# every packed document spends at least "[S1] type= url=\n"
_SHORTEST_HEADER = 17


def pack_budget(docs: DataFrame, max_chars: int = 60_000, key: str = "lead_id") -> DataFrame:
    """Documents of a lead in order until the character budget is used; the last is cut.

    A document costs its header and body.  Each one spends at least the shortest
    header, so numbers past ``max_chars / shortest header`` can never fit: groups are
    bounded by the rule itself before the running total, at no loss.  Lengths are numbered
    and added up; only the few documents that fit are joined back to their texts.
    """
    most = max_chars // _SHORTEST_HEADER + 1
    length = F.length(F.coalesce("text", F.lit("")))
    narrow = fenced(docs.select(key, "ordinal", "source_type", "url", length.alias("_length")))
    df = numbered(narrow, [key], "ordinal", rank="index").filter(F.col("index") <= most)
    df = df.withColumn("header", F.concat(
        F.lit("[S"), F.col("index").cast("string"), F.lit("] type="), F.col("source_type"),
        F.lit(" url="), F.col("url"), F.lit("\n")))
    size = F.length("header") + F.col("_length")
    before = Window.partitionBy(key).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("used_before", F.coalesce(F.sum(size).over(before), F.lit(0)))
    room = F.lit(max_chars) - F.col("used_before") - F.length("header")
    kept = df.withColumn("_room", room).filter(F.col("_room") > 0).select(
        key, "ordinal", "index", "header", "used_before", "_room")
    return (
        docs.join(kept, [key, "ordinal"])
        .withColumn("body", F.left(F.coalesce("text", F.lit("")), F.col("_room").cast("int")))
        .drop("_room", "text"))


# --- lines and fields of a document --------------------------------------------


def _lines(text: Column, n: int) -> Column:
    """First ``n`` lines."""
    return F.slice(F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\x0b\x0c\u0085  ]"), 1, n)


def _without_markers(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"^[#>*_`\s\-]+", ""))


def headline(text: Column) -> Column:
    """First usable line (8 to 180 characters) among the first 30."""
    lines = F.transform(_lines(text, 30), _without_markers)
    usable = F.filter(lines, lambda s: F.length(s).between(8, 180)
                      & ~F.lower(s).rlike("^(?:" + "|".join(V.HEADLINE_SKIP) + ")"))
    return F.coalesce(F.try_element_at(usable, F.lit(1)), F.lit(""))


def statement(text: Column, kind: Column) -> Column:
    """One professional line: the first naming a role, else for trusted types the first."""
    lines = F.transform(_lines(text, 20), lambda s: F.regexp_replace(_without_markers(s), V.WS + "+", " "))
    usable = F.filter(lines, lambda s: F.length(s).between(8, 350)
                      & ~F.lower(s).rlike("^(?:" + "|".join(V.STATEMENT_SKIP) + ")"))
    role = F.try_element_at(F.filter(usable, lambda s: contains_any(F.lower(s), V.ROLE_LINE_TERMS)), F.lit(1))
    fallback = F.when(kind.isin(*V.TRUSTED_TYPES), F.try_element_at(usable, F.lit(1)))
    return F.left(F.rtrim(F.coalesce(role, fallback, F.lit("")), F.lit(" .")), F.lit(280))


def prefixed_field(text: Column, prefix: str, limit: int = 400) -> Column:
    """Value of the first line starting with ``prefix`` (any case)."""
    blank = r"[ \t\x0b\x0c ]*"
    return cap(strip(F.regexp_extract(
        F.coalesce(text, F.lit("")), r"(?iu)(?:^|[\n\r])" + blank + prefix + r"([^\n\r]*)", 1)), limit)


def with_fields(df: DataFrame, text: str = "text", url: str = "url", kind: str = "source_type") -> DataFrame:
    """Add headline, statement and the prefixed profile fields of every document.

    Prefixed fields are read from profile pages only."""
    df = parse_url(df, url, "_u").withColumn("is_person", is_profile_person(F.col("_u"))).drop("_u")
    df = df.withColumn("headline", headline(F.col(text))).withColumn("statement", statement(F.col(text), F.col(kind)))
    return df.withColumns({
        "field_" + name: F.when(F.col("is_person"), prefixed_field(F.col(text), prefix)).otherwise(F.lit(""))
        for name, prefix in V.FIELD_PREFIXES.items()})


# --- search queries --------------------------------------------------------------


def query_lists(leads: DataFrame, template: str = "broad", key: str = "lead_id") -> DataFrame:
    """Ordered distinct search strings of every lead as a list of at most eleven
    (templates broad, primary, profile, short)."""
    name, email = clean(F.col("full_name")), clean(F.col("email"))
    company, country = clean(F.col("company_name")), clean(F.col("country"))
    domain = email_domain(email)
    own = F.when((domain != "") & ~domain.isin(*V.FREE_MAIL_FULL), domain)
    quoted = F.concat(F.lit('"'), name, F.lit('"'))

    def filled(c):
        return F.nullif(c, F.lit(""))

    def q(suffix):
        return F.concat(quoted, F.lit(suffix))

    context = F.concat_ws(" ", filled(company), filled(country))
    if template == "broad":
        items = [
            F.concat(quoted, F.lit(' "'), email, F.lit('"')), F.concat(quoted, F.lit(" "), context),
            q(" LinkedIn"), q(" company director biography"), q(" sanctions PEP watchlist"),
            q(" site:opensanctions.org"), q(" site:offshoreleaks.icij.org"),
            q(" lawsuit fraud bankruptcy regulatory"), q(" yacht vessel charter owner"),
            F.concat(quoted, F.lit(" site:"), own),
            F.concat(F.lit('"'), own, F.lit('" company registration directors')),
        ]
    elif template == "primary":
        professional = F.concat_ws(" ", filled(company), own, filled(country))
        items = [F.concat_ws(" ", quoted, filled(professional))]
    elif template == "profile":
        items = [
            F.concat(quoted, F.lit(" site:"), own), F.concat(quoted, F.lit(" "), filled(context)),
            q(V.SEARCH_ENDS["profile"]), q(V.SEARCH_ENDS["executive"]),
            q(V.SEARCH_ENDS["sector"]),
        ]
    elif template == "short":
        mail = F.lower(email)
        # the part between the first and second @
        after_at = F.coalesce(F.get(F.split(mail, "@"), F.lit(1)), F.lit(""))
        work = F.when((after_at != "") & ~after_at.isin(*V.FREE_MAIL_SHORT), after_at)
        focus = F.coalesce(filled(company), filled(country), work)
        items = [
            F.when(name != "", F.concat(quoted, F.lit(' "'), focus, F.lit('"'))),
            F.when(name != "", quoted),
            F.when(mail != "", F.concat(F.lit('"'), mail, F.lit('"'))),
        ]
    else:
        raise ValueError(f"unknown template {template!r}")
    queries = F.filter(F.transform(F.array_compact(F.array(*items)), strip),
                       lambda s: strip(F.replace(s, F.lit('"'), F.lit(""))) != "")
    listed = leads.select(key, queries.alias("_q")).withColumn(
        "_lower", F.transform("_q", lambda s: F.lower(s)))
    kept = F.array_compact(F.transform(
        "_q", lambda s, i: F.when(F.array_position("_lower", F.lower(s)) == i + 1, s)))
    return listed.select(key, kept.alias("queries"))


def search_queries(leads: DataFrame, template: str = "broad", key: str = "lead_id") -> DataFrame:
    """The same search strings, one row each."""
    return query_lists(leads, template, key).select(key, F.posexplode("queries").alias("ordinal", "query"))
