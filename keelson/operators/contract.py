"""The report contract: projection, enum coercion, grounding and prudence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V
from ..functions.text import cap, clean, strip
from ..functions.urls import with_canonical
from ..plans.barrier import filter_computed
from ..plans.ordering import first_per_key, top_k
from ..session import materialise
from ..schemas import ADVERSE_ITEM, REPORT, SCREENING, VESSEL

LONGEST_TEXT, LONGEST_LIST = 2000, 100


def rebuild(c: Column, kind: T.StructType, changes: dict[str, Column], prefix: str = "") -> Column:
    """Struct ``c`` with the fields at the given dotted paths replaced.

    Built in one go: a chain of nested ``withField`` calls would repeat the whole
    previous expression at every step.
    """
    fields = []
    for field in kind.fields:
        path = prefix + field.name
        if path in changes:
            value = changes[path]
        elif any(p.startswith(path + ".") for p in changes):
            value = rebuild(c[field.name], field.dataType, changes, path + ".")
        else:
            value = c[field.name]
        fields.append(value.alias(field.name))
    return F.struct(*fields)


def update(df: DataFrame, changes: dict[str, Column], report: str = "report") -> DataFrame:
    """Replace fields of the report column."""
    return df.withColumn(report, rebuild(F.col(report), df.schema[report].dataType, changes))


def recover_json(reply: Column) -> Column:
    """JSON object inside a captured reply: code fences removed, first ``{`` to last ``}``;
    null when that is not a valid object."""
    body = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.get_json_object(body, "$").isNotNull(), body)


def _default(kind: T.DataType, c: Column) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_default(f.dataType, c[f.name]).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        items = F.slice(F.coalesce(c, F.array().cast(kind)), 1, LONGEST_LIST)
        if isinstance(kind.elementType, T.StringType):
            return F.transform(items, lambda s: cap(strip(s), LONGEST_TEXT))
        return F.transform(F.filter(items, lambda x: x.isNotNull()),
                           lambda x: _default(kind.elementType, x))
    if isinstance(kind, T.StringType):
        return cap(clean(c), LONGEST_TEXT)
    # the only number of the contract is a 0-100 score
    return F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(100.0)).cast(kind)


def _reading(kind: T.DataType) -> T.DataType:
    """The contract as it is read: numbers of any size or precision."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _reading(f.dataType)) for f in kind.fields])
    return T.DoubleType() if isinstance(kind, T.IntegerType) else kind


def project(df: DataFrame, text: str, out: str = "report") -> DataFrame:
    """Parse a report JSON and keep exactly the contract: unknown keys dropped, missing ones
    defaulted, texts and lists bounded, the score an integer from 0 to 100."""
    df = df.withColumn("_parsed", F.from_json(F.col(text), _reading(REPORT)))
    return df.withColumn(out, _default(REPORT, F.col("_parsed"))).drop("_parsed")


def _get(c: Column, path: tuple) -> Column:
    for name in path:
        c = c[name]
    return c


def allowed(c: Column, values, fallback: str) -> Column:
    return F.when(c.isin(*values), c).otherwise(F.lit(fallback))


def enum_changes(c: Column) -> dict[str, Column]:
    """Enum values outside their set fall back to their default."""
    return {".".join(path): allowed(_get(c, path), values, fallback)
            for path, (values, fallback) in V.REPORT_ENUMS.items()}


def list_changes(c: Column) -> dict[str, Column]:
    """Field caps and enum rules inside the nested lists."""
    def bounded(x, name, n):
        return cap(clean(x[name]), n).alias(name)

    persons = F.transform(c["identity_resolution"]["matched_persons"], lambda x: F.struct(
        bounded(x, "name", 300), bounded(x, "headline", 500), bounded(x, "location", 300),
        bounded(x, "company", 300),
        F.transform(F.filter(F.slice(x["evidence"], 1, 20), lambda s: clean(s) != ""),
                    lambda s: cap(strip(s), 1000)).alias("evidence")))
    adverse = F.transform(c["adverse_media"], lambda x: F.struct(
        allowed(x["category"], V.ADVERSE_CATEGORIES, "reputational").alias("category"),
        bounded(x, "title", 300), bounded(x, "summary", 1000), bounded(x, "date", 50),
        bounded(x, "jurisdiction", 100),
        allowed(x["confidence"], V.CONFIDENCE_LEVELS, "low").alias("confidence"),
        allowed(x["status_type"], V.ADVERSE_STATUS, "media_report").alias("status_type"),
        x["source_url"].alias("source_url")))
    assets = F.transform(c["maritime_screening"]["assets"], lambda x: F.struct(*[
        bounded(x, n, 500) for n in (
            "vessel_name", "imo", "mmsi", "flag", "registered_owner", "beneficial_owner", "manager",
            "builder", "year_built")], x["source_url"].alias("source_url")))
    summary = F.transform(
        F.filter(F.slice(c["kyc_assessment"]["executive_summary"], 1, 8), lambda s: clean(s) != ""),
        lambda s: cap(strip(s), 600))
    return {
        "identity_resolution.matched_persons": persons, "adverse_media": adverse,
        "maritime_screening.assets": assets, "kyc_assessment.executive_summary": summary}


# --- grounding --------------------------------------------------------------------

# claim kind -> path of the claimed URLs in the report
LIST_CLAIMS = {
    "source": ("sources", "url"), "adverse": ("adverse_media", "source_url"),
    "asset": ("maritime_screening.assets", "source_url"),
}
URL_LISTS = {"website": "person_profile.websites", "other": "person_profile.profiles.other"}
SINGLE_URLS = {
    "linkedin": "person_profile.profiles.linkedin",
    "company_profile": "person_profile.profiles.company_profile",
    "company_website": "company_profile.website",
}


def claims(reports: DataFrame, report: str = "report", key: str = "lead_id") -> DataFrame:
    """Every claimed URL of a report as one row (key, kind, position, url)."""
    def rows(kind, urls):
        return F.transform(urls, lambda u, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("position"), u.alias("url")))

    parts = [rows(kind, F.col(f"{report}.{path}.{field}")) for kind, (path, field) in LIST_CLAIMS.items()]
    parts += [rows(kind, F.col(f"{report}.{path}")) for kind, path in URL_LISTS.items()]
    parts += [rows(kind, F.array(F.col(f"{report}.{path}"))) for kind, path in SINGLE_URLS.items()]
    rows = F.filter(F.concat(*parts), lambda c: c["url"] != "")
    return reports.select(key, F.explode(rows).alias("_c")).select(key, "_c.*")


def grounded_claims(claimed: DataFrame, docs: DataFrame, key: str = "lead_id") -> DataFrame:
    """Claims whose canonical URL is a collected document of the same lead, with the
    document's own URL and type (the last document of a URL wins)."""
    known = filter_computed(with_canonical(docs, "url", "_canonical"), F.col("_canonical") != "").groupBy(
        key, "_canonical").agg(F.max_by(F.struct("url", "source_type"), F.col("ordinal")).alias("_doc"))
    wanted = filter_computed(with_canonical(claimed, "url", "_canonical"), F.col("_canonical") != "").drop("url")
    return wanted.join(known, [key, "_canonical"], "inner").select(
        key, "kind", "position", F.col("_doc.url").alias("url"),
        F.when(F.col("_doc.source_type").isin(*V.SOURCE_TYPES), F.col("_doc.source_type"))
        .otherwise("other").alias("type"))


def ground(reports: DataFrame, docs: DataFrame, report: str = "report", key: str = "lead_id") -> DataFrame:
    """Keep only what a collected source backs.  All claims of all reports go through one
    join; a report has a bounded number of claims, so regrouping stays small."""
    kept = grounded_claims(claims(reports, report, key), docs, key).groupBy(key).agg(
        F.collect_list(F.struct("kind", "position", "url", "type")).alias("_kept"))
    df = reports.join(kept, key, "left")
    c = F.col(report)
    have = F.coalesce("_kept", F.array().cast(kept.schema["_kept"].dataType))

    def match(kind, i):
        return F.try_element_at(
            F.filter(have, lambda k: (k["kind"] == kind) & (k["position"] == i)), F.lit(1))

    def backed(items, kind, build):
        built = F.transform(items, lambda x, i: F.when(
            match(kind, i).isNotNull(), build(x, match(kind, i))))
        return F.filter(built, lambda x: x.isNotNull())

    sources = backed(c["sources"], "source", lambda x, m: F.struct(
        m["type"].alias("type"), m["url"].alias("url"), cap(clean(x["note"]), 500).alias("note")))
    adverse = backed(c["adverse_media"], "adverse",
                     lambda x, m: rebuild(x, ADVERSE_ITEM, {"source_url": m["url"]}))
    assets = backed(c["maritime_screening"]["assets"], "asset",
                    lambda x, m: rebuild(x, VESSEL, {"source_url": m["url"]}))
    df = df.withColumns({"_sources": sources, "_adverse": adverse, "_assets": assets})
    df = df.withColumn("_urls", F.col("_sources.url"))
    first = F.filter(
        F.transform("_sources", lambda x, i: F.when(F.array_position("_urls", x["url"]) == i + 1, x)),
        lambda x: x.isNotNull())
    status = c["maritime_screening"]["status"]
    changes = {
        "sources": F.slice(first, 1, 5), "adverse_media": F.col("_adverse"),
        "maritime_screening.status": F.when(
            (F.size("_assets") == 0) & (status == "confirmed_link"), "non_determinable").otherwise(status),
        "maritime_screening.assets": F.col("_assets")}
    for kind, path in URL_LISTS.items():
        changes[path] = backed(_get(c, tuple(path.split("."))), kind, lambda x, m: m["url"])
    for kind, path in SINGLE_URLS.items():
        changes[path] = F.coalesce(match(kind, F.lit(0))["url"], F.lit(""))
    return update(df, changes, report).drop("_kept", "_sources", "_urls", "_adverse", "_assets")


# --- prudence ----------------------------------------------------------------------


def screening_rule(status: Column, backed: Column, identity: Column) -> Column:
    """``clear`` is never claimed; a finding needs its source; a hit on an unidentified
    person is only a possible homonym."""
    finding = status.isin("hit", "possible_homonym")
    return (
        F.when(status == "clear", "not_enough_data")
        .when(finding & ~backed, "not_enough_data")
        .when((status == "hit") & ~identity.isin("confirmed", "probable"), "possible_homonym")
        .otherwise(status))


def enforce_screening(df: DataFrame, report: str = "report") -> DataFrame:
    c = F.col(report)
    identity, sources = c["identity_resolution"]["status"], c["sources"]

    def typed(*types):
        return F.exists(sources, lambda s: s["type"].isin(*types))

    host = r"(?i)^https?://(?:[^/?#]*@)?(?:[^/?#:]*\.)?" + V.OFFSHORE_HOST.replace(".", "\\.") + r"(?:[:/?#]|$)"
    needed = {
        "sanctions": typed("sanctions_db"), "pep": typed("pep_db", "sanctions_db"),
        "watchlists": typed("sanctions_db", "pep_db"),
        "offshore_leaks": F.exists(sources, lambda s: s["url"].rlike(host)),
    }
    changes = {}
    for name, backed in needed.items():
        old = c["risk_screening"][name]
        new = screening_rule(old["status"], backed, identity)
        dropped = (new == "not_enough_data") & (old["status"] != "not_enough_data")
        changes[f"risk_screening.{name}.status"] = new
        changes[f"risk_screening.{name}.details"] = F.when(
            dropped, F.array().cast(SCREENING["details"].dataType)).otherwise(old["details"])
    return update(df, changes, report)


def reconcile(identity: Column, risk: Column, review: Column, all_clear: Column) -> tuple[Column, Column]:
    """(risk, review) after the caps of a weak identity, the low-risk and the high-risk rule."""
    weak = identity.isin("ambiguous", "unresolved")
    risk1 = F.when(weak & (risk == "low"), "undetermined").otherwise(risk)
    review1 = F.when(weak, F.when(identity == "ambiguous", "manual_review")
                     .otherwise("insufficient_data")).otherwise(review)
    lowered = (risk1 == "low") & ~all_clear
    risk2 = F.when(lowered, "medium").otherwise(risk1)
    review2 = F.when(lowered, "manual_review").otherwise(review1)
    return risk2, F.when(risk2 == "high", "enhanced_due_diligence").otherwise(review2)


def _blank(kind: T.StructType, values: dict[str, Column], prefix: str = "") -> Column:
    """Empty struct of the contract with the given paths filled."""
    fields = []
    for field in kind.fields:
        path = prefix + field.name
        if path in values:
            value = values[path]
        elif isinstance(field.dataType, T.StructType):
            value = _blank(field.dataType, values, path + ".")
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array().cast(field.dataType)
        else:
            value = F.lit("" if isinstance(field.dataType, T.StringType) else 0).cast(field.dataType)
        fields.append(value.alias(field.name))
    return F.struct(*fields)


def blank_report(query: Column, reason: Column, changes: dict[str, Column] | None = None) -> Column:
    """Report without findings for a query struct, optionally with some paths filled."""
    values = {".".join(path): F.lit(fallback) for path, (_, fallback) in V.REPORT_ENUMS.items()}
    names = REPORT["query_input"].dataType.names
    values["query_input"] = F.struct(*[clean(query[n]).alias(n) for n in names])
    values["kyc_assessment.key_reasons"] = F.when(
        reason != "", F.array(cap(reason, 500))).otherwise(F.array().cast("array<string>"))
    values["kyc_assessment.missing_critical_items"] = F.array_compact(F.array(*[
        F.when(clean(query[n]) == "", F.lit(n)) for n in ("full_name", "email")]))
    for path, value in (changes or {}).items():
        values = {p: v for p, v in values.items() if not p.startswith(path + ".")}
        values[path] = value
    return _blank(REPORT, values)


def settle(df: DataFrame, report: str = "report") -> DataFrame:
    """Last step: no source left gives a blank report, else risk and review are reconciled."""
    c = F.col(report)
    screening = c["risk_screening"]
    all_clear = F.lit(True)
    for name in ("sanctions", "pep", "watchlists", "offshore_leaks"):
        all_clear = all_clear & (screening[name]["status"] == "clear")
    risk, review = reconcile(
        c["identity_resolution"]["status"], c["kyc_assessment"]["overall_risk"],
        c["kyc_assessment"]["recommended_review"], all_clear)
    settled = rebuild(c, df.schema[report].dataType, {
        "kyc_assessment.overall_risk": risk, "kyc_assessment.recommended_review": review})
    blank = blank_report(c["query_input"], F.lit(V.TEXT["no_grounded"]))
    return df.withColumn(report, F.when(F.size(c["sources"]) == 0, blank).otherwise(settled))


def normalise(candidates: DataFrame, leads: DataFrame, docs: DataFrame, text: str = "candidate",
              key: str = "lead_id", reuse: bool = True) -> DataFrame:
    """Candidate report JSON of every lead to a grounded, conservative report.

    Grounding reads the parsed reports twice; with ``reuse`` they are parsed once and
    written to the checkpoint folder."""
    query = F.struct(*[clean(F.col(n)).alias(n) for n in REPORT["query_input"].dataType.names])
    df = project(candidates.select(key, text), text).drop(text)
    df = df.join(leads.select(key, query.alias("_query")), key, "inner")
    # everything that needs no other table in one rebuild of the struct
    c = F.col("report")
    df = update(df, {"query_input": F.col("_query"), **enum_changes(c), **list_changes(c)}).drop("_query")
    df = ground(materialise(df) if reuse else df, docs, "report", key)
    return settle(enforce_screening(df))


# --- enrichment ---------------------------------------------------------------------


def enrich_company(reports: DataFrame, facts: DataFrame, key: str = "lead_id", report: str = "report",
                   company_given: Column | None = None) -> DataFrame:
    """Fill empty company fields from provider facts (column ``company``); nothing that is
    set is overwritten, and only attributable leads are touched."""
    df = reports.join(facts.select(key, F.col("company").alias("_facts")), key, "left")
    c, f = F.col(report), F.col("_facts")
    attributable = c["identity_resolution"]["status"].isin("confirmed", "probable")
    if company_given is not None:
        attributable = attributable | company_given
    use = attributable & f.isNotNull()
    kind = REPORT["company_profile"].dataType
    given = facts.schema["company"].dataType

    def fill(old, new):
        return F.when(use & (F.coalesce(old, F.lit("")) == "") & (F.coalesce(new, F.lit("")) != ""), new).otherwise(old)

    changes = {}
    for field in kind.fields:
        if field.name not in given.names:
            continue
        path = ("company_profile", field.name)
        if isinstance(field.dataType, T.StructType):
            for sub in given[field.name].dataType.names:
                changes[".".join((*path, sub))] = fill(_get(c, (*path, sub)), f[field.name][sub])
        elif isinstance(field.dataType, T.StringType):
            changes[".".join(path)] = fill(_get(c, path), f[field.name])
    return update(df, changes, report).drop("_facts")


def merge_adverse(reports: DataFrame, items: DataFrame, gate: DataFrame | None = None,
                  key: str = "lead_id", report: str = "report", max_hits: int | None = None,
                  reuse: bool = True) -> DataFrame:
    """Append adverse items whose URL the report does not hold yet, and cite each one.

    Only leads with a resolved identity are touched, and with ``gate`` (key,
    passes_gate) only those with enough profile text.  ``items``: one row per item
    with ``ordinal``; ``max_hits`` keeps only the first ones of a screen, before anything else.
    The reports are read twice; ``reuse`` writes them once to the checkpoint folder.
    """
    if reuse:
        reports = materialise(reports)
    fields = ("category", "title", "summary", "date", "jurisdiction", "confidence", "status_type", "source_url")
    held = reports.select(key, F.explode(F.col(f"{report}.adverse_media.source_url")).alias("source_url"))
    if max_hits is not None:
        items = top_k(items, [key], [F.col("ordinal")], max_hits, "_hit").drop("_hit")
    fresh = items.join(held.distinct(), [key, "source_url"], "left_anti")
    fresh = first_per_key(fresh, [key, "source_url"], [F.col("ordinal")]).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("item")))).alias("_new"))
    df = reports.join(fresh, key, "left")
    if gate is not None:
        df = df.join(gate.select(key, "passes_gate"), key, "left")
    c = F.col(report)
    use = c["identity_resolution"]["status"].isin("confirmed", "probable") & F.col("_new").isNotNull()
    if gate is not None:
        use = use & F.coalesce("passes_gate", F.lit(False))
    new = F.col("_new.item")
    cited = F.filter(
        F.transform(new, lambda x: F.struct(F.lit("news").alias("type"), x["source_url"].alias("url"),
                                            x["title"].alias("note"))),
        lambda s: ~F.array_contains(c["sources"]["url"], s["url"]))
    return update(df, {
        "adverse_media": F.when(use, F.concat(c["adverse_media"], new)).otherwise(c["adverse_media"]),
        "sources": F.when(use, F.concat(c["sources"], cited)).otherwise(c["sources"]),
    }, report).drop("_new", "passes_gate")
