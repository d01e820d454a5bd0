"""Third-party records normalised: adverse hits, company records, profile records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import cap, clean, contains_any, fold, squeeze
from ..plans.barrier import fenced, filter_computed
from ..plans.joins import with_group_facts
from ..plans.ordering import first_per_key, top_k


def adverse_items(records: DataFrame, keys: list[str], item: str = "item", ordinal: str = "record") -> DataFrame:
    """Adverse hits of provider records as report items: a URL is needed, hits where the
    subject is not the implicated party or the match is weak are dropped, the first item
    of a URL is kept."""
    rows = records.select(
        *keys, F.col(ordinal).alias("_record"), clean(F.col(f"{item}.country")).alias("_country"),
        F.posexplode(f"{item}.hits").alias("_pos", "_hit"))
    hit = F.col("_hit")
    role, match = F.lower(clean(hit["entityRole"])), F.lower(clean(hit["entityMatchConfidence"]))
    rows = rows.filter((clean(hit["url"]) != "") & ~role.isin(*V.NON_ADVERSE_ROLES) & (match != "low"))
    category = F.translate(F.lower(clean(hit["riskCategory"])), " -", "__")
    mapped = F.create_map(*[F.lit(x) for pair in V.ADVERSE_CATEGORY_MAP.items() for x in pair])
    severity = F.lower(clean(hit["severity"]))
    out = rows.select(
        *keys, "_record", "_pos",
        F.coalesce(F.try_element_at(mapped, category), F.lit("reputational")).alias("category"),
        cap(clean(hit["title"]), 300).alias("title"), cap(clean(hit["snippet"]), 1000).alias("summary"),
        cap(clean(hit["publishedDate"]), 50).alias("date"), cap(F.col("_country"), 100).alias("jurisdiction"),
        F.when(severity.isin(*V.CONFIDENCE_LEVELS), severity).otherwise("low").alias("confidence"),
        F.lit("media_report").alias("status_type"), clean(hit["url"]).alias("source_url"))
    out = first_per_key(out, [*keys, "source_url"], [F.col("_record"), F.col("_pos")])
    return out.withColumnsRenamed({"_record": "record", "_pos": "position"})


def company_facts(item: Column) -> Column:
    """Company record to the company fields a provider can fill ('' when absent)."""
    place = F.get(item["locations"], F.lit(0))
    parts = [F.nullif(clean(place[n]), F.lit("")) for n in ("line1", "line2", "city", "geographicArea", "country")]
    employees = F.when(item["employeeCount"] > 0, item["employeeCount"].cast("string"))
    return F.struct(
        clean(item["name"]).alias("company_name"), clean(item["website"]).alias("website"),
        clean(F.get(item["industries"], F.lit(0))["name"]).alias("industry"),
        cap(F.concat_ws(", ", *parts), 300).alias("address"), clean(place["country"]).alias("jurisdiction"),
        clean(item["foundedOn"]["year"]).alias("incorporation_date"),
        clean(item["companyType"]).alias("legal_form"),
        F.struct(F.coalesce(employees, F.lit("")).alias("employees")).alias("financials"))


def flatten_profiles(items: DataFrame, item: str = "item") -> DataFrame:
    """Profile records to (profile_url, profile_name, profile_text); records without URL or
    name, or with almost no text, are dropped."""
    x = F.col(item)

    def filled(c):
        return F.nullif(c, F.lit(""))

    name = F.coalesce(filled(clean(x["name"])), F.concat_ws(" ", filled(x["firstName"]), filled(x["lastName"])))
    posts = F.coalesce(x["currentPosition"], F.array().cast("array<struct<position:string,companyName:string,description:string,companyLinkedinUrl:string>>"))
    held = F.filter(posts, lambda p: (clean(p["position"]) != "") | (clean(p["companyName"]) != ""))
    df = items.withColumn("_first", F.get(held, F.lit(0)))
    first = F.col("_first")
    title = clean(F.coalesce(filled(x["headline"]), x["position"]))
    description = F.rtrim(cap(squeeze(F.coalesce(first["description"], F.lit(""))), 400))
    place = F.coalesce(filled(x["location"]["parsed"]["text"]), x["location"]["linkedinText"])
    about = F.rtrim(cap(squeeze(F.coalesce(x["about"], F.lit(""))), 400))

    def prefixed(name_, value):
        return F.concat(F.lit(V.FIELD_PREFIXES[name_] + " "), filled(value))

    lines = F.array_compact(F.array(
        filled(clean(name)), filled(title),
        prefixed("metier", F.coalesce(filled(clean(first["position"])), title)),
        prefixed("entreprise", clean(first["companyName"])),
        prefixed("company_url", clean(first["companyLinkedinUrl"])),
        prefixed("missions", description), prefixed("location", place), prefixed("about", about)))
    current = F.filter(
        F.transform(F.slice(posts, 1, 2), lambda p: F.concat_ws(
            " - ", filled(clean(p["position"])), filled(clean(p["companyName"])))),
        lambda s: s != "")
    out = df.withColumns({
        "profile_url": clean(x["linkedinUrl"]), "profile_name": clean(name),
        "profile_text": F.array_join(F.concat(lines, current), "\n")})
    usable = (F.col("profile_url") != "") & (F.col("profile_name") != "") & (F.length("profile_text") >= 5)
    return filter_computed(out, usable).drop("_first", item)


def importance(folded: Column) -> Column:
    """Seniority tier of the first tier with a term, plus a bonus for sector terms, of a folded text."""
    tier = F.lit(0)
    for points, terms in reversed(V.SENIORITY_TIERS):
        tier = F.when(contains_any(folded, terms), points).otherwise(tier)
    return tier + F.when(contains_any(folded, V.SECTOR_TERMS), V.SECTOR_BONUS).otherwise(0)


def select_profiles(profiles: DataFrame, leads: DataFrame, n: int, key: str = "lead_id",
                    ordinal: str = "ordinal") -> DataFrame:
    """Best ``n`` homonyms per lead: those naming a context term of the lead in arrival
    order when there is any, else by importance (0 is dropped)."""
    context = leads.select(key, F.filter(
        F.array(*[fold(clean(F.col(c)), "marks") for c in ("company_name", "country", "city")]),
        lambda t: t != "").alias("_context"))
    df = fenced(profiles.withColumn("_text", fold(F.col("profile_text"), "marks")))
    df = fenced(df.withColumn("importance", importance(F.col("_text"))))
    df = with_group_facts(df, context, key, ordinal, "left").withColumn(
        "corroborated", F.coalesce(F.exists("_context", lambda t: F.contains(F.col("_text"), t)), F.lit(False))
    ).drop("_text", "_context")
    # the n best of both kinds reach one task per lead, whatever the lead's size
    useful = filter_computed(df, F.col("corroborated") | (F.col("importance") > 0))
    order = [F.when(F.col("corroborated"), 0).otherwise(-F.col("importance")), F.col(ordinal)]
    picked = top_k(useful, [key, "corroborated"], order, n, "_rank")
    # at most 2n rows of a lead are left, so one window settles which kind is wanted
    picked = picked.withColumn("_any", F.max("corroborated").over(Window.partitionBy(key)))
    return picked.filter(F.col("corroborated") == F.col("_any")).withColumnRenamed("_rank", "rank").drop("_any")


def swap_richer(selected: DataFrame, refetched: DataFrame, keys: list[str], url: str = "profile_url") -> DataFrame:
    """Replace a selected profile by the re-fetched record of the same URL."""
    rich = first_per_key(refetched, [*keys, url], [F.col("ordinal")]).select(
        *keys, url, F.col("profile_text").alias("_rich"))
    return selected.join(rich, [*keys, url], "left").withColumn(
        "profile_text", F.coalesce("_rich", "profile_text")).drop("_rich")
