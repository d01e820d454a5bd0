"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share a total by weight; a target stops at ``most`` times the words its source
has, and the excess is shared again by weight (the fixed point of a rising water level).

Copies: with target / size = whole + f, every document of the source is certain to be taken
``whole`` times.  The rest is an order sample: each document draws a uniform number u from a hash
of its id and is ranked by its random odds u / (1 - u) divided by its inclusion odds f / (1 - f)
(times ``preference``, when a column with relative odds is given).  The sample is fixed in size:
the ranking is cut where the words taken come nearest to what is left of the target.

Scale: the text is read once, to count words; from then on rows are (id, source number, words,
rank key).  The cut of a source is found by radix selection over the 52-bit keys: words are summed
per (source, key digits) with map-side aggregation, so a source with a third of all rows is never
sorted or gathered.  Sources are numbered by a range sort, so they may be many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import materialise

WORD = "[^\\x20\\x09-\\x0D]+"
KEY_BITS = 52
DIGIT_BITS = (12, 12, 28)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform_key(row_id: Column) -> Column:
    """52 bits of the SHA-256 of the id's text; a null id reads as empty text."""
    digest = F.sha2(F.coalesce(row_id.cast("string"), F.lit("")), 256)
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, from 0: sorted by range, so that a task holds
    a range only, and shifted by the counts of the ranges before it."""
    placed = materialise(
        sizes.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(
            Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(before, "_part").select(
        "source", "source_size", (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_sid"))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, _sid, target for (source, source_size)."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_sid") % len(weights) + 1).cast("int"))
    sources = materialise(numbered_sources(sizes).withColumn("_weight", weight))
    room = F.lit(float(most)) * F.col("source_size")
    total = sources.agg(F.sum("source_size").alias("words"), F.sum("_weight").alias("weight")).first()
    pool = share * float(total["words"] or 0)
    level = pool / total["weight"] if total["weight"] else 0.0
    full = -1
    while True:  # the level only rises, and stops when no further source is above its room
        above = F.lit(level) * F.col("_weight") > room
        state = sources.agg(
            F.count_if(above).alias("full"), F.sum(F.when(above, room).otherwise(0.0)).alias("held"),
            F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))).alias("weight")).first()
        if state["full"] == full or not state["weight"]:
            break
        full, level = state["full"], (pool - state["held"]) / state["weight"]
    return sources.select("source", "source_size", "_sid",
                          F.least(room, F.lit(level) * F.col("_weight")).alias("target"))


def cut(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_sid, _cut): the key up to which documents are taken, per source of ``wanted`` (_sid, _rest).

    A key is taken if the words before it and half its own are at most the rest, which is the
    prefix of the ranking nearest to the rest.  Digit by digit: whole buckets within the rest are
    in, the first one that is not is opened.  The first sums are made before they meet the rests, and
    later rows meet the opened buckets on source and bucket, so no join gathers a source.
    """
    low = KEY_BITS
    for bits in DIGIT_BITS:
        low -= bits
        path = F.shiftright("_key", low).alias("_path")
        if low + bits == KEY_BITS:
            sums = keyed.groupBy("_sid", path).agg(F.sum("size").alias("_words"))
        else:
            opened = state.withColumnRenamed("_path", "_bucket")
            inside = keyed.withColumn("_bucket", F.shiftright("_key", low + bits)).join(opened, ["_sid", "_bucket"])
            sums = inside.groupBy("_sid", path).agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"))
        # written, so that sums are complete before the rows of a source meet: at most one per bucket
        sums = materialise(sums)
        if low + bits == KEY_BITS:
            sums = sums.join(wanted, "_sid")
        upto = Window.partitionBy("_sid").orderBy("_path")
        sums = sums.withColumn("_through", F.sum("_words").over(upto))
        if low:
            state = (sums.filter(F.col("_through") > F.col("_rest"))
                     .groupBy("_sid").agg(F.min(F.struct(
                         "_path", (F.col("_rest") - F.col("_through") + F.col("_words")).alias("_rest"))).alias("_b"))
                     .select("_sid", F.col("_b._rest").alias("_rest"), F.col("_b._path").alias("_path")))
            # the bucket before the opened one is the cut if nothing inside fits
            floors = state.select("_sid", (F.shiftleft("_path", low) - 1).alias("_floor"))
        else:
            taken = sums.filter(F.col("_through") - F.col("_words") / 2 <= F.col("_rest")).groupBy("_sid").agg(
                F.max("_path").alias("_cut"))
    return floors.join(taken, "_sid", "left").select("_sid", F.coalesce("_cut", "_floor").alias("_cut"))


def relative_odds(preference: str | None) -> Column:
    return F.coalesce(F.col(preference).cast("double"), F.lit(1.0)) if preference else F.lit(1.0)


def rank_key(doc_id: Column, share: Column, odds: Column) -> Column:
    """Random odds over inclusion odds as an integer that keeps the order; last if nothing is drawn."""
    u = (uniform_key(doc_id) + F.lit(0.5)) / F.lit(float(1 << KEY_BITS))
    ranked = F.try_divide(u / (1 - u), F.try_divide(share, 1 - share) * odds)
    return F.when(share > 0, F.floor(ranked / (1 + ranked) * F.lit(float(1 << KEY_BITS)))).otherwise(
        F.lit(1 << KEY_BITS) - 1).cast("long")


def decided(docs: DataFrame, doc_id: str, text: str, source: str, weights: Sequence[float], share: float,
            most: float, preference: str | None) -> tuple[DataFrame, DataFrame]:
    """The narrow rows with their rank keys, and per source what its documents get: ``_whole`` copies,
    and one more up to the key ``_cut``."""
    rows = materialise(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        relative_odds(preference).alias("_odds")))
    planned = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    size = F.col("source_size")
    planned = materialise(
        planned.withColumn("_whole", F.coalesce(F.floor(F.try_divide("target", size)), F.lit(0)).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("_whole") * size)
        .withColumn("_share", F.try_divide("_rest", size))
        .withColumnRenamed("source", "_source"))
    keyed = materialise(
        rows.join(planned, rows["source"].eqNullSafe(planned["_source"]))
        .withColumn("_key", rank_key(F.col("doc_id"), F.col("_share"), F.col("_odds")))
        .drop("_source", "_odds"))
    # a source whose rest is nothing has no sample
    wanted = planned.filter(F.col("_rest") > 0).select("_sid", "_rest")
    cuts = cut(keyed.select("_sid", "_key", "size"), wanted)
    return keyed, materialise(planned.join(cuts, "_sid", "left").select("_sid", "_source", "_whole", "_share", "_cut"))


def copies() -> Column:
    return F.col("_whole") + F.when(F.col("_key") <= F.col("_cut"), 1).otherwise(0)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        preference: str | None = None) -> DataFrame:
    """doc id, source, size, source_size, target, copies, taken (words, repeats counted) per row.

    Null text has no words; null source is a source of its own and comes last; a document without
    words takes no words.  Rows with one id share a draw: they are taken or left together.  Other
    columns are not read; an empty table gives an empty mix.  ``preference``: column of positive
    relative odds, which makes inclusion unequal inside a source as well (null counts as 1).
    """
    keyed, plan = decided(docs, doc_id, text, source, weights, share, most, preference)
    return keyed.join(plan.select("_sid", "_cut"), "_sid", "left").select(
        F.col("doc_id").alias(doc_id), F.col("source").alias(source), "size", "source_size", "target",
        copies().alias("copies"), (copies() * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
          preference: str | None = None) -> DataFrame:
    """The rows that :func:`mix` takes, whole, with ``copies``.  Rows meet the plan of their source, one
    row each, and draw again from their id: texts need no join on documents."""
    _, plan = decided(docs, doc_id, text, source, weights, share, most, preference)
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_doc"), F.col(source).alias("_src"),
                       relative_odds(preference).alias("_odds"))
    drawn = rows.join(plan, F.col("_src").eqNullSafe(F.col("_source"))).withColumn(
        "_key", rank_key(F.col("_doc"), F.col("_share"), F.col("_odds"))).withColumn("_copies", copies())
    return drawn.filter(F.col("_copies") > 0).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "copies"], F.col("_copies").alias("copies"))
