"""Many stored searches against the catalogue at once.

A search means what ``catalogue.filter_catalogue``, ``filter_price`` and ``filter_cabins`` mean.  Testing every
search on every listing would be a nested loop, so each search reaches listings by an equi-join on one of its
conditions, and its others are tested on the rows found:

* a text by its rarest trigram among the listings (shorter texts by their whole one or two characters);
* a range by binary intervals: a range of numbers is a union of at most two intervals a level, and a number lies in
  one interval a level, so few rows of either side meet exactly once;
* a broker by its id, a star by itself, and a search without conditions by a key that all listings have.

A key is one number, its kind in the upper bits.  A listing sends only the kinds of keys some search uses, and of
those only the keys that some search has.

The work of a key is its listings times its searches, which no shuffle sees: a key whose product is large is cut into
tiles of its listings, each of which meets all searches of the key, and there are as many tasks as the products ask for.

Rows that an explode multiplies are joined by sort-merge only: Spark takes their size for that of the table they come
from, and would build a broadcast of a hundred times that size in the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import with_price
from ..session import materialise
from .catalogue import COLUMNS, unique_names

#: Columns of a stored search, with their types; null, empty and 0 mean "not set".
SEARCH = {"search_id": "string", "search": "string", "location": "string", "broker": "string", "min_length": "double",
          "max_length": "double", "min_price": "double", "max_price": "double", "min_cabins": "int", "max_cabins": "int",
          "starred": "boolean"}
#: Levels of binary intervals over the whole numbers from 0 below 2 to this power; larger ones share the last.
LEVELS = 32
#: Ways in which a search reaches listings, and the bits of a key below its way.
KINDS = ("owner", "text1", "text2", "text3", "place1", "place2", "place3", "price", "length", "cabins", "starred", "all")
BITS = 58
#: Work of a task on average and of a tile at most, in pairs that are tested; at most so many tasks.
PAIRS, TASKS = 50_000_000, 20_000
#: Pairs that cost as much as a listing that is sent, and pairs for which no key is cut.
SENT, SMALL = 16, 100_000
#: Listings of a tile at least: a search is sent to every tile of its key, and has to be worth it.
TILE = 2_000
#: Keys that are cut into tiles at most, those with most pairs first.
CUT = 10_000
#: Values of the hash by which a listing knows the keys that searches have; a multiple of 64.
BUCKETS = 1 << 16
_BUCKET = f"pmod(xxhash64(key), {BUCKETS})"


def _grams(text: Column, n: Column | int) -> Column:
    """Distinct runs of ``n`` characters."""
    last = F.length(text) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n) if isinstance(n, int) else n)))


def _whole(number: Column) -> Column:
    """A number as a whole one from 0 below 2 ** LEVELS; the order is kept, so a range never loses a number."""
    return F.least(F.greatest(F.floor(number), F.lit(0)), F.lit((1 << LEVELS) - 1)).cast("long")


def _interval(level: Column, place: Column) -> Column:
    return level.cast("long") * F.lit(1 << (LEVELS + 1)) + place


def _holding(number: Column, first: int = 0) -> Column:
    """All binary intervals that hold the number, counted from ``first``."""
    n = _whole(number)
    return F.array(*[F.lit(first + (v << (LEVELS + 1))) + F.shiftright(n, v) for v in range(LEVELS + 1)])


def _cover(low: Column, high: Column) -> Column:
    """Binary intervals whose union is the range, both ends included."""
    a, b = _whole(F.coalesce(low, F.lit(0.0))), _whole(F.coalesce(high, F.lit(float((1 << LEVELS) - 1))))

    def level(v: Column) -> Column:
        """Of a level the intervals inside the range that are in no larger interval inside it."""
        size = F.pow(F.lit(2.0), v)
        first, last = F.ceil(a / size), F.floor((b + 1) / size) - 1
        left = F.when((first <= last) & (first % 2 == 1), F.array(first))
        right = F.when((first <= last) & (last % 2 == 0), F.array(last))
        none = F.array().cast("array<bigint>")
        ends = F.array_distinct(F.concat(F.coalesce(left, none), F.coalesce(right, none)))
        return F.transform(ends, lambda place: _interval(v, place))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), level))


def _first(kind: str) -> int:
    """The first key of a kind; the others are less than 2 ** BITS further."""
    return KINDS.index(kind) << BITS


def _hashed(texts: Column, first: int = 0) -> Column:
    return F.array_distinct(F.transform(texts, lambda text: F.xxhash64(text).bitwiseAND(F.lit((1 << BITS) - 1)) + F.lit(first)))


def _set(c: Column) -> Column:
    """Whether a bound is set."""
    return F.coalesce(c, F.lit(0)) != 0


def _ranged(name: str) -> Column:
    return _set(F.col(f"min_{name}")) | _set(F.col(f"max_{name}"))


def _marks(keys: DataFrame, *more: Column) -> list:
    """For each kind and each 64 hash values of the keys: ``kind``, ``at``, ``bits`` with a bit for each value that occurs."""
    return keys.groupBy(F.shiftright("key", BITS).cast("int").alias("kind"), F.expr(f"CAST({_BUCKET} DIV 64 AS INT)").alias("at")).agg(
        F.expr(f"bit_or(shiftleft(1L, CAST({_BUCKET} % 64 AS INT)))").alias("bits"), *more).collect()


def _marked(marks: list) -> Column:
    """Whether ``key`` may be one of the keys: true for all of them and for few others."""
    words = [0] * (BUCKETS // 64)
    for r in marks:
        words[r["at"]] |= r["bits"]
    table = F.expr(f"array({', '.join(f'{w}L' for w in words)})")
    return F.getbit(F.get(table, F.expr(f"CAST({_BUCKET} DIV 64 AS INT)")), F.expr(f"CAST({_BUCKET} % 64 AS INT)")) == 1


def match_searches(searches: DataFrame, listings: DataFrame, brokers: DataFrame, mode: str = "corrected",
                   columns: dict | None = None, broker_key: str = "id", broker_name: str = "broker_name") -> DataFrame:
    """(search_id, id): every listing each stored search finds.  A broker that no name, or several, matches finds none."""
    c = {**COLUMNS, **(columns or {})}
    spark = listings.sparkSession  # asked, counts and their marks are worked out while the plan is built
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a file of one row group is one task, and the keys of a row cost far more than the row
    priced = with_price(listings.select(*{c[n]: 0 for n in COLUMNS if n != "year"}).repartition(tasks), c["price"], "_price", mode)
    rows = priced.select(
        F.col(c["id"]).alias("id"), F.lower(c["name"]).alias("_name"), F.lower(c["builder"]).alias("_builder"),
        F.lower(c["location"]).alias("_location"), F.col(c["owner"]).cast("string").alias("_owner"),
        F.col(c["length"]).cast("double").alias("_length"), F.col("_price").cast("double").alias("_price"),
        F.col(c["cabins"]).cast("int").alias("_cabins"), F.coalesce(F.col(c["starred"]), F.lit(False)).alias("_starred"))
    names = unique_names(brokers, broker_name, broker_key)
    asked = searches.select(*[F.col(n).cast(t).alias(n) for n, t in SEARCH.items()]).repartition(tasks).withColumns({
        "_text": F.nullif(F.lower("search"), F.lit("")), "_place": F.nullif(F.lower("location"), F.lit("")),
        "_by": F.nullif(F.lower(F.trim("broker")), F.lit("")),
        **{n: F.when(_set(F.col(n)), F.col(n)) for n in SEARCH if n.startswith(("min_", "max_"))}})
    asked = asked.join(names.select(F.col("_name").alias("_by"), F.col("_id").cast("string").alias("_broker_id")), "_by", "left") \
        .filter(F.col("_by").isNull() | F.col("_broker_id").isNotNull())

    def gram_kind(text: str, prefix: str) -> Column:
        return F.concat(F.lit(prefix), F.least(F.length(text), F.lit(3)).cast("string"))

    kind = F.when(F.col("_broker_id").isNotNull(), "owner") \
        .when(F.col("_text").isNotNull(), gram_kind("_text", "text")) \
        .when(F.col("_place").isNotNull(), gram_kind("_place", "place")) \
        .when(_ranged("price"), "price").when(_ranged("length"), "length").when(_ranged("cabins"), "cabins") \
        .when(F.coalesce("starred", F.lit(False)), "starred").otherwise("all")

    def bound(name: str) -> Column:
        return F.col(name).cast("double")

    def cover(name: str) -> Column:
        return _cover(bound(f"min_{name}"), bound(f"max_{name}"))

    gram_size = F.least(F.length(F.coalesce("_text", "_place")), F.lit(3))
    by_gram = F.startswith("_kind", F.lit("text")) | F.startswith("_kind", F.lit("place"))
    numbers = F.when(F.col("_kind") == "owner", _hashed(F.array("_broker_id"))) \
        .when(by_gram, _hashed(_grams(F.coalesce("_text", "_place"), gram_size))) \
        .when(F.col("_kind") == "price", cover("price")).when(F.col("_kind") == "length", cover("length")) \
        .when(F.col("_kind") == "cabins", cover("cabins")).otherwise(F.array(F.lit(0).cast("long")))
    first = F.element_at(F.lit([_first(k) for k in KINDS]), F.array_position(F.lit(list(KINDS)), F.col("_kind")).cast("int"))
    asked = materialise(asked.withColumn("_kind", kind).withColumn("_first", first).withColumn("_numbers", numbers).withColumn(
        "_keys", F.transform("_numbers", lambda number: F.col("_first") + number)).drop("_first", "_numbers"))

    none = F.array().cast("array<bigint>")

    def sent(kind: str) -> Column:
        """The keys of a kind that a listing has."""
        first = _first(kind)
        if kind.startswith("text"):
            return F.array_union(*[F.coalesce(_hashed(_grams(F.col(n), int(kind[-1])), first), none) for n in ("_name", "_builder")])
        if kind.startswith("place"):
            return _hashed(_grams(F.col("_location"), int(kind[-1])), first)
        if kind == "owner":
            return F.when(F.col("_owner").isNotNull(), _hashed(F.array("_owner"), first))
        if kind in ("price", "length", "cabins"):
            return F.when(F.col(f"_{kind}").isNotNull(), _holding(F.col(f"_{kind}").cast("double"), first))
        return F.when(F.col("_starred") | F.lit(kind == "all"), F.array(F.lit(first)))

    def sending(marks: list) -> DataFrame:
        """A row for each listing and marked key."""
        found_by = F.concat(none, *[F.coalesce(sent(KINDS[k]), none) for k in sorted({r["kind"] for r in marks})])
        return rows.withColumn("key", F.explode(found_by)).filter(_marked(marks))

    # of a text the key that fewest listings have; of the others all keys
    each = asked.select("search_id", "_kind", by_gram.alias("_one"), F.explode("_keys").alias("key")).distinct()
    counts = materialise(sending(_marks(each)).groupBy("key").agg(F.count(F.lit(1)).alias("_n")))
    rarest = each.filter("_one").join(counts.hint("merge"), "key", "left").groupBy("search_id", "_kind").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "key"))["key"].alias("key"))
    path = rarest.select("search_id", "key").unionByName(each.filter("NOT _one").select("search_id", "key"))
    conditions = path.join(asked.drop("_kind", "_keys").hint("merge"), "search_id")

    # what each key will cost
    products = conditions.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).join(counts.hint("merge"), "key").select(
        "key", (F.col("_n") * (F.col("_m") + SENT).cast("double")).alias("cost"), F.ceil(F.col("_n") / TILE).cast("int").alias("most"))
    marks = _marks(products, F.sum("cost").alias("cost"))
    total = sum(r["cost"] for r in marks)
    tasks = max(tasks, min(TASKS, math.ceil(total / PAIRS)))
    tile = max(SMALL, min(PAIRS, total / (2 * tasks)))
    large = products.filter((F.col("cost") > tile) & (F.col("most") > 1)).orderBy(F.desc("cost")).limit(CUT).collect() if total > tile else []
    cut = [(r["key"], min(r["most"], math.ceil(r["cost"] / tile))) for r in large]
    found, at = sending(marks), ["key"]
    if cut:
        tiles = F.broadcast(spark.createDataFrame(cut, "key long, _tiles int"))
        number = F.coalesce("_tiles", F.lit(1))
        found = found.join(tiles, "key", "left").withColumn("_tile", F.pmod(F.xxhash64(*rows.columns), number).cast("int")).drop("_tiles")
        conditions = conditions.join(tiles, "key", "left").withColumn("_tile", F.explode(F.sequence(F.lit(0), number - 1))).drop("_tiles")
        at = ["key", "_tile"]

    def inside(value: str, name: str) -> Column:
        """A bound that is set holds for a value that is there."""
        low, high = F.col(f"min_{name}"), F.col(f"max_{name}")
        return (low.isNull() | F.coalesce(F.col(value) >= low, F.lit(False))) & (high.isNull() | F.coalesce(F.col(value) <= high, F.lit(False)))

    def holds(text: str, part: str) -> Column:
        return F.coalesce(F.contains(F.col(text), F.col(part)), F.lit(False))

    # fewer searches than listings share a key; they are the side a sort-merge join keeps in memory
    pairs = found.repartition(tasks, *at).join(conditions.repartition(tasks, *at).hint("merge"), at)
    return pairs.filter(
        inside("_length", "length") & inside("_price", "price") & inside("_cabins", "cabins")
        & (~_ranged("cabins") | (F.coalesce("_cabins", F.lit(0)) != 0))
        & (~F.coalesce("starred", F.lit(False)) | F.col("_starred"))
        & (F.col("_broker_id").isNull() | F.coalesce(F.col("_owner") == F.col("_broker_id"), F.lit(False)))
        & (F.col("_text").isNull() | holds("_name", "_text") | holds("_builder", "_text"))
        & (F.col("_place").isNull() | holds("_location", "_place"))).select("search_id", "id")
