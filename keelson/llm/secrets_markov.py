"""Secret scans: fixed patterns, and strings that a character Markov model calls random.

Three patterns find assignments to names like ``password``, access keys and long hex runs.  Further
runs of key characters, in what the patterns leave of a text, are candidates: two first-order character models, one of random strings and
one of ordinary identifiers, give each a log-likelihood ratio, and those above ``threshold`` are
spans of the kind ``markov``.  Both models are counted over the whole
corpus: what the patterns matched anywhere is random; runs in documents without any match that are
built like identifiers are ordinary.

DataFrame functions only.  Texts are read once for all patterns, and again for the ordinary runs,
which are too many to keep; what is kept in between is a narrow table of matches.  Spans are worked out inside each row, so
nothing is shuffled but pair counts, of which there are at most as many as pairs of characters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.session import materialise

# fixed values: the patterns of the contract; a match counts from so many characters of the group on
PATTERNS = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    # greedy runs from the first AKIA on: the shorter ones that are dropped cannot hide a longer match
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
}
KINDS = (*PATTERNS, "markov")
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
# an ordinary identifier: words of one case or with a capital, joined or followed by digits
PART = "(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)"
ORDINARY = f"(?<![A-Za-z0-9+/_-]){PART}(?:[_/-]?(?:{PART}|[0-9]++))*+(?![A-Za-z0-9+/_-])"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SIDE = len(ALPHABET) + 1  # 0 stands for the start and for any other character
THRESHOLD = 12.0
#: A random string has at least so many different characters; lines of dashes have not.
DIFFERENT = 8
SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def in_blocks(items: Column, body: Callable[[Column], Column], kind: str, levels: int = 1) -> Column:
    """``body`` of the items cut into blocks.  With blocks cut again, ``levels`` deep in all, each level cuts into
    about as many parts, and so many items are left in the smallest blocks."""
    def cut(s: Column) -> Column:
        last = F.ceil(F.size(s["items"]) / s["size"]).cast("int") - 1
        return body(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(s["items"], k * s["size"] + 1, s["size"])))

    size = F.greatest(F.ceil(F.pow(F.size(items), F.lit(levels / (levels + 1)))), F.lit(1)).cast("int")
    return F.when(F.size(items) > 0, let(F.struct(items.alias("items"), size.alias("size")), cut)).otherwise(
        F.array().cast(kind))


def running(values: Column, op: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """Of every place the whole numbers before it, folded by ``op`` from 0 on; ``op`` is associative and 0 changes nothing.
    Blocks are folded as wholes, and inside a block blocks again, so n numbers take about n to the power
    of 4/3 steps and no list is copied for each."""
    def folded(parts: Column) -> Column:
        def places(s: Column) -> Column:
            return F.flatten(F.transform(s["parts"], lambda p, k: let(
                F.aggregate(F.slice(s["totals"], F.lit(1), k), F.lit(0), op),
                lambda before: F.transform(running(p, op, levels - 1), lambda x: op(before, x)))))

        return let(parts, lambda ps: let(F.struct(
            ps.alias("parts"), F.transform(ps, lambda p: F.aggregate(p, F.lit(0), op)).alias("totals")), places))

    if levels == 0:
        return F.transform(values, lambda _, j: F.aggregate(F.slice(values, F.lit(1), j), F.lit(0), op))
    return in_blocks(values, folded, "array<int>", levels)


def found(text: Column, pattern: str, group: int, least: int) -> Column:
    """start, end (code points) and the group's text of the matches, leftmost first, none overlapping.

    The pieces between the matches give their places: lengths of pieces and matches add up."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def placed(s: Column) -> Column:
        sizes = F.zip_with(s["gaps"], s["whole"], lambda g, w: F.struct(F.length(g).alias("g"), F.length(w).alias("w")))
        return let(sizes, lambda z: F.zip_with(
            F.zip_with(z, running(F.transform(z, lambda x: x["g"] + x["w"]), lambda x, y: x + y), lambda x, at: F.struct(
                (at + x["g"]).alias("start"), (at + x["g"] + x["w"]).alias("end"))),
            s["value"], lambda x, v: F.struct(x["start"].alias("start"), x["end"].alias("end"), v.alias("value"))))

    def matches(s: Column) -> Column:
        return let(F.struct(F.slice(s["gaps"], F.lit(1), F.size(s["whole"])).alias("gaps"), s["whole"].alias("whole"),
                            s["value"].alias("value")), placed)

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), value.alias("value"))
    return F.when(text.rlike(pattern), F.filter(let(parts, matches), lambda x: F.length(x["value"]) >= least)).otherwise(
        F.array().cast(SPAN))


def replaced(text: Column, found_spans: Column, filler: Callable[[Column], Column]) -> Column:
    """The text with ``filler`` of (at, start, end) for every span, sorted by start; ``at`` is where the spans before end.
    A block of spans is cut from the text as one piece, a smaller block from that piece, and so on: to cut is to
    read a text from its start, so no long text is read for every span."""
    ends = running(F.transform(found_spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    placed = F.zip_with(ends, found_spans, lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end")))

    def pieces(items: Column, own: Column, first: Column, levels: int) -> Column:
        """The text up to the last start, with fillers; ``own`` is the text from ``first`` on."""
        if levels == 0:
            return F.array_join(F.transform(items, lambda x: F.concat(
                F.substring(own, x["at"] - first + 1, x["start"] - x["at"]), filler(x))), "")

        def part(p: Column) -> Column:
            begin = p[0]["at"]
            cut = F.struct(p.alias("p"), begin.alias("first"), F.substring(
                own, begin - first + 1, F.element_at(p, -1)["start"] - begin).alias("own"))
            return let(cut, lambda s: pieces(s["p"], s["own"], s["first"], levels - 1))

        return F.array_join(in_blocks(items, lambda parts: F.transform(parts, part), "array<string>", levels), "")

    def whole(spans_: Column) -> Column:
        last = F.array_max(F.transform(spans_, lambda x: x["end"]))
        return F.concat(pieces(spans_, text, F.lit(0), 2), F.substring(text, last + 1, F.length(text)))

    return F.when(F.size(found_spans) == 0, text).otherwise(let(placed, whole))


def pair_counts(strings: DataFrame) -> DataFrame:
    """(pair, n) over all neighbouring characters of ``value``; pair = 67 * first + second, the
    first of a string coming after 0."""
    chars = F.transform(F.filter(F.split("value", ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.col("_ix")), F.col("_ix"), lambda a, b: a * SIDE + b)
    return (strings.select(chars.alias("_ix")).select(F.explode(pairs).alias("pair"))
            .filter(F.col("pair").isNotNull()).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))


def transitions(counts: DataFrame, weight: float, backed: bool) -> np.ndarray:
    """Transition probabilities, smoothed towards equal ones or (``backed``) towards how often the
    second character occurs at all; the rows to fetch are bounded by the alphabet."""
    table = np.zeros(SIDE * SIDE)
    for r in counts.toLocalIterator():
        table[r["pair"]] = r["n"]
    table = table.reshape(SIDE, SIDE)
    single = table.sum(axis=0) + 0.5 if backed else np.ones(SIDE)
    table = table + weight * single / single.sum()
    return table / table.sum(axis=1, keepdims=True)


def scan(docs: DataFrame, keys: list[str], text: str = "text", keep_text: bool = False) -> DataFrame:
    """Pattern matches and candidates of every row, written once.  Candidates are looked for in what the matches
    leave of the text, so a key beside a match is found, and none overlaps a match."""
    plain = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    matched = plain.withColumns({f"_{k}": found(F.col("_text"), *PATTERNS[k]) for k in PATTERNS})
    base = matched.withColumn("_base", F.array_sort(F.concat(*[marked_as(f"_{k}", k) for k in PATTERNS])))
    rest = base.withColumn("_rest", replaced(F.col("_text"), F.col("_base"), hidden))
    columns = [*keys, *(["_text"] if keep_text else []), *[f"_{k}" for k in PATTERNS], "_base"]
    return materialise(rest.select(*columns, found(F.col("_rest"), CANDIDATE, 0, 20).alias("_candidates")))


def hidden(x: Column) -> Column:
    """As many characters that no candidate holds as the span adds to those before."""
    return F.repeat(F.lit("\x01"), F.greatest(x["end"] - F.greatest(x["start"], x["at"]), F.lit(0)))


def marked_as(column: str, kind: str) -> Column:
    """(start, kind, end) of spans."""
    return F.transform(column, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def ratio_table(scanned: DataFrame, docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(random) - log P(ordinary) of every pair of characters."""
    values = F.concat(*[F.transform(f"_{k}", lambda s: s["value"]) for k in PATTERNS])
    random = pair_counts(scanned.select(F.explode(values).alias("value")))
    clean = docs.select(F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    for pattern, _, _ in PATTERNS.values():
        clean = clean.filter(~F.col("_text").rlike(pattern))
    ordinary = pair_counts(clean.select(F.explode(F.regexp_extract_all("_text", F.lit(ORDINARY), F.lit(0))).alias("value"))
                           .filter(F.length("value") >= 6))
    return np.log(transitions(random, SIDE, False)) - np.log(transitions(ordinary, SIDE / 10, True))


def likelihood_ratio(value: Column, ratios: np.ndarray) -> Column:
    chars = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    flat = F.lit(np.ascontiguousarray(ratios.ravel()))
    steps = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(chars, F.lit(1), F.size(chars) - 1)), chars,
                       lambda a, b: F.get(flat, a * SIDE + b))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def spans(scanned: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Replace candidates by ``_all``: sorted (start, kind, end) of the matches and of the random candidates."""
    added = F.filter("_candidates", lambda c: (F.size(F.array_distinct(F.split(c["value"], ""))) > DIFFERENT)
                     & (likelihood_ratio(c["value"], ratios) > threshold))
    return scanned.withColumn("_markov", added).withColumn(
        "_all", F.array_sort(F.concat("_base", marked_as("_markov", "markov")))).drop("_candidates", "_markov")


def written(column: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat(
        F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                 keep_text: bool = False, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (the key by default), matches by kind, ``_base`` and ``_all`` spans of every row.

    Null and empty texts have no spans; repeated rows are scanned row by row; other columns are not
    read; an empty table gives an empty result."""
    scanned = scan(docs, columns or [key], text, keep_text)
    return spans(scanned, ratio_table(scanned, docs, text), threshold)


def redacted(text: Column, found_spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; overlapping spans share one."""
    return replaced(text, found_spans, lambda x: F.when(x["start"] >= x["at"], F.lit(mark)).otherwise(""))
