"""Text columns: trimming, folding, redaction and display formats."""

import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import SECRET_PATTERN, WHITESPACE, WS


def strip(c: Column) -> Column:
    """Trim every kind of whitespace (the built-in ``trim`` only drops blanks)."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean(c: Column) -> Column:
    """Stripped text, '' for null."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return strip(F.regexp_replace(c, WS + "+", " "))


def cap(c: Column, n: int | None) -> Column:
    return c if n is None else F.left(c, F.lit(n))


def contains_any(c: Column, terms, word_boundary: bool = False) -> Column:
    """True where any term occurs.  Substring by default; whole words on demand."""
    if word_boundary:
        body = "|".join(t.strip() for t in terms)
        return c.rlike(rf"\b(?:{body})\b")
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(c, F.lit(term))
    return found


@lru_cache(maxsize=None)
def fold_table(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Character table of a Unicode decomposition, built from the Unicode data.

    Returns (from, to, expansions) for ``translate``: one-to-one replacements, then the
    combining marks, which have no counterpart and are deleted; and apart from these
    the Latin characters that expand to several letters.
    """
    single_from, single_to, marks, expansions = [], [], [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        if unicodedata.combining(ch):
            # the canonical form drops only the basic block of marks
            if form == "NFKD" or 0x300 <= code <= 0x36F:
                marks.append(ch)
            continue
        base = unicodedata.normalize(form, ch.casefold() if form == "NFKD" else ch.lower())
        base = "".join(x for x in base if not unicodedata.combining(x))
        if base == ch or not base.isascii() or not base:
            continue
        if len(base) == 1:
            single_from.append(ch)
            single_to.append(base)
        elif base.isalnum() and unicodedata.name(ch, "").startswith("LATIN"):
            expansions.append((ch, base))
    return "".join(single_from + marks), "".join(single_to), tuple(expansions)


FOLD_VARIANTS = {
    # name: (decomposition or None, characters kept besides a-z0-9, None = keep all)
    "evidence": ("NFKD", "@.-"),
    "builder": ("NFD", "@."),
    "recipient": ("NFD", ""),
    "plain": (None, ""),
    "marks": ("NFKD", None),
}


def other_than(keep: str) -> str:
    """Character class of everything but a-z, 0-9 and ``keep``.

    Written as positive ranges: the regex engine matches those several times faster
    than a negated class of many parts."""
    kept = sorted({*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *map(ord, keep)})
    ranges, start = [], 0
    for code in [*kept, 0x110000]:
        if code > start:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{code - 1:x}}}")
        start = code + 1
    return "[" + "".join(ranges) + "]"


def fold(c: Column, variant: str = "evidence") -> Column:
    """Comparable form of a text; JVM built-ins only.

    Exact for every BMP character that decomposes to one ASCII character and for
    the Latin characters that expand to several (ß, ligatures, digraphs).  Plain ASCII
    texts skip the character table.
    """
    form, keep = FOLD_VARIANTS[variant]
    out = F.lower(c)
    if form:
        source, target, expansions = fold_table(form)
        folded = out
        if expansions:
            common, *rare = expansions
            folded = F.replace(folded, F.lit(common[0]), F.lit(common[1]))
            expanded = folded
            for ch, base in rare:
                expanded = F.replace(expanded, F.lit(ch), F.lit(base))
            marker = "[" + "".join(ch for ch, _ in rare) + "]"
            folded = F.when(out.rlike(marker), expanded).otherwise(folded)
        folded = F.translate(folded, source, target)
        out = F.when(F.octet_length(out) > F.length(out), folded).otherwise(out)
    if keep is None:
        return out
    out = F.regexp_replace(out, other_than(keep) + "+", " ")
    return F.trim(out)


def fold_arrow(variant: str = "evidence"):
    """Opt-in Arrow version of :func:`fold`, complete for every Unicode script.

    Whole batches go through Arrow's string kernels; no Python runs per row."""
    form, keep = FOLD_VARIANTS[variant]
    marks = r"\p{M}+" if form == "NFKD" else "[\u0300-\u036f]+"
    drop = None if keep is None else other_than(keep) + "+"

    @F.arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        out = pc.utf8_lower(values)
        if form == "NFKD":
            out = pc.replace_substring(out, "ß", "ss")
        if form:
            out = pc.replace_substring_regex(pc.utf8_normalize(out, form), marks, "")
        return out if drop is None else pc.utf8_trim(pc.replace_substring_regex(out, drop, " "), " ")

    return apply


def redact(c: Column, limit: int | None = 500) -> Column:
    """Replace ``key: value`` secrets, collapse whitespace, cap the length."""
    return cap(F.regexp_replace(squeeze(c), SECRET_PATTERN, "$1=[redacted]"), limit)


def display_name(display: Column, first: Column, last: Column, fallback: str) -> Column:
    """Display name, else first and last name, else a fixed text."""
    def filled(c):
        return F.nullif(c, F.lit(""))

    joined = F.concat_ws(" ", filled(first), filled(last))
    return F.coalesce(filled(display), F.nullif(joined, F.lit("")), F.lit(fallback))


def initials(name: Column) -> Column:
    parts = F.split(strip(name), " ")
    first = F.left(F.element_at(parts, 1), F.lit(1))
    last = F.when(F.size(parts) > 1, F.left(F.element_at(parts, -1), F.lit(1))).otherwise("")
    return F.upper(F.concat(first, last))


def truncate(c: Column, length: int) -> Column:
    return F.when(F.length(c) <= length, c).otherwise(F.concat(F.left(c, F.lit(length)), F.lit("...")))


def format_fr(c: Column, decimals: int = 0, flexible: bool = False) -> Column:
    """French number text: narrow no-break space for thousands, decimal comma.

    ``flexible`` drops trailing zeros of the decimals."""
    text = F.format_number(c, decimals)
    if flexible and decimals > 0:
        text = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    return F.translate(text, ",.", " ,")


def metres_to_feet(c: Column) -> Column:
    from .vocab import METRES_TO_FEET
    return c * F.lit(METRES_TO_FEET)


def feet_to_metres(c: Column) -> Column:
    from .vocab import METRES_TO_FEET
    return c / F.lit(METRES_TO_FEET)


def email_domain(email: Column) -> Column:
    """Domain of an address with exactly one ``@``; '' when it is not a host name."""
    text = F.coalesce(email, F.lit(""))
    one_at = F.length(text) - F.length(F.replace(text, F.lit("@"), F.lit(""))) == 1
    domain = F.rtrim(F.lower(strip(F.substring_index(text, "@", -1))), F.lit("."))
    return F.when(one_at & domain.rlike(r"^[a-z0-9.\-]+\.[a-z]{2,}$"), domain).otherwise(F.lit(""))


def is_free_mail(domain: Column, providers) -> Column:
    return domain.isin(*providers)


def name_tokens(full_name: Column) -> Column:
    """Folded name tokens of two characters or more."""
    return F.filter(F.split(fold(full_name), " "), lambda t: F.length(t) >= 2)


def name_orders(full_name: Column) -> Column:
    """(first, last) and the swapped order; empty for a single word."""
    text = squeeze(full_name)
    first = F.substring_index(text, " ", 1)
    rest = F.substr(text, F.length(first) + F.lit(2))
    pair = F.array(
        F.struct(F.lit(1).alias("attempt"), first.alias("first_name"), rest.alias("last_name")),
        F.struct(F.lit(2).alias("attempt"), rest.alias("first_name"), first.alias("last_name")),
    )
    return F.when(F.contains(text, F.lit(" ")), pair).otherwise(F.slice(pair, 1, 0))
