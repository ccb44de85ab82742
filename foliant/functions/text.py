"""Scalar functions on text as Spark columns; all stay in the JVM except names in any script and the reference of UUIDs, at the end."""

from __future__ import annotations

import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The patterns of tokens, headings and breaks, one line at a time.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0d\x1c-\x20\p{Z}\x{85}]"
SCENE_BREAK = r"^(?:\*[ \t]*\*[ \t]*\*|---)\z"
CHAPTER_HEADING = r"(?i)^(?:chapter[ \t]+(?:[0-9]+|[ivxlcdm]+)|prologue|epilogue)\.?(?:(?:[ \t]*[:\-\x{2013}\x{2014}][ \t]*|[ \t]+)[^ \t].*)?\z"
MARKDOWN_HEADING = r"^#{1,6}[ \t]+(.+?)(?:[ \t]+#+)?\z"
NUMBER_HEADING = r"^([0-9]+)\z"
ROMAN_HEADING = r"(?i)^([ivxlcdm]+)\.[ \t]+[^ \t].*\z"
HONORIFICS = ("mr", "mrs", "ms", "dr")
PREDICATE = r"^[a-z][a-z0-9_]*\z"
VERB_PREFIXES = ("has_", "is_", "was_", "became_")

_EDGE = r"^[\x09-\x0d\x20]+|[\x09-\x0d\x20]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Array of words and single symbols; null for null."""
    return F.regexp_extract_all(_col(text), F.lit(TOKEN), F.lit(0))


def token_count(text) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def strip(text) -> Column:
    return F.regexp_replace(_col(text), _EDGE, "")


def lines(text) -> Column:
    """Array of stripped lines; CRLF and CR count as line ends."""
    unified = F.regexp_replace(_col(text), r"\r\n?", "\n")
    return F.transform(F.split(unified, "\n", -1), strip)


def is_match(text, pattern: str) -> Column:
    return F.coalesce(_col(text).rlike(pattern), F.lit(False))


def line_kind(line) -> Column:
    """Which rule a stripped line meets first."""
    c = _col(line)
    rules = (("chapter", CHAPTER_HEADING), ("break", SCENE_BREAK), ("markdown", MARKDOWN_HEADING), ("number", NUMBER_HEADING), ("roman", ROMAN_HEADING))
    kind = F.lit("body")
    for name, pattern in reversed(rules):
        kind = F.when(is_match(c, pattern), name).otherwise(kind)
    return F.when(c == "", "blank").otherwise(kind)


def roman_value(numeral) -> Column:
    """Value of a Roman numeral: a sign counts negative where a greater one follows it anywhere."""
    signs = _roman_map()
    chars = F.reverse(F.filter(F.split(F.upper(_col(numeral)), ""), lambda ch: ch != ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def step(acc: Column, ch: Column) -> Column:
        v = F.element_at(signs, ch)
        return F.struct((acc["total"] + F.when(v < acc["most"], -v).otherwise(v)).alias("total"), F.greatest(acc["most"], v).alias("most"))

    return F.aggregate(chars, start, step, lambda acc: acc["total"])


def _roman_map() -> Column:
    pairs = (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def chapter_key(heading) -> Column:
    """The chapter that a heading names, in one form for all spellings; null if it names none."""
    c = strip(heading)
    chapter = F.regexp_extract(c, r"(?i)^chapter[ \t]+([0-9]+|[ivxlcdm]+)(?![\p{L}\p{N}_])", 1)
    part = F.regexp_extract(c, r"(?i)^(prologue|epilogue)(?![\p{L}\p{N}_])", 1)
    number = F.regexp_extract(c, NUMBER_HEADING, 1)
    roman = F.regexp_extract(c, ROMAN_HEADING, 1)
    return (
        F.when(chapter != "", F.concat(F.lit("chapter:"), F.upper(chapter)))
        .when(part != "", F.lower(part))
        .when(number != "", F.concat(F.lit("number:"), F.regexp_replace(number, "^0+(?=[0-9])", "")))
        .when(roman != "", F.concat(F.lit("roman:"), roman_value(roman).cast("string")))
    )


def sha256(text) -> Column:
    return F.sha2(_col(text), 256)


def uuid5(namespace, name) -> Column:
    """Name-based UUID (version 5) of a UUID string column and a name column."""
    space = F.unhex(F.regexp_replace(_col(namespace), "-", ""))
    h = F.sha1(F.concat(space, F.encode(_col(name), "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def excerpt(text, start, end, radius: int = 500) -> Column:
    """The text around a span, at most ``radius`` code points on either side."""
    a = F.greatest(F.lit(0), _col(start) - radius)
    b = F.least(F.length(_col(text)), _col(end) + radius)
    return F.substring(_col(text), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))


def span_matches(text, start, end, surface) -> Column:
    """Whether code points [start, end) of a text are the surface; false if any is null."""
    inside = (_col(start) >= 0) & (_col(end) <= F.length(_col(text)))
    cut = F.substring(_col(text), (_col(start) + 1).cast("int"), F.greatest(_col(end) - _col(start), F.lit(0)).cast("int"))
    return F.coalesce(inside & (cut == _col(surface)), F.lit(False))


def preview(text, size: int = 600) -> Column:
    """White space collapsed, cut to ``size`` code points."""
    return F.substring(strip(F.regexp_replace(_col(text), r"[\x09-\x0d\x20]+", " ")), 1, size)


def without_prefix(text, prefix: str) -> Column:
    c = _col(text)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def is_predicate(name) -> Column:
    """Whether a name is an identifier that does not begin with a verb."""
    c = _col(name)
    ok = is_match(c, PREDICATE)
    for p in VERB_PREFIXES:
        ok = ok & ~F.coalesce(c.startswith(p), F.lit(False))
    return ok


def occurrences(text, part) -> Column:
    """Number of non-overlapping occurrences; 0 for an empty part."""
    t, p = _col(text), _col(part)
    return F.when(F.length(p) > 0, ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")).otherwise(0)


def redacted(text) -> Column:
    return F.concat(F.lit("<redacted:"), F.length(_col(text)).cast("string"), F.lit(" chars>"))


def short_hash(value) -> Column:
    return F.substring(F.sha2(_col(value).cast("string"), 256), 1, 12)


def all_finite(vector) -> Column:
    bad = F.lit(float("inf"))
    return F.coalesce(F.forall(_col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != bad)), F.lit(False))


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine of two vectors in double precision; null if either has no length or a null."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def canonical_json(*columns: str) -> Column:
    """Compact JSON of the named columns, keys in order."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))


@F.pandas_udf(StringType())
def normalized_name(names: pd.Series) -> pd.Series:
    """NFKC, case folded, runs of letters and digits of any script joined by single blanks."""
    words = re.compile(r"[^\W_]+").findall
    return names.map(lambda n: None if n is None else " ".join(words(unicodedata.normalize("NFKC", n).casefold())))


def name_words(name) -> Column:
    """Sorted distinct words of a name in any script without forms of address."""
    words = F.filter(F.split(normalized_name(_col(name)), " "), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.array_except(words, F.array(*(F.lit(h) for h in HONORIFICS)))))


@F.pandas_udf(StringType())
def uuid5_reference(names: pd.Series, spaces: pd.Series) -> pd.Series:
    """The standard library's UUIDs, to hold ``uuid5`` against."""
    return pd.Series([str(uuid.uuid5(uuid.UUID(s), n)) for n, s in zip(names, spaces)])
