"""Column functions over question text, labels, marks and names."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What documents of this kind print, and how extraction shows it.
#: Stock wording of covers, instructions, data sheets and blank pages.
NON_CONTENT_PHRASES = (
    "blank page",
    "read these instructions first",
    "additional materials",
    "candidate name",
    "list of formulae",
    "data sheet",
    "the following data may be used",
    "permission to reproduce items",
    "this document consists of",
)
#: A text of so many characters or fewer, ends trimmed, is no text layer.
NO_TEXT_LAYER = 40
CONTROL = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F"
HEADER_STRIP = rf"(?U)(?:(?<=\s)\d{{1,2}}[ \t]+)?(?:BLANK PAGE[ \t]+)?,[{CONTROL}][{CONTROL}, ]*"
REACTION_ARROW = r"(?<=[A-Za-z0-9)\]+–−])[ \t]+\x01[ \t]+(?=[A-Z0-9(])"
MARK_BRACKET = r"\[\s*\d{1,2}\s*\]"
NUMBER_LINE = r"(?imd)^\s*\d{1,2}(?:\s+(?!hours?\b|minutes?\b)\S|[.()])"
OPTION_LINE = r"(?md)^\s*[A-D][.)\s]"
FURNITURE_NOISE = r"(?U)[\x00-\x1F\x7F,\s]"
BLANK_PAGE = r"(?i)BLANK\s+PAGE"
LEADING_MARKS = r"^(\d{1,2})(?:\s*\*|ft)?(?:\s|$)"
MARK_CODE = r"\b[MABC](\d)(?:FT|dep)?\b"
LABEL_NUMBER = r"^([A-Z]?\d{1,2})"
LABEL_GROUP = r"\(\s*([a-zA-Z]+)\s*\)"

_ENDS = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


@F.pandas_udf(StringType())
def _folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def fold_accents(text: Column) -> Column:
    """NFKD with combining marks dropped. Spark has no such function, so texts that are not ASCII go to Python."""
    return F.coalesce(_folded(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, _ENDS, "")


def normalise(text: Column) -> Column:
    """For exact comparison of questions: no leading item number, accents folded, lower case; only letters, digits and spaces stay."""
    return F.regexp_replace(F.lower(fold_accents(F.regexp_replace(text, r"(?U)^\s*\d+\s+", ""))), r"[^a-z0-9 ]", "")


def clean_extracted(text: Column, symbols: bool = False) -> Column:
    """Take extraction's control characters out; a clean text stays as it is, an emptied one is empty, a null is null.

    In order: nothing in place of NUL; header strips with their page number and notice; with ``symbols``, the glyph
    between two formulas as an arrow and elsewhere as a tick; a space for each other control character; spaces collapsed.
    """
    out = F.regexp_replace(F.regexp_replace(text, r"\x00", ""), HEADER_STRIP, "")
    if symbols:
        out = F.regexp_replace(F.regexp_replace(out, REACTION_ARROW, " → "), r"\x01", "✓")
    out = stripped(F.regexp_replace(F.regexp_replace(out, f"[{CONTROL}]", " "), " {2,}", " "))
    return F.when(text.rlike(f"[{CONTROL}]"), out).otherwise(text)


def clean_column(text: Column, symbols: bool = False) -> Column:
    """As ``clean_extracted``, for a stored column: a text that had nothing but dirt is null from then on."""
    return F.when(text.rlike(f"[{CONTROL}]"), F.nullif(clean_extracted(text, symbols), F.lit(""))).otherwise(text)


def is_furniture(line: Column) -> Column:
    """Nothing but a page number, the barcode's control characters and commas, and a blank-page notice."""
    left = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, FURNITURE_NOISE, " "), BLANK_PAGE, ""), FURNITURE_NOISE, "")
    return (left == "") | left.rlike(r"(?U)^\d+$")


def is_non_content(text: Column) -> Column:
    """A page with a stock phrase and no mark bracket, numbered line or option line; never without a text layer."""
    phrase = F.exists(F.array(*map(F.lit, NON_CONTENT_PHRASES)), lambda p: F.contains(F.lower(text), p))
    content = text.rlike(MARK_BRACKET) | text.rlike(NUMBER_LINE) | text.rlike(OPTION_LINE)
    return F.coalesce((F.length(stripped(text)) > NO_TEXT_LAYER) & phrase & ~content, F.lit(False))


def slug(text: Column, fallback: str = "topic") -> Column:
    out = F.regexp_replace(F.lower(fold_accents(text)), r"[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(out, r"^-+|-+$", ""), F.lit("")), F.lit(fallback))


def collapse_spaces(text: Column) -> Column:
    """White space of any kind as single spaces, without the template's private bullet."""
    return stripped(F.regexp_replace(F.regexp_replace(text, r"\x07", ""), r"(?U)[\s\x1C-\x1F]+", " "))


def normalise_label(label: Column) -> Column:
    """``7 (a) (II)`` as ``7(a)(ii)``, with an optional section letter; null where there is no number."""
    root = F.regexp_extract(stripped(label), LABEL_NUMBER, 1)
    groups = F.regexp_extract_all(label, F.lit(LABEL_GROUP), F.lit(1))
    return F.when(root != "", F.concat(root, F.array_join(F.transform(groups, lambda g: F.concat(F.lit("("), F.lower(g), F.lit(")"))), "")))


def root_label(label: Column) -> Column:
    return F.split_part(label, F.lit("("), F.lit(1))


def folded_label(label: Column, groups: int = 2) -> Column:
    return F.array_join(F.slice(F.split(label, r"\("), 1, groups + 1), "(")


def own_label(label: Column) -> Column:
    return F.regexp_extract(label, r"(\([^()]*\)|[^()]+)$", 1)


def bracket_marks(text: Column) -> Column:
    """The sum of all ``[n]`` of a text that ends with one; else null."""
    found = F.regexp_extract_all(text, F.lit(r"\[(\d{1,2})\]"), F.lit(1))
    return F.when(text.rlike(r"\[\d{1,2}\]\s*$"), F.aggregate(F.transform(found, lambda x: x.cast("int")), F.lit(0), lambda a, b: a + b))


def code_marks(cell: Column) -> Column:
    """A mark row's value: its leading number, or else the sum of codes such as ``M1 A1``; null without either."""
    codes = F.transform(F.regexp_extract_all(cell, F.lit(MARK_CODE), F.lit(1)), lambda x: x.cast("int"))
    summed = F.when(F.size(codes) > 0, F.aggregate(codes, F.lit(0), lambda a, b: a + b))
    return F.coalesce(F.nullif(F.regexp_extract(stripped(cell), LEADING_MARKS, 1), F.lit("")).cast("int"), summed)


def duration(ms: Column) -> Column:
    """``m s`` of a number of milliseconds."""
    s = F.floor(ms / 1000)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def clock(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def repaired_json(text: Column) -> Column:
    """A model's answer without code fence and trailing commas."""
    body = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), text)
    return F.regexp_replace(F.trim(body), r",\s*([}\]])", "$1")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double; null for a zero or differently long vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _seven_digits(x: Column) -> Column:
    """A double in seven significant digits without trailing zeros; what lies halfway goes to the even digit, not up."""
    every = F.format_string("%.16e", x)
    even = F.when(every.rlike(r"^-?\d\.\d{5}[02468]50{9}e"), F.regexp_replace(every, "50{9}e", "e").cast("double")).otherwise(x)
    return F.regexp_replace(F.regexp_replace(F.format_string("%.7g", even), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def vector_text(vector: Column) -> Column:
    """A vector as ``[0.25,-1,1e-05]``: seven significant digits, without trailing zeros; null for a null vector."""
    return F.when(vector.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: _seven_digits(x.cast("double"))), ","), F.lit("]")))
