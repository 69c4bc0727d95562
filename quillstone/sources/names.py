"""Document names and links: parsing, building, and what a fetched page offers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import stripped

# The grammar of document names, and what its letters stand for.
#: ``<syllabus>_<season><yy>_<type>[_<component>[<variant>]]``
NAME = r"(?i)^(\d{4})_([msw])(\d{2})_(qp|ms|er|gt|in|ci)(?:_(\d)(\d)?)?$"
SEASONS = {"m": "feb_march", "s": "may_june", "w": "oct_nov"}
SHORT_SEASONS = {"feb_march": "fm", "may_june": "mj", "oct_nov": "on"}
#: Two-digit years from here on are of the last century.
PIVOT = 90


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def parsed_name(stem: Column) -> Column:
    """A document name's dimensions as a struct; all null for a name that is not of the grammar."""
    part = lambda i: F.nullif(F.regexp_extract(stripped(stem), NAME, i), F.lit(""))
    year = part(3).cast("int")
    return F.struct(
        part(1).alias("syllabus"),
        _looked_up(SEASONS, F.lower(part(2))).alias("season"),
        F.when(year >= PIVOT, year + 1900).otherwise(year + 2000).alias("year"),
        F.lower(part(4)).alias("doc_type"),
        part(5).cast("int").alias("component"),
        part(6).cast("int").alias("variant"),
    )


def built_name(syllabus: Column, season: Column, year: Column, doc_type: Column, component: Column, variant: Column) -> Column:
    """The file name that dimensions came from."""
    tail = F.when(component.isNotNull(), F.concat(F.lit("_"), component, F.coalesce(variant.cast("string"), F.lit(""))))
    letter = _looked_up({name: letter for letter, name in SEASONS.items()}, season)
    return F.concat(syllabus, F.lit("_"), letter, F.format_string("%02d", year % 100), F.lit("_"), doc_type, F.coalesce(tail, F.lit("")), F.lit(".pdf"))


def storage_prefix(syllabus: Column, year: Column, season: Column, component: Column, variant: Column) -> Column:
    """The folder of a paper: syllabus, then year and season, then component and variant; null for a document without a component."""
    sitting = F.concat_ws("-", year.cast("string"), _looked_up(SHORT_SEASONS, season))
    return F.concat(F.lit("papers/"), syllabus, F.lit("/"), sitting, F.lit("/p"), component.cast("string"), F.coalesce(variant.cast("string"), F.lit("")))


def document_key(prefix: Column, doc_type: Column) -> Column:
    return F.concat(prefix, F.lit("/"), doc_type, F.lit(".pdf"))


def crop_key(prefix: Column, number: Column) -> Column:
    return F.concat(prefix, F.lit("/crops/"), number.cast("string"), F.lit(".png"))


def _page_suffix(sort_order: Column) -> Column:
    return F.when(sort_order == 0, "").otherwise(F.concat(F.lit("."), sort_order.cast("string")))


def structured_crop_key(prefix: Column, label: Column, sort_order: Column) -> Column:
    """Key of a picture of a question in parts; from the second picture on, the key ends in its number."""
    return F.concat(prefix, F.lit("/crops/"), label, _page_suffix(sort_order), F.lit(".png"))


def mark_scheme_crop_key(prefix: Column, label: Column, sort_order: Column) -> Column:
    """Key of a picture of a mark-scheme entry: the label's levels with dashes between them, so that no bracket is in a key."""
    safe = F.array_join(F.filter(F.split(label, r"[()]+"), lambda part: part != ""), "-")
    return F.concat(prefix, F.lit("/crops/ms-"), safe, _page_suffix(sort_order), F.lit(".png"))


def wanted(parsed: Column, *, doc_types: Iterable[str], years: tuple[int, int], components: Iterable[int] = ()) -> Column:
    """Whether a parsed name is of these types, years (both included) and, if any are given, components.

    A document that names no component covers a whole session, so a choice of components never drops it. Names that were
    not understood are not wanted.
    """
    of_component = F.lit(True) if not (chosen := list(components)) else parsed["component"].isNull() | parsed["component"].isin(chosen)
    return F.coalesce(parsed["doc_type"].isin(list(doc_types)) & parsed["year"].between(*years) & of_component, F.lit(False))


def page_links(pages: DataFrame, pattern: str = r'href="([^"]*)"') -> DataFrame:
    """The first link of each file name on each page, by place."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("place", "href"))
    named = found.withColumn("file", F.regexp_extract("href", r"([^/]*)$", 1))
    w = Window.partitionBy("page_id", "file").orderBy("place")
    return named.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
