"""Printed question papers by their geometry: question starts, footers, regions, their audit, and roots found by place.

Spans have ``doc_id, page, span_no, text, x0, x1, y0, y1, size, bold``, in points from a page's top left corner;
``span_no`` is their order in a document. Drawings have ``doc_id, page, x0, y0, x1, y1``. A page is a group of its own
throughout, so no shuffle goes by more than document and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in points: the gutter that question numbers stand in, the body, the crop's sides, the gap above the next
# question; the footer's strip, its size of type, the rule above it; a page and how far it may be off; a cut that matters.
GUTTER_X, BODY_TOP, BODY_BOTTOM = 60.0, 45.0, 780.0
CROP_LEFT, CROP_RIGHT, CROP_GAP = 45.0, 555.0, 8.0
FOOTER_TOP, FOOTER_SIZE, RULE_WIDTH, RULE_HEIGHT = 690.0, 9.0, 400.0, 2.0
PAGE_WIDTH, PAGE_HEIGHT, PAGE_TOLERANCE = 595.0, 842.0, 2.0
GROWTH = 1.0
TURN_OVER = "[Turn over"

_PLACE = ["doc_id", "page"]


def stripped(text: str = "text") -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def in_gutter() -> Column:
    """Left of everything but question numbers, and within the body."""
    return (F.col("x0") < GUTTER_X) & (F.col("y0") > BODY_TOP) & (F.col("y0") < BODY_BOTTOM)


def is_start() -> Column:
    """Whether a span opens a question: what ``start_number`` reads is there. One pattern for each kind, tried on the text as it is."""
    alone = F.col("text").rlike(r"^\s*(?=\d*[1-9])\d{1,9}\s*$")
    return in_gutter() & (alone | (F.col("bold") & F.col("text").rlike(r"^\s*(?=\d*[1-9])\d{1,2}\s+\S")))


def start_number() -> Column:
    """The question that a span opens, or null.

    A number alone in the gutter and the body; or, in bold, a number of two digits at most before text, as printed where
    a question opens with a single sign. There is no question 0.
    """
    return F.when(is_start(), _leading())


def _leading() -> Column:
    return F.regexp_extract("text", r"^\s*(\d+)", 1).cast("int")


def is_footer() -> Column:
    """Small type in the footer's strip, or its fixed note, which is set as large as a question."""
    return (F.col("y0") > FOOTER_TOP) & ((F.col("size") < FOOTER_SIZE) | F.col("text").rlike(rf"^\s*\{TURN_OVER}"))


def is_footer_rule() -> Column:
    """The hairline above the notice: no artwork is as wide and as low."""
    return (F.col("y0") > FOOTER_TOP) & (F.col("y1") - F.col("y0") < RULE_HEIGHT) & (F.col("x1") - F.col("x0") > RULE_WIDTH)


def is_template() -> Column:
    return (F.abs(F.col("width") - PAGE_WIDTH) <= PAGE_TOLERANCE) & (F.abs(F.col("height") - PAGE_HEIGHT) <= PAGE_TOLERANCE)


def inked(spans: DataFrame) -> DataFrame:
    """Spans that show something of a question: no footers, and no blanks, whose boxes may be of any height."""
    return spans.where(F.col("text").rlike(r"\S") & ~is_footer())


def question_starts(spans: DataFrame) -> DataFrame:
    """``doc_id, page, span_no, number, y0`` of the spans that open a question."""
    return spans.where(is_start()).select("doc_id", "page", "span_no", _leading().alias("number"), "y0")


def segment_regions(spans: DataFrame, drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page, number, x0, y0, x1, y1`` of each question's region, on pages of the known size.

    A region ends above the next start of its page; the last one ends below the lowest ink or artwork that begins under
    its start and within the body, wherever that ends, or with the body if there is none. None is lower than a point.
    """
    known = pages.where(is_template()).select(*_PLACE)
    starts = question_starts(spans).join(known, _PLACE)
    w = Window.partitionBy(*_PLACE).orderBy("y0", "span_no")
    starts = starts.select(*_PLACE, "number", "y0", F.lead("y0").over(w).alias("next"), (F.lead("y0").over(w).isNull()).alias("is_last"))
    artwork = drawings.where(~is_footer_rule()).select(*_PLACE, "y0", "y1")
    marks = inked(spans).select(*_PLACE, "y0", "y1").unionByName(artwork).where(F.col("y0") <= BODY_BOTTOM)
    last = starts.where("is_last").select(*_PLACE, F.col("y0").alias("top"))
    ink = marks.join(last, _PLACE).where("y0 > top").groupBy(*_PLACE).agg(F.max("y1").alias("ink"))
    bottom = F.when(F.col("is_last"), F.coalesce(F.col("ink") + CROP_GAP, F.lit(BODY_BOTTOM))).otherwise(F.col("next") - CROP_GAP)
    box = (F.lit(CROP_LEFT).alias("x0"), (F.col("y0") - CROP_GAP).alias("y0"), F.lit(CROP_RIGHT).alias("x1"), F.greatest(F.col("y0") + 1, bottom).alias("y1"))
    return starts.join(ink, _PLACE, "left").select(*_PLACE, "number", *box)


def region_problems(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """What keeps a document's regions from being trusted: ``doc_id, kind, first, last``, a row for each finding.

    ``page_size`` (a page), ``none`` (no question), ``order`` (a number and the smaller one that follows), ``duplicate`` (a
    number), ``missing`` (a run of numbers) and ``degenerate`` (a number). Runs, so that one absurd number costs one row.
    """
    place = Window.partitionBy("doc_id").orderBy("page", "y0", "number")
    number = Window.partitionBy("doc_id").orderBy("number")
    tell = lambda rows, kind, first, last: rows.select("doc_id", F.lit(kind).alias("kind"), F.expr(first).cast("int").alias("first"), F.expr(last).cast("int").alias("last"))
    found = tell(pages.where(~is_template()), "page_size", "page", "page")
    found = found.unionByName(tell(pages.select("doc_id").distinct().join(regions, "doc_id", "left_anti"), "none", "null", "null"))
    found = found.unionByName(tell(regions.withColumn("after", F.lead("number").over(place)).where("after < number"), "order", "number", "after"))
    once = regions.groupBy("doc_id", "number").count()
    found = found.unionByName(tell(once.where("count > 1"), "duplicate", "number", "number"))
    gap = once.withColumn("before", F.coalesce(F.lag("number").over(number), F.lit(0))).where("number > before + 1")
    found = found.unionByName(tell(gap, "missing", "before + 1", "number - 1"))
    return found.unionByName(tell(regions.where("y1 <= y0 OR x1 <= x0"), "degenerate", "number", "number"))


def crop_audit(stored: DataFrame, regions: DataFrame, spans: DataFrame) -> DataFrame:
    """What stored boxes hide: ``doc_id, page, number, kind, detail``; a box that hides nothing has no row.

    Stored boxes and recomputed regions have ``doc_id, page, number, y0, y1``. ``missing_option``: the recomputed one ends
    more than a point lower and shows option letters that the stored one doesn't (the detail). Else ``midline_cut``: a
    line begins inside the stored box and is cut by its lower edge by more than a point (its text).
    """
    key = ["doc_id", "page", "number"]
    old = stored.groupBy(*key).agg(F.max(F.struct("y1", "y0")).alias("b")).select(*key, F.col("b.y0").alias("top"), F.col("b.y1").alias("bottom"))
    new = regions.groupBy(*key).agg(F.max(F.struct("y1", "y0")).alias("b")).select(*key, F.col("b.y0").alias("new_top"), F.col("b.y1").alias("new_bottom"))
    boxes = old.join(new, key)
    text = spans.select(*_PLACE, "span_no", stripped().alias("text"), "y0", "y1", is_footer().alias("footer"))
    letter = F.nullif(F.regexp_extract("text", r"^([BCD])([\s).]|$)", 1), F.lit(""))
    within = lambda top, bottom: (F.col("y0") >= F.col(top)) & (F.col("y0") < F.col(bottom))
    cut = (F.col("y0") > F.col("top")) & (F.col("y0") < F.col("bottom")) & (F.col("bottom") < F.col("y1") - GROWTH) & ~F.col("footer") & (F.col("text") != "")
    seen = boxes.join(text, _PLACE).groupBy(*key, "bottom", "new_bottom").agg(
        F.array_sort(F.collect_set(F.when(within("top", "bottom"), letter))).alias("old"),
        F.array_sort(F.collect_set(F.when(within("new_top", "new_bottom"), letter))).alias("new"),
        F.min(F.when(cut, F.struct("span_no", "text"))).alias("line"),
    )
    revealed = F.when(F.col("new_bottom") - F.col("bottom") > GROWTH, F.array_join(F.array_except("new", "old"), "")).otherwise("")
    seen = seen.withColumn("revealed", revealed)
    kind = F.when(F.col("revealed") != "", "missing_option").when(F.col("line").isNotNull(), "midline_cut")
    return seen.select(*key, kind.alias("kind"), F.when(F.col("revealed") != "", F.col("revealed")).otherwise(F.col("line.text")).alias("detail")).where("kind IS NOT NULL")


def unconfirmed_roots(spans: DataFrame) -> DataFrame:
    """``doc_id, number, page, y0`` of spans in gutter and body whose first word is a number of two digits at most, bold or not."""
    return spans.where(in_gutter() & F.col("text").rlike(r"^\s*\d{1,2}(\s|$)")).select("doc_id", _leading().alias("number"), "page", "y0")


def fill_missing_roots(roots: DataFrame, candidates: DataFrame) -> DataFrame:
    """Confirmed roots and, with ``recovered`` true, those found by place: ``doc_id, number, page, y0, recovered``.

    Between two neighbours in order of place, each missing number takes its first candidate after the one picked before
    it and before the second neighbour. After the last root, numbers go on as long as the very next one has a candidate
    further on. Both tables have ``doc_id, number, page, y0``.
    """
    place = F.struct("page", "y0")
    w = Window.partitionBy("doc_id").orderBy("page", "y0", "number")
    each = roots.select("doc_id", "page", "y0", "number", F.lead("number").over(w).alias("next"), F.lead(place).over(w).alias("before"), F.row_number().over(w).alias("gap"))
    # Roots and candidates are sorted together: a candidate can only belong to the gap of the last root before its place.
    gap = F.struct("gap", F.col("number").alias("root"), place.alias("after"), "next", "before")
    both = each.select("doc_id", "page", "y0", "number", F.lit(0).alias("kind"), "gap", gap.alias("g"))
    both = both.unionByName(candidates.select("doc_id", "page", "y0", "number", F.lit(1).alias("kind")), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("page", "y0", "kind", F.col("gap")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("g", F.last("g", ignorenulls=True).over(order)).where("kind = 1 AND g IS NOT NULL")
    near = near.select("doc_id", "number", place.alias("at"), "g.*").where("(next > root + 1 OR next IS NULL) AND at > after AND (before IS NULL OR at < before)")
    # A neighbour's gap spans two-digit numbers only, as candidates are; the run after the last root asks for all later ones.
    near = near.where((F.col("number") > F.col("root")) & (F.col("number") <= F.least(F.coalesce(F.col("next") - 1, F.lit(99)), F.greatest(F.lit(99), F.col("root") + 1))))
    gaps = near.groupBy("doc_id", "gap").agg(F.first("root").alias("root"), F.first("after").alias("after"), F.first("before").alias("before"), F.array_sort(F.collect_list(F.struct("number", "at"))).alias("pool"))
    start = F.struct(F.col("root").alias("number"), F.col("after").alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<number: INT, at: STRUCT<page: INT, y0: DOUBLE>>>)").alias("picks"))

    def pick(state: Column, c: Column) -> Column:
        further = c["at"] > state["at"]
        in_turn = F.when(F.col("before").isNull(), c["number"] == state["number"] + 1).otherwise(c["number"] > state["number"])
        taken = F.struct(c["number"].alias("number"), c["at"].alias("at"), F.concat(state["picks"], F.array(c)).alias("picks"))
        return F.when(further & in_turn, taken).otherwise(state)

    picks = gaps.select("doc_id", F.explode(F.aggregate("pool", start, pick, lambda s: s["picks"])).alias("p"))
    found = picks.select("doc_id", "p.number", "p.at.page", "p.at.y0", F.lit(True).alias("recovered"))
    return roots.select("doc_id", "number", "page", "y0", F.lit(False).alias("recovered")).unionByName(found)


def range_cut(marks: DataFrame, breaks: DataFrame) -> DataFrame:
    """Each mark's end: ``doc_id, page, y0, next_page, next_y0, cut_page, cut_y0``.

    The cut is the first break that lies, by page and height, strictly after the mark and before the next one. Marks and
    breaks of a document are sorted together, so nothing is compared pair by pair. On a page of the mark's run that has
    the cut the item ends there and the run is over, else at the next mark if that is on it, else with the page.
    """
    both = marks.select("doc_id", "page", "y0", F.lit(1).alias("is_mark")).unionByName(breaks.select("doc_id", "page", "y0", F.lit(0).alias("is_mark")))
    w = Window.partitionBy("doc_id").orderBy("page", "y0", "is_mark").rowsBetween(1, Window.unboundedFollowing)
    place = F.struct("page", "y0")
    seen = both.withColumn("next", F.first(F.when(F.col("is_mark") == 1, place), ignorenulls=True).over(w)).withColumn("cut", F.first(F.when(F.col("is_mark") == 0, place), ignorenulls=True).over(w))
    cut = F.when(F.col("next").isNull() | (F.col("cut") < F.col("next")), F.col("cut"))
    return seen.where("is_mark = 1").withColumn("cut", cut).select("doc_id", "page", "y0", F.col("next.page").alias("next_page"), F.col("next.y0").alias("next_y0"), F.col("cut.page").alias("cut_page"), F.col("cut.y0").alias("cut_y0"))


def item_slices(ends: DataFrame, bottom: float = BODY_BOTTOM) -> DataFrame:
    """``doc_id, mark_page, mark_y0, page, top, bottom``: the boxes of an item on each page that it runs over.

    ``ends`` as of ``range_cut``. An item begins two points above its mark; it goes on at the next page's body only where
    no cut stops it and its next mark is on a later page. Boxes of five points or less are dropped.
    """
    last = F.when(F.col("cut_page").isNotNull(), F.col("page")).otherwise(F.coalesce("next_page", "page"))
    each = ends.withColumn("on", F.explode(F.sequence("page", last)))
    top = F.greatest(F.when(F.col("on") == F.col("page"), F.col("y0")).otherwise(F.lit(BODY_TOP)) - 2, F.lit(BODY_TOP))
    end = F.when(F.col("cut_page") == F.col("on"), F.col("cut_y0")).when(F.col("next_page") == F.col("on"), F.col("next_y0")).otherwise(F.lit(bottom))
    return each.select("doc_id", F.col("page").alias("mark_page"), F.col("y0").alias("mark_y0"), F.col("on").alias("page"), top.alias("top"), end.alias("bottom")).where("bottom - top > 5")


def spurious_tails(regions: DataFrame, least_height: float) -> DataFrame:
    """The last of an item's several regions, by page, where it is lower than ``least_height``: ``doc_id, number, page, height``."""
    w = Window.partitionBy("doc_id", "number")
    seen = regions.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("page"), F.desc("y0"))))
    return seen.where("n > 1 AND rank = 1").select("doc_id", "number", "page", (F.col("y1") - F.col("y0")).alias("height")).where(F.col("height") < least_height)
