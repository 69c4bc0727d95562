"""Printed papers by geometry: starts, footers, regions and their problems, the audit of crops, roots found by place."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import layout as L

SPAN = "doc_id int, page int, span_no int, text string, x0 double, x1 double, y0 double, y1 double, size double, bold boolean"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture(scope="module")
def paper(spark):
    def made(*spans, doc=1):
        """Spans as (page, text, x, y) with size, weight and height if they matter."""
        out = []
        for i, s in enumerate(spans):
            page, text, x, y = s[:4]
            o = {"size": 11.0, "bold": False, "high": 11.0, **(s[4] if len(s) > 4 else {})}
            out.append((doc, page, i, text, float(x), float(x) + 40, float(y), float(y) + o["high"], o["size"], o["bold"]))
        return spark.createDataFrame(out, SPAN)

    return made


def sheets(spark, *pages, doc=1):
    return spark.createDataFrame([(doc, *p) for p in pages], "doc_id int, page int, width double, height double")


def none_drawn(spark, *boxes, doc=1):
    return spark.createDataFrame([(doc, *map(float, b)) for b in boxes], "doc_id int, page double, x0 double, y0 double, x1 double, y1 double").withColumn("page", F.col("page").cast("int"))


A4 = (595.3, 841.9)


def test_what_opens_a_question(paper):
    bold = {"bold": True}
    found = paper(
        (1, " 1 ", 49.6, 60), (1, "2", 49.6, 120, bold), (1, "3", 60.0, 150), (1, "4", 49.6, 45), (1, "5", 49.6, 780), (1, "0", 55, 200, bold), (1, "6 W burns", 49.6, 250, bold),
        (1, "7 kg of sand", 49.6, 300), (1, "123 long", 49.6, 350, bold), (1, "8th", 49.6, 400, bold), (1, "9", 300, 420, bold), (1, "007", 20, 500), (1, "10\tX", 49.6, 550, bold),
    )
    assert rows(L.question_starts(found), "number") == [(1,), (10,), (2,), (6,), (7,)]
    assert rows(L.question_starts(found).where("number = 7"), "y0") == [(500.0,)]


def test_the_last_region_ends_with_its_own_ink(spark, paper):
    start = (1, "1", 49.6, 100)
    one = lambda *more, drawn=(): rows(L.segment_regions(paper(start, *more), none_drawn(spark, *drawn), sheets(spark, (1, *A4))), "y0", "y1")
    assert one() == [(92.0, 780.0)]
    assert one((1, "stem", 72, 130)) == [(92.0, 149.0)]
    # A line that begins in the body counts to its end; one that begins below it, on another page, or above the start doesn't.
    assert one((1, "stem", 72, 130), (1, "option", 72, 775, {"high": 20.0})) == [(92.0, 803.0)]
    assert one((1, "stem", 72, 130), (1, "page foot", 72, 781), (2, "more", 72, 300), (1, "head", 72, 50)) == [(92.0, 149.0)]
    # Footers: small type low on the page, or the fixed note in any size; small type higher up is an axis's label.
    assert one((1, "stem", 72, 130), (1, "fine print", 72, 700, {"size": 7.5}), (1, " [Turn over", 500, 720)) == [(92.0, 149.0)]
    assert one((1, "axis", 72, 600, {"size": 7.5})) == [(92.0, 619.0)]
    assert one((1, "large", 72, 700)) == [(92.0, 719.0)]
    # Blank glyphs have boxes but no ink; artwork counts, the rule above the notice doesn't.
    assert one((1, "stem", 72, 130), (1, " \t", 72, 200, {"high": 400.0})) == [(92.0, 149.0)]
    assert one((1, "stem", 72, 130), drawn=[(1, 80, 200, 300, 350), (1, 50, 750, 540, 751)]) == [(92.0, 358.0)]
    assert one((1, "stem", 72, 130), drawn=[(1, 50, 750, 540, 753)]) == [(92.0, 761.0)]


def test_regions_of_a_page_and_what_is_wrong_with_them(spark, paper):
    spans = paper((1, "1", 49.6, 100), (1, "2", 49.6, 103), (1, "5", 49.6, 400), (2, "4", 49.6, 90), (2, "4", 49.6, 300), (3, "9", 49.6, 90))
    pages = sheets(spark, (1, *A4), (2, *A4), (3, 612.0, 792.0))
    regions = L.segment_regions(spans, none_drawn(spark), pages)
    assert rows(regions, "page", "number", "y0", "y1") == [(1, 1, 92.0, 101.0), (1, 2, 95.0, 392.0), (1, 5, 392.0, 780.0), (2, 4, 292.0, 780.0), (2, 4, 82.0, 292.0)]
    other = sheets(spark, (1, *A4), doc=2)
    assert rows(L.region_problems(regions, pages.unionByName(other))) == [(1, "duplicate", 4, 4), (1, "missing", 3, 3), (1, "order", 5, 4), (1, "page_size", 3, 3), (2, "none", None, None)]
    huge = L.segment_regions(paper((1, "1", 49.6, 100), (1, "20260101", 49.6, 200)), none_drawn(spark), pages)
    assert rows(L.region_problems(huge, sheets(spark, (1, *A4)))) == [(1, "missing", 2, 20260100)]


def test_what_a_stored_crop_hides(spark, paper):
    box = "doc_id int, page int, number int, y0 double, y1 double"
    spans = paper((1, "B left", 72, 100), (1, "C) right", 72, 120), (1, "D", 72, 140), (1, "Axis", 72, 150), (1, "Below", 72, 160), (1, "  ", 72, 95, {"high": 300.0}))
    seen = lambda old, new: rows(L.crop_audit(spark.createDataFrame([(1, 1, 7, 90.0, old)], box), spark.createDataFrame([(1, 1, 7, 90.0, new)], box), spans), "number", "kind", "detail")
    assert seen(118.0, 180.0) == [(7, "missing_option", "CD")]
    assert seen(139.0, 180.0) == [(7, "missing_option", "D")]
    assert seen(125.0, 125.5) == [(7, "midline_cut", "C) right")]  # as long as before: only a cut can be found
    assert seen(130.5, 130.5) == []  # cut by half a point
    assert seen(155.0, 180.0) == [(7, "midline_cut", "Axis")]  # nothing new is revealed, but a line is cut
    assert seen(172.0, 180.0) == []


def test_missing_roots_are_found_between_and_after(spark):
    at = "doc_id int, number int, page int, y0 double"
    roots = spark.createDataFrame([(1, 1, 1, 100.0), (1, 2, 1, 200.0), (1, 6, 3, 100.0), (2, 3, 1, 50.0), (3, 5, 1, 10.0), (3, 2, 1, 20.0)], at)
    pool = [
        (1, 3, 1, 150.0), (1, 3, 1, 300.0), (1, 3, 2, 60.0),  # the first lies before the bracket: a decoy
        (1, 4, 1, 250.0), (1, 4, 2, 80.0),  # the earlier one precedes the pick for 3
        (1, 5, 3, 200.0),  # after the next root: a decoy
        (1, 7, 3, 90.0), (1, 7, 3, 300.0), (1, 8, 4, 50.0), (1, 10, 4, 90.0),  # a run of two, then a hole
        (2, 5, 1, 60.0), (3, 3, 1, 30.0), (3, 6, 1, 15.0),
    ]
    found = L.fill_missing_roots(roots, spark.createDataFrame(pool, at))
    assert rows(found.where("recovered"), "doc_id", "number", "page", "y0") == [(1, 3, 1, 300.0), (1, 4, 2, 80.0), (1, 7, 3, 300.0), (1, 8, 4, 50.0), (3, 3, 1, 30.0)]
    assert found.where("NOT recovered").count() == roots.count()


def test_candidates_need_no_weight_but_place(paper):
    spans = paper((1, "3 mol", 49.6, 100), (1, "4", 49.6, 120, {"bold": True}), (1, "55x", 49.6, 140), (1, "6", 70, 160), (1, "7", 49.6, 30))
    assert rows(L.unconfirmed_roots(spans), "number") == [(3,), (4,)]


def test_items_end_at_breaks_and_run_over_pages(spark):
    place = "doc_id int, page int, y0 double"
    marks = spark.createDataFrame([(1, 1, 100.0), (1, 1, 300.0), (1, 3, 48.0), (1, 3, 400.0), (2, 1, 10.0)], place)
    breaks = spark.createDataFrame([(1, 1, 300.0), (1, 3, 200.0), (1, 3, 250.0), (1, 5, 60.0), (2, 1, 10.0)], place)
    ends = L.range_cut(marks, breaks)
    # A break at a mark's own place, or at the next one's, lies between neither.
    assert rows(ends, "doc_id", "page", "y0", "cut_page", "cut_y0") == [(1, 1, 100.0, None, None), (1, 1, 300.0, None, None), (1, 3, 400.0, 5, 60.0), (1, 3, 48.0, 3, 200.0), (2, 1, 10.0, None, None)]
    assert rows(L.item_slices(ends), "doc_id", "mark_y0", "page", "top", "bottom") == [
        (1, 100.0, 1, 98.0, 300.0), (1, 300.0, 1, 298.0, 780.0), (1, 300.0, 2, 45.0, 780.0), (1, 400.0, 3, 398.0, 780.0), (1, 48.0, 3, 46.0, 200.0), (2, 10.0, 1, 45.0, 780.0)]


def test_only_the_last_of_several_boxes_can_be_spurious(spark):
    box = "doc_id int, number int, page int, y0 double, y1 double"
    boxes = [(1, 1, 1, 50.0, 60.0), (1, 2, 1, 100.0, 110.0), (1, 2, 2, 45.0, 64.0), (1, 3, 1, 100.0, 105.0), (1, 3, 2, 45.0, 300.0)]
    assert rows(L.spurious_tails(spark.createDataFrame(boxes, box), 30.0)) == [(1, 2, 2, 19.0)]


def test_empty_tables(spark, paper):
    empty = spark.createDataFrame([], SPAN)
    regions = L.segment_regions(empty, none_drawn(spark), sheets(spark))
    assert regions.count() == 0 and L.region_problems(regions, sheets(spark)).count() == 0
    assert L.fill_missing_roots(L.question_starts(empty), L.unconfirmed_roots(empty)).count() == 0


def test_tasks_grow_with_the_rows_and_nothing_is_dealt_twice(spark, monkeypatch):
    """Printed rows are made where their document is: a query that goes by document shuffles line items once, into as many tasks as they need."""
    from quillstone.plans import QUERIES, printed

    monkeypatch.setattr(printed, "TASK_ROWS", 500)
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert n > 2000 and printed.scheme_lines(spark, sf).rdd.getNumPartitions() == -(-n // 500)
    plan = QUERIES["entry_collect"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "filter(array" not in plan


def test_methods_of_the_rules_are_small_enough_to_be_compiled(spark, capsys):
    """The JVM interprets methods of more than 8,000 bytes, some five times slower."""
    from quillstone.plans import printed

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (printed.printed_spans, printed.syllabus_rows, printed.scheme_lines, printed.threshold_lines, printed.grid_lines):
            made(spark, "/root/testdata/sf0.001").explain("codegen")
            sizes = [int(part.split(";")[0]) for part in capsys.readouterr().out.split("maxMethodCodeSize:")[1:]]
            assert sizes and max(sizes) < 7000, made.__name__
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
