"""Queries of printed papers: starts, regions and their problems, audits of crops, and roots found by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import layout as L
from quillstone.plans.printed import PRINTED_SQL, drawings, pages, printed_spans
from quillstone.plans.registry import query
from quillstone.sources.files import stored


PLACE = ("doc_id", "page")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return L.segment_regions(printed_spans(spark, d, *PLACE), drawings(spark, d, *PLACE), pages(spark, d, *PLACE))


@query(f"WITH {PRINTED_SQL} SELECT doc_id, page, span_no, number, y0 FROM starts", roles=False)
def question_starts(spark: SparkSession, d: str) -> DataFrame:
    return L.question_starts(printed_spans(spark, d))


@query(f"WITH {PRINTED_SQL} SELECT * FROM regions", roles=False)
def segment_regions(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d)


@query(
    f"WITH {PRINTED_SQL}"
    """, once AS (SELECT doc_id, number, count(*) AS c FROM regions GROUP BY doc_id, number)
SELECT doc_id, 'page_size' AS kind, page AS first, page AS last FROM sheets WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM known)
UNION ALL SELECT DISTINCT doc_id, 'none', NULL::INT, NULL::INT FROM sheets WHERE doc_id NOT IN (SELECT doc_id FROM regions)
UNION ALL SELECT doc_id, 'order', number, after FROM (SELECT *, lead(number) OVER (PARTITION BY doc_id ORDER BY page, y0, number) AS after FROM regions) WHERE after < number
UNION ALL SELECT doc_id, 'duplicate', number, number FROM once WHERE c > 1
UNION ALL SELECT doc_id, 'missing', before + 1, number - 1 FROM (SELECT *, coalesce(lag(number) OVER (PARTITION BY doc_id ORDER BY number), 0) AS before FROM once) WHERE number > before + 1
UNION ALL SELECT doc_id, 'degenerate', number, number FROM regions WHERE y1 <= y0 OR x1 <= x0""",
    roles=False,
)
def region_problems(spark: SparkSession, d: str) -> DataFrame:
    """Regions are stored, as each kind of problem reads them."""
    return L.region_problems(stored(_regions(spark, d)), pages(spark, d))


@query(
    f"WITH {PRINTED_SQL}"
    r""", boxes AS (
  SELECT doc_id, page, number, y0 AS new_top, y1 AS new_bottom, y0 AS top, y1 - (CASE number % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.5 WHEN 2 THEN 25 ELSE 130 END) AS bottom
  FROM (SELECT doc_id, page, number, unnest(max({'y1': y1, 'y0': y0})) FROM regions GROUP BY doc_id, page, number)),
seen AS (
  SELECT b.doc_id, b.page, b.number, bottom, new_bottom,
    coalesce(list(DISTINCT text[1]) FILTER (text ~ '^[BCD]([\s).].*)?$' AND y0 >= new_top AND y0 < new_bottom), []) AS new,
    coalesce(list(DISTINCT text[1]) FILTER (text ~ '^[BCD]([\s).].*)?$' AND y0 >= top AND y0 < bottom), []) AS old,
    arg_min(text, span_no) FILTER (y0 > top AND y0 < bottom AND bottom < y1 - 1 AND NOT footer AND text <> '') AS line
  FROM boxes b JOIN tidy USING (doc_id, page) GROUP BY ALL),
told AS (SELECT *, CASE WHEN new_bottom - bottom > 1 THEN array_to_string(list_sort(list_filter(new, lambda c: NOT list_contains(old, c))), '') ELSE '' END AS revealed FROM seen)
SELECT doc_id, page, number, CASE WHEN revealed <> '' THEN 'missing_option' ELSE 'midline_cut' END AS kind, CASE WHEN revealed <> '' THEN revealed ELSE line END AS detail
FROM told WHERE revealed <> '' OR line IS NOT NULL""",
    roles=False,
)
def region_audit(spark: SparkSession, d: str) -> DataFrame:
    """Stored boxes (here, some shorter than they should be) against recomputed ones."""
    regions = stored(_regions(spark, d))
    short = F.element_at(F.array(*map(F.lit, (0.0, 0.5, 25.0, 130.0))), F.col("number") % 4 + 1)
    return L.crop_audit(regions.withColumn("y1", F.col("y1") - short), regions, printed_spans(spark, d, *PLACE))


@query(
    f"WITH RECURSIVE {PRINTED_SQL}"
    r""", pool AS (SELECT DISTINCT doc_id, regexp_extract(text, '^\d+')::INT AS number, {'p': page, 'y': y0} AS spot FROM tidy WHERE x0 < 60 AND y0 > 45 AND y0 < 780 AND regexp_matches(text, '^\d{1,2}(\s|$)')),
gaps AS (SELECT doc_id, number AS root, {'p': page, 'y': y0} AS after, lead(number) OVER w AS next, lead({'p': page, 'y': y0}) OVER w AS before FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY page, y0, number)),
steps AS (SELECT DISTINCT doc_id, root, after, before, next, root AS number, after AS spot, false AS picked FROM gaps WHERE next > root + 1 OR next IS NULL
  UNION ALL SELECT doc_id, root, after, before, next, number + 1, coalesce(found, spot), found IS NOT NULL FROM (
    SELECT s.*, (SELECT min(p.spot) FROM pool p WHERE p.doc_id = s.doc_id AND p.number = s.number + 1 AND p.spot > s.spot AND (s.before IS NULL OR p.spot < s.before)) AS found FROM steps s WHERE s.number + 1 < coalesce(s.next, 100))
  WHERE next IS NOT NULL OR found IS NOT NULL)
SELECT doc_id, number, page, y0, false AS recovered FROM starts
UNION ALL SELECT doc_id, number, spot.p, spot.y, true FROM steps WHERE picked""",
    roles=False,
)
def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed numbers, and those missing between neighbours or after the last that a candidate in place can fill."""
    spans = printed_spans(spark, d)
    return L.fill_missing_roots(L.question_starts(spans), L.unconfirmed_roots(spans))


CUTS = """, ends AS (
  SELECT m.*, (SELECT min({'p': b.page, 'y': b.y0}) FROM tidy b WHERE b.doc_id = m.doc_id AND b.text LIKE 'Section %' AND {'p': b.page, 'y': b.y0} > {'p': m.page, 'y': m.y0} AND (m.next IS NULL OR {'p': b.page, 'y': b.y0} < m.next)) AS cut
  FROM (SELECT doc_id, page, y0, lead({'p': page, 'y': y0}) OVER (PARTITION BY doc_id ORDER BY page, y0) AS next FROM starts) m),
slices AS (
  SELECT doc_id, mark_page, mark_y0, page, greatest(CASE WHEN page = mark_page THEN mark_y0 ELSE 45 END - 2, 45) AS top, CASE WHEN cut.p = page THEN cut.y WHEN next.p = page THEN next.y ELSE 780 END AS bottom
  FROM (SELECT doc_id, page AS mark_page, y0 AS mark_y0, next, cut, unnest(range(page, CASE WHEN cut IS NOT NULL THEN page ELSE coalesce(next.p, page) END + 1))::INT AS page FROM ends))"""


def _ends(spark: SparkSession, d: str) -> DataFrame:
    spans = printed_spans(spark, d)
    return L.range_cut(L.question_starts(spans), spans.where(F.col("text").rlike(r"^\s*Section ")))


@query(f"WITH {PRINTED_SQL}{CUTS} SELECT doc_id, page, y0, next.p AS next_page, next.y AS next_y0, cut.p AS cut_page, cut.y AS cut_y0 FROM ends", roles=False)
def range_cut(spark: SparkSession, d: str) -> DataFrame:
    """Where each question ends: at the next one, or at a section heading before it."""
    return _ends(spark, d)


@query(f"WITH {PRINTED_SQL}{CUTS} SELECT * FROM slices WHERE bottom - top > 5", roles=False)
def item_slices(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of each question on the pages that it runs over."""
    return L.item_slices(_ends(spark, d))


@query(
    f"WITH {PRINTED_SQL}{CUTS}"
    """, many AS (SELECT *, count(*) OVER (PARTITION BY doc_id, mark_page, mark_y0) AS c, row_number() OVER (PARTITION BY doc_id, mark_page, mark_y0 ORDER BY page DESC, top DESC) AS r FROM slices WHERE bottom - top > 5)
SELECT doc_id, mark_page * 1000 + mark_y0 AS number, page, bottom - top AS height FROM many WHERE c > 1 AND r = 1 AND bottom - top < 30""",
    roles=False,
)
def spurious_tail(spark: SparkSession, d: str) -> DataFrame:
    """A question's last box on a later page that is too low to show anything of it."""
    boxes = L.item_slices(_ends(spark, d)).select("doc_id", (F.col("mark_page") * 1000 + F.col("mark_y0")).alias("number"), "page", F.col("top").alias("y0"), F.col("bottom").alias("y1"))
    return L.spurious_tails(boxes, 30.0)
