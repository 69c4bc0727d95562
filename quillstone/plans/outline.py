"""Queries of document layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import outline as O
from quillstone.operators.common import islands
from quillstone.plans.registry import query
from quillstone.plans.roles import spans


@query("""
WITH b AS (SELECT doc_id, page, line_no AS bar, y0 - 1 AS bar_y, x0 AS bx0, x1 AS bx1 FROM spans WHERE line_no % 7 = 3),
c AS (SELECT s.doc_id, s.page, bar, line_no, CASE WHEN y1 <= bar_y THEN 'above' WHEN y0 >= bar_y THEN 'below' END AS side, CASE WHEN y1 <= bar_y THEN bar_y - y1 ELSE y0 - bar_y END AS gap
  FROM spans s JOIN b ON s.doc_id = b.doc_id AND s.page = b.page AND least(x1, bx1) - greatest(x0, bx0) > 0.5 AND line_no <> bar),
n AS (SELECT doc_id, page, bar, side, arg_min(line_no, gap * 100000 + line_no) AS line_no FROM c WHERE side IS NOT NULL GROUP BY doc_id, page, bar, side)
SELECT doc_id, page, bar, side, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY bar, side) > 1 AS conflict FROM n""")
def nearest_pair(spark: SparkSession, d: str) -> DataFrame:
    all_spans = spans(spark, d)
    return O.nearest_lines(all_spans.where("line_no % 7 = 3").withColumn("y", F.col("y0") - 1), all_spans)


@query("""
WITH f AS (SELECT doc_id, page, line_no % 3 AS label, y0, y1 FROM spans WHERE line_no % 4 <> 1),
o AS (SELECT *, coalesce((y0 - max(y1) OVER (PARTITION BY doc_id, page, label ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 3)::INT, 0) AS fresh FROM f),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page, label ORDER BY y0, y1) AS island FROM o)
SELECT doc_id, page, label, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM i GROUP BY doc_id, page, label, island""")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of one label on a page, merged where at most 3 apart."""
    boxes = spans(spark, d).where("line_no % 4 <> 1").withColumn("label", F.col("line_no") % 3)
    return islands(boxes, ["doc_id", "page", "label"], "y0", "y1", 3)


@query("""
WITH RECURSIVE shifted AS (
  SELECT doc_id, page, line_no, line, x0, y0 - line_no % 2 * 8 AS y0, y1 - line_no % 2 * 8 AS y1, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS n FROM spans WHERE trim(line) <> ''),
scan AS (
  SELECT doc_id, page, n, 0 AS row, [{'a': y0, 'b': y1}] AS held FROM shifted WHERE n = 1
  UNION ALL SELECT s.doc_id, s.page, s.n, CASE WHEN near THEN row ELSE row + 1 END, CASE WHEN near THEN list_append(held, {'a': y0, 'b': y1}) ELSE [{'a': y0, 'b': y1}] END
  FROM (SELECT s.*, c.row, c.held, len(list_filter(c.held, lambda m: (least(s.y1, m.b) - greatest(s.y0, m.a)) / least(s.y1 - s.y0, m.b - m.a) >= 0.25)) > 0 AS near FROM scan c JOIN shifted s ON s.doc_id = c.doc_id AND s.page = c.page AND s.n = c.n + 1) s)
SELECT doc_id, page, row, trim(regexp_replace(string_agg(line, ' ' ORDER BY x0, y0, line_no), '\\s+', ' ', 'g')) AS text FROM scan JOIN shifted USING (doc_id, page, n) GROUP BY doc_id, page, row""")
def visual_rows(spark: SparkSession, d: str) -> DataFrame:
    shifted = spans(spark, d).withColumn("y0", F.col("y0") - (F.col("line_no") % 2) * 8).withColumn("y1", F.col("y1") - (F.col("line_no") % 2) * 8)
    return O.visual_rows(shifted.select("doc_id", "page", "line_no", "line", "y0", "y1", "x0"))
