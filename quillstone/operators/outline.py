"""Reading of laid-out pages: visual rows, and the nearest lines of a bar."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import collapse_spaces

# The share of the lower line's height that puts lines on one row, and the overlap that lets a bar see a line.
ROW_OVERLAP, SPAN_OVERLAP = 0.25, 0.5


def nearest_lines(bars: DataFrame, lines: DataFrame) -> DataFrame:
    """For each bar the nearest line above and below that overlaps it by more than half a unit across.

    The first bar in order to claim a line gets it; later claims of the line are counted as conflicts.
    """
    b = bars.select("doc_id", "page", F.col("line_no").alias("bar"), F.col("y").alias("bar_y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    both = lines.join(b, ["doc_id", "page"]).where((F.least("x1", "bx1") - F.greatest("x0", "bx0") > SPAN_OVERLAP) & (F.col("line_no") != F.col("bar")))
    side = F.when(F.col("y1") <= F.col("bar_y"), "above").when(F.col("y0") >= F.col("bar_y"), "below")
    gap = F.when(F.col("side") == "above", F.col("bar_y") - F.col("y1")).otherwise(F.col("y0") - F.col("bar_y"))
    best = both.withColumn("side", side).where("side IS NOT NULL").withColumn("gap", gap).groupBy("doc_id", "page", "bar", "side").agg(F.min_by("line_no", F.struct("gap", "line_no")).alias("line_no"))
    w = Window.partitionBy("doc_id", "line_no").orderBy("bar", "side")
    return best.withColumn("conflict", F.row_number().over(w) > 1)


def visual_rows(spans: DataFrame) -> DataFrame:
    """Lines of a page in visual rows, read from left to right: ``doc_id, page, row, text``.

    Lines come in order of ``line_no``; one joins the row before it if it overlaps any line of it by a quarter of the
    lower one's height. Which lines a row has depends on what it took in before, so each page is one ordered scan; a task
    scans all its pages in one pass, and holds no more than the row that is open. Blank lines are passed over.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, held, out = None, 0, [], []

        def close() -> None:
            if held:
                out.append((*place, number, " ".join(line for *_, line in sorted(held, key=lambda h: h[2:5]))))

        def batch_of() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "page", "row", "text"])

        for batch in batches:
            for doc, page, n, line, y0, y1, x0, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first == 1:
                    close()
                    place, number, held = (doc, page), 0, []
                elif not any((low := min(y1 - y0, b - a)) > 0 and (min(y1, b) - max(y0, a)) / low >= ROW_OVERLAP for a, b, *_ in held):
                    close()
                    number, held = number + 1, []
                held.append((y0, y1, round(x0), y0, n, line))
            yield batch_of()
            out.clear()
        close()
        yield batch_of()

    rows = spans.where(F.trim("line") != "").select("doc_id", "page", "line_no", "line", "y0", "y1", "x0").repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "line_no")
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line_no")))
    return rows.mapInArrow(scan, "doc_id bigint, page int, row int, text string").withColumn("text", collapse_spaces(F.col("text")))
