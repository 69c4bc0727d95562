"""Printed question papers made of the test tables: orders are papers, line items their questions on A4 pages of three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.roles import table

#: Read by both dialects: a line item's paper, number, page and top.
_BASE = (
    "l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS n, CAST(l_quantity AS INT) AS q, l_partkey AS part, l_suppkey AS supp, "
    "CAST(floor((l_linenumber - 1) / 3.0) AS INT) + 1 AS page, 60.0 + 220.0 * ((l_linenumber - 1) % 3) AS top"
)
_NAMES = ("text", "x0", "x1", "y0", "y1", "size", "bold")

#: When a question has it, and its text, box, size of type and weight.
_SPANS = (
    ("q % 10 < 7", "CAST(n AS STRING)", "49.6", "55.0", "top", "top + 11", "11.0", "true"),
    ("q % 10 IN (7, 8)", "n || ' Z is a compound'", "49.6", "150.0", "top", "top + 11", "11.0", "true"),
    ("q % 10 = 9", "n || ' mol of gas'", "49.6", "120.0", "top", "top + 11", "11.0", "false"),
    ("q % 7 = 3", "'0'", "52.0", "58.0", "top + 40", "top + 50", "11.0", "true"),
    ("true", "'Stem of ' || part", "72.0", "300.0", "top", "top + 11", "11.0", "false"),
    ("q % 3 = 0", "' 7 '", "150.0", "160.0", "top + 30", "top + 38", "8.0", "true"),
    ("supp % 4 = 0", "'3 mol of it'", "49.6", "140.0", "top + 50", "top + 61", "11.0", "false"),
    ("true", "'B ' || part", "72.0", "200.0", "top + 80", "top + 91", "11.0", "false"),
    ("true", "' C ' || supp", "72.0", "200.0", "top + 100", "top + 111", "11.0", "false"),
    ("part % 3 <> 0", "'D) ' || q", "72.0", "200.0", "top + 120", "top + 131", "11.0", "false"),
    ("true", "'  '", "72.0", "80.0", "top + 130", "top + 210", "90.0", "false"),
    ("q % 11 = 2", "'Section B'", "250.0", "330.0", "top + 190", "top + 203", "13.0", "true"),
    ("n % 3 = 1", "CAST(page AS STRING)", "49.6", "55.0", "30.0", "41.0", "11.0", "true"),
    ("n % 3 = 1", "'the notice'", "49.6", "500.0", "760.0", "768.0", "7.5", "false"),
    ("n % 3 = 1", "'[Turn over now'", "500.0", "550.0", "765.0", "776.0", "11.0", "true"),
    ("n % 3 = 1 AND q % 5 = 0", "'late line'", "72.0", "200.0", "770.0", "790.0", "11.0", "false"),
    ("n % 3 = 1", "'44'", "49.6", "60.0", "800.0", "811.0", "11.0", "true"),
)
_DRAWINGS = (("n % 3 = 1", "50.0", "550.0", "752.0", "753.0"), ("part % 4 = 1", "100.0", "300.0", "top + 125", "top + 165"))
_DOUBLES = {"x0", "x1", "y0", "y1", "size"}


#: Line items that one task turns into printed rows, some ten each, and then sorts.
TASK_ROWS = 100_000


def _dealt(items: DataFrame, *by: str) -> DataFrame:
    """The few columns of line items dealt out by document, or document and page, before they are made into many rows.

    What is made of them stays where it is: everything later goes by the same, or by the same and more. Tasks are counted
    from the rows, as a task's windows hold what it sorts.
    """
    rows = items.count()
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return items.repartition(tasks, *by)


def _base(spark: SparkSession, d: str, by: tuple) -> DataFrame:
    """Tops are doubles here: as decimals they make a method of the rules that is too large for the JVM to compile."""
    return _dealt(table(spark, d, "lineitem").selectExpr(*_split(_BASE)).withColumn("top", F.col("top").cast("double")), *by)


def _exploded(base: DataFrame, page: Column | str, first: str, name: str, rules: tuple, names: tuple) -> DataFrame:
    """A row for each rule that a line item meets, numbered by the rule's place from ``first`` on.

    What isn't met is dropped once made, as filters of arrays aren't compiled, and a rule makes no more than its own fields:
    all rules are one method, which the JVM compiles up to 8,000 bytes.
    """
    field = lambda c, e: F.expr(e).cast("double" if c in _DOUBLES else "boolean" if c == "bold" else "string").alias(c)
    each = F.array(*(F.when(F.expr(rule[0]), F.struct(*map(field, names, rule[1:]))) for rule in rules))
    return base.select("doc_id", page, F.expr(first).alias("first"), F.posexplode(each).alias("k", "s")).where("s IS NOT NULL").select("doc_id", "page", (F.col("first") + F.col("k")).alias(name), "s.*")


def _made(base: DataFrame, rules: tuple, names: tuple) -> DataFrame:
    return _exploded(base, "page", "n * 20", "span_no", rules, names)


def _split(text: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def printed_spans(spark: SparkSession, d: str, *by: str) -> DataFrame:
    return _made(_base(spark, d, by or ("doc_id",)), _SPANS, _NAMES)


def drawings(spark: SparkSession, d: str, *by: str) -> DataFrame:
    return _made(_base(spark, d, by or ("doc_id",)), _DRAWINGS, ("x0", "x1", "y0", "y1")).drop("span_no")


def pages(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """Every hundredth paper or so is not A4."""
    width = F.when(F.col("doc_id") % 97 == 0, 612.0).otherwise(595.3)
    return _base(spark, d, by or ("doc_id",)).select("doc_id", "page").distinct().select("doc_id", "page", width.alias("width"), F.lit(841.9).alias("height"))


def _sql(rules: tuple, names: tuple) -> str:
    field = lambda c, e: f"({e})::{'DOUBLE' if c in _DOUBLES else 'BOOLEAN' if c == 'bold' else 'VARCHAR'} AS {c}"
    return " UNION ALL ".join(f"SELECT doc_id, page, n * 20 + {k} AS span_no, {', '.join(map(field, names, rule[1:]))} FROM items WHERE {rule[0]}" for k, rule in enumerate(rules))


PRINTED_SQL = rf"""
items AS (SELECT {_BASE} FROM lineitem),
printed AS ({_sql(_SPANS, _NAMES)}),
drawn AS ({_sql(_DRAWINGS, ("x0", "x1", "y0", "y1"))}),
sheets AS (SELECT DISTINCT doc_id, page, CASE WHEN doc_id % 97 = 0 THEN 612.0 ELSE 595.3 END AS width, 841.9 AS height FROM items),
known AS (SELECT doc_id, page FROM sheets WHERE abs(width - 595) <= 2 AND abs(height - 842) <= 2),
tidy AS (SELECT * REPLACE (regexp_replace(text, '^\s+|\s+$', '', 'g') AS text), y0 > 690 AND (size < 9 OR starts_with(regexp_replace(text, '^\s+', ''), '[Turn over')) AS footer FROM printed),
numbered AS (
  SELECT *, CASE WHEN regexp_full_match(text, '\d{{1,9}}') THEN text::INT WHEN bold AND regexp_matches(text, '^\d{{1,2}}\s+\S') THEN regexp_extract(text, '^\d+')::INT END AS number
  FROM tidy WHERE x0 < 60 AND y0 > 45 AND y0 < 780),
starts AS (SELECT doc_id, page, span_no, number, y0 FROM numbered WHERE number >= 1),
bounded AS (SELECT *, lead(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, span_no) AS next FROM starts JOIN known USING (doc_id, page)),
inks AS (
  SELECT m.doc_id, m.page, max(m.y1) AS ink FROM (
    SELECT doc_id, page, y0, y1 FROM tidy WHERE text <> '' AND NOT footer UNION ALL SELECT doc_id, page, y0, y1 FROM drawn WHERE NOT (y0 > 690 AND y1 - y0 < 2 AND x1 - x0 > 400)
  ) m JOIN bounded b ON m.doc_id = b.doc_id AND m.page = b.page AND b.next IS NULL AND m.y0 > b.y0 WHERE m.y0 <= 780 GROUP BY m.doc_id, m.page),
regions AS (
  SELECT doc_id, page, number, 45.0::DOUBLE AS x0, y0 - 8 AS y0, 555.0::DOUBLE AS x1, greatest(y0 + 1, CASE WHEN next IS NULL THEN coalesce(ink + 8, 780) ELSE next - 8 END) AS y1
  FROM bounded LEFT JOIN inks USING (doc_id, page))
"""

#: Read by both dialects: eight orders are a document, two of them a page; a line item is listed once.
_LISTED = "CAST(floor(l_orderkey / 8.0) AS BIGINT) AS doc_id, CAST(l_orderkey % 8 AS INT) AS o, CAST(l_linenumber AS INT) AS n, CAST(min(l_quantity) AS INT) AS q, min(l_partkey) AS part, min(l_suppkey) AS supp"

#: A syllabus's rows: text, size of type, weight, left edge.
_SYLLABUS = (
    ("n = 1 AND o IN (0, 4, 6)", "(o + 1) || CASE WHEN o = 0 AND doc_id % 5 = 0 OR o = 6 THEN ' Subject contents' WHEN o = 4 AND doc_id % 2 = 0 THEN ' Assessment' ELSE ' Subject content' END", "18.0", "true", "62.4"),
    ("n = 1", "(o % 3 + 1) || ' Section ' || o || CASE WHEN o > 2 THEN ' Continued ' ELSE '' END", "13.0", "true", "62.4"),
    ("n % 3 = 2", "(o % 3 + 1) || '.' || (q % 3 + 1) || ' Topic ' || q || CASE WHEN q % 2 = 0 THEN ' continued' ELSE '' END", "10.0", "true", "62.4"),
    ("q % 7 = 1", "(o % 3 + 1) || '.1.' || (q % 2 + 1) || ' Part of ' || part", "10.0", "false", "62.4"),
    ("q % 2 = 0", "n || ' explain ' || part", "10.0", "false", "62.4"),
    ("q % 3 = 0", "'and more of ' || supp", "10.0", "false", "85.0"),
    ("q % 5 = 0", "'7 no item, too far in'", "10.0", "false", "85.0"),
)
#: A mark scheme's lines; documents of every third number write marks as lone numbers.
_SCHEME = (
    ("n = 1 AND o % 2 = 0", "'before the notice'"),
    ("n = 1 AND o % 2 = 0 AND part % 9 <> 0", "'© of the board'"),
    ("n = 1 AND o = 0", "'1 general principle'"),
    ("n = 1 AND o % 2 = 0", "'Page ' || (o + 1) || ' of 8'"),
    ("n = 1 AND o % 2 = 0", "'Question'"),
    ("n = 1 AND o % 2 = 0", "' Answer '"),
    ("n = 1 AND o = 4", "'Section B'"),
    ("n = 1", "(o + 1) || '(a)'"),
    ("n = 2", "(o + 1) || '(a)(i)2 first point'"),
    ("n = 3", "'( b )'"),
    ("n = 4", "(o + q % 3) || ' (b) (ii) of ' || part"),
    ("n = 5", "'((c) (v)'"),
    ("n = 6", "CAST(o + 2 AS STRING)"),
    ("n = 6 AND q % 2 = 0", "'4Be'"),
    ("n = 7", "'(i) B' || (o + 3)"),
    ("true", "'award  for ' || part"),
    ("q % 13 = 0", "(o + 2) || ' 250 J'"),
    ("q % 2 = 0 AND doc_id % 3 <> 0", "'M' || (q % 3 + 1)"),
    ("q % 4 = 1 AND doc_id % 3 <> 0", "'a1'"),
    ("q % 3 = 1", "CAST(q % 4 AS STRING)"),
)
#: Threshold documents: components up to order 3, grades, then combinations by code or by list.
_THRESHOLDS = (
    ("n = 1 AND o < 4", "'Component ' || (o + 1) || CASE WHEN q % 4 = 0 THEN '' ELSE CAST(q % 3 + 1 AS STRING) END"),
    ("n = 1 AND o < 4", "CAST(80 + q AS STRING)"),
    ("n = 1 AND o < 4", "' ' || (70 + q % 5)"),
    ("n = 1 AND o < 4", "CAST(60 + q % 5 AS STRING)"),
    ("n = 1 AND o < 4", "CASE WHEN doc_id % 7 = 3 AND o = 2 THEN 'n/a' ELSE '50' END"),
    ("n = 1 AND o < 4", "'40'"),
    ("n = 1 AND o < 4", "'30'"),
    ("n = 1 AND o = 4 AND doc_id % 5 <> 0", "'A*'"),
    ("n = 2 AND q % 2 = 0", "'11'"),
    ("n = 1 AND o > 4", "CASE WHEN q % 2 = 0 THEN 'A' || substr('XYZ', CAST(q % 3 + 1 AS INT), 1) ELSE '1' || (q % 3) || ', 21, 4' || (o % 2) END"),
    ("n = 1 AND o > 4", "CAST(160 + q AS STRING)"),
    ("n = 1 AND o > 4 AND q % 2 = 0", "'11, 21,31'"),
    ("n = 1 AND o > 4", "'140'"),
    ("n = 1 AND o > 4", "'99'"),
    ("n = 1 AND o > 4", "'88'"),
    ("n = 1 AND o > 4", "'77'"),
    ("n = 1 AND o > 4", "CAST(60 + q % 7 AS STRING)"),
    ("n = 1 AND o > 4 AND part % 11 <> 0", "'12'"),
    ("n = 3", "'the end'"),
)
#: Answer grids: pages of orders 0 and 1 are modern, of 2 to 5 legacy, the rest neither.
_GRIDS = (
    ("n = 1 AND o % 2 = 0", "'12'"),
    ("n = 1 AND o % 2 = 0", "'a'"),
    ("n = 1 AND o < 2", "'Question'"),
    ("n = 1 AND o = 0", "'ANSWER   Mark'"),
    ("n = 1 AND o = 1", "'Answer'"),
    ("n = 1 AND o = 1", "'Marks'"),
    ("n = 1 AND o IN (2, 4)", "'Question Number'"),
    ("n = 1 AND o IN (2, 4)", "'Key'"),
    ("q % 17 <> 0", "CAST(o * 5 + n AS STRING)"),
    ("true", "substr('ABCDEabcdeX', CAST((o * 5 + n + CASE WHEN q % 19 = 0 THEN 1 ELSE 0 END) % 11 + 1 AS INT), 1)"),
    ("o < 2 AND q % 11 <> 0", "'1'"),
)


def _listed(spark: SparkSession, d: str, rules: tuple, names: tuple) -> DataFrame:
    keys = _split(_LISTED)[:3]
    items = _dealt(table(spark, d, "lineitem").selectExpr(keys[0], "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey"), "doc_id")
    base = items.groupBy("doc_id", "l_orderkey", "l_linenumber").agg(*(F.expr(e) for e in _split(_LISTED)[3:])).selectExpr("doc_id", *keys[1:], "q", "part", "supp")
    return _exploded(base, F.floor(F.col("o") / 2).cast("int").alias("page"), "o * 200 + n * 20", "line_no", rules, names)


def listed_docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents that have lines, which every line item gives: no lines are made for it."""
    return table(spark, d, "lineitem").selectExpr(_split(_LISTED)[0]).distinct()


def syllabus_rows(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, _SYLLABUS, ("text", "size", "bold", "x0")).withColumnRenamed("line_no", "row_no")


def scheme_lines(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, _SCHEME, ("line",))


def threshold_lines(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, _THRESHOLDS, ("line",))


def grid_lines(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, _GRIDS, ("line",))


def _listed_sql(name: str, rules: tuple, names: tuple) -> str:
    field = lambda c, e: f"({e})::{'DOUBLE' if c in ('size', 'x0') else 'BOOLEAN' if c == 'bold' else 'VARCHAR'} AS {c}"
    rows = " UNION ALL ".join(f"SELECT doc_id, (o // 2)::INT AS page, o * 200 + n * 20 + {k} AS line_no, {', '.join(map(field, names, rule[1:]))} FROM listed WHERE {rule[0]}" for k, rule in enumerate(rules))
    return f"listed AS (SELECT {_LISTED} FROM lineitem GROUP BY l_orderkey, l_linenumber),\n{name} AS ({rows})"


SYLLABUS_SQL = _listed_sql("syllabus", _SYLLABUS, ("text", "size", "bold", "x0"))
SCHEME_SQL = _listed_sql("scheme", _SCHEME, ("line",))
THRESHOLDS_SQL = _listed_sql("thresholds", _THRESHOLDS, ("line",))
GRIDS_SQL = _listed_sql("grids", _GRIDS, ("line",))
