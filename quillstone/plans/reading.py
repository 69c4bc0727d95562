"""Queries that read syllabuses, mark schemes, threshold tables and answer grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import reading as R
from quillstone.plans.printed import GRIDS_SQL, SCHEME_SQL, SYLLABUS_SQL, THRESHOLDS_SQL, grid_lines, listed_docs, scheme_lines, syllabus_rows, threshold_lines
from quillstone.plans.registry import query
from quillstone.sources.files import stored


@query(
    f"WITH {SYLLABUS_SQL}"
    r""", chapters AS (SELECT doc_id, page, max({'r': line_no, 'content': starts_with(lower(regexp_extract(text, '^\d+\s+(.+)$', 1)), 'subject content')}).content AS content FROM syllabus WHERE size >= 16 AND bold AND regexp_matches(text, '^\d+\s+.+$') GROUP BY doc_id, page),
body AS (SELECT s.* FROM syllabus s ASOF JOIN chapters c ON s.doc_id = c.doc_id AND s.page >= c.page WHERE c.content AND s.size < 16),
told AS (
  SELECT doc_id, line_no, text, regexp_replace(regexp_replace(text, '^[\d.]+\s+', ''), '\s+continued\s*$', '', 'i') AS title,
    CASE WHEN x0 < 75 AND bold AND size >= 12 THEN nullif(regexp_extract(text, '^(\d+)\s+.+$', 1), '') END AS s,
    CASE WHEN x0 < 75 AND bold THEN nullif(regexp_extract(text, '^(\d+\.\d+)\s+.+$', 1), '') END AS t,
    CASE WHEN x0 < 75 AND NOT bold THEN nullif(regexp_extract(text, '^(\d+\.\d+\.\d+)\s+.+$', 1), '') END AS u,
    CASE WHEN x0 < 75 AND NOT bold THEN nullif(regexp_extract(text, '^\d+\s+(.+)$', 1), '') END AS o
  FROM body),
a AS (SELECT *, last_value(s IGNORE NULLS) OVER w AS section, count(s) OVER w AS s_run FROM told WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
b AS (SELECT *, last_value(CASE WHEN section IS NOT NULL THEN t END IGNORE NULLS) OVER w AS topic, count(CASE WHEN section IS NOT NULL THEN t END) OVER w AS t_run FROM a WINDOW w AS (PARTITION BY doc_id, s_run ORDER BY line_no)),
c AS (SELECT *, last_value(CASE WHEN topic IS NOT NULL THEN u END IGNORE NULLS) OVER (PARTITION BY doc_id, s_run, t_run ORDER BY line_no) AS subtopic, s IS NOT NULL OR (t IS NOT NULL AND section IS NOT NULL) OR (u IS NOT NULL AND topic IS NOT NULL) AS opens FROM b),
heads AS (SELECT doc_id, section, topic, subtopic, arg_min(title, line_no) AS title, min(line_no) AS first_row FROM c WHERE opens GROUP BY ALL),
texts AS (SELECT *, count(o) OVER (PARTITION BY doc_id, section, topic, subtopic ORDER BY line_no) AS item FROM c WHERE NOT opens AND topic IS NOT NULL),
items AS (SELECT doc_id, section, topic, subtopic, item, string_agg(coalesce(o, text), ' ' ORDER BY line_no) AS text FROM texts WHERE item > 0 GROUP BY ALL),
lists AS (SELECT doc_id, section, topic, subtopic, string_agg(text, '|' ORDER BY item) AS objectives FROM items GROUP BY ALL)
SELECT h.doc_id, h.section, h.topic, h.subtopic, CASE WHEN h.topic IS NULL THEN 1 WHEN h.subtopic IS NULL THEN 2 ELSE 3 END AS level, title, coalesce(objectives, '') AS objectives, first_row
FROM heads h LEFT JOIN lists l ON h.doc_id = l.doc_id AND h.section IS NOT DISTINCT FROM l.section AND h.topic IS NOT DISTINCT FROM l.topic AND h.subtopic IS NOT DISTINCT FROM l.subtopic""",
    roles=False,
)
def outline_sections(spark: SparkSession, d: str) -> DataFrame:
    """The topic tree of each syllabus; the ordered objectives are joined for the comparison alone."""
    return R.syllabus_outline(syllabus_rows(spark, d)).withColumn("objectives", F.array_join("objectives", "|"))


ENTRIES_SQL = r"""
past AS (SELECT doc_id, page, line_no, trim(line) AS line, coalesce(bool_or(line LIKE '©%') OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM scheme),
tabled AS (SELECT *, bool_or(line = 'Question') OVER (PARTITION BY doc_id ORDER BY page, line_no) AS open, bool_or(line = 'Question') OVER (PARTITION BY doc_id) AS tables FROM past WHERE past),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS at_, line AS raw FROM tabled WHERE (open OR NOT tables) AND line NOT IN ('Question', 'Answer', 'Marks', '') AND NOT regexp_matches(line, '^Page \d+ of \d+$|^Section [A-Z]$')),
spaced AS (SELECT doc_id, at_, raw, regexp_replace(regexp_replace(regexp_replace(raw, '\(\(([a-z]+)\)', '(\1)', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g') AS line FROM kept),
loose AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(line, '([0-9)])(\([a-zA-Z]+\))', '\1 \2', 'g'), '([0-9)])(\([a-zA-Z]+\))', '\1 \2', 'g'), '\)(\d)', ') \1', 'g') AS line) FROM spaced),
l0 AS (SELECT *, bool_or(regexp_matches(raw, '^[BMCAbmca]\d$') OR regexp_matches(raw, '\[\d{1,2}\]')) OVER (PARTITION BY doc_id) AS coded, lead(raw) OVER (PARTITION BY doc_id ORDER BY at_) AS after,
  CASE WHEN regexp_matches(line, '^[BMCAbmca]\d$') THEN line[2]::INT END AS code, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS t FROM loose),
l1 AS (SELECT *, CASE WHEN code IS NULL AND regexp_matches(t[1], '^[A-Z]?\d{1,2}$')
    AND (regexp_matches(t[1], '^[A-Z]') OR (len(t) = 1 AND coded) OR (len(t) > 1 AND regexp_matches(t[2], '^\(([a-z]|ii|iii|iv|vi|vii|viii|ix)\)$')))
    AND NOT (len(t) = 1 AND coalesce(regexp_matches(after, '^\d{1,3}[A-Z][a-z]?$|^\d+(\.\d+)?\s+10($|\W)'), false)) THEN regexp_extract(t[1], '\d+$')::INT END AS ordinal FROM l0),
l2 AS (SELECT *, max(ordinal) OVER (PARTITION BY doc_id ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM l1),
l3 AS (SELECT *, CASE WHEN ordinal > coalesce(highest, -1) THEN t[1] END AS root_at FROM l2),
l4 AS (SELECT *, last_value(root_at IGNORE NULLS) OVER w AS root, count(root_at) OVER w AS r_run FROM l3 WINDOW w AS (PARTITION BY doc_id ORDER BY at_)),
l5 AS (SELECT *, CASE WHEN ordinal IS NOT NULL AND (root_at IS NOT NULL OR t[1] = root) THEN 1 ELSE 0 END AS i0 FROM l4),
l6 AS (SELECT *, CASE WHEN code IS NULL AND regexp_matches(t[i0 + 1], '^\([a-z]\)$') THEN t[i0 + 1][2] END AS p FROM l5),
l7 AS (SELECT *, CASE WHEN p NOT IN ('i', 'v', 'x') OR count(p) OVER (PARTITION BY doc_id, r_run ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 THEN p END AS part_at FROM l6),
l8 AS (SELECT *, last_value(part_at IGNORE NULLS) OVER (PARTITION BY doc_id, r_run ORDER BY at_) AS part FROM l7),
l9 AS (SELECT *, part_at IS NOT NULL AND part_at IS DISTINCT FROM lag(part) OVER (PARTITION BY doc_id, r_run ORDER BY at_) AS new_part, i0 + (part_at IS NOT NULL)::INT AS i1 FROM l8),
m0 AS (SELECT *, sum(new_part::INT) OVER (PARTITION BY doc_id, r_run ORDER BY at_) AS p_run, CASE WHEN code IS NULL AND regexp_matches(t[i1 + 1], '^\((i|ii|iii|iv|v|vi|vii|viii|ix|x)\)$') THEN trim(t[i1 + 1], '()') END AS sub_at FROM l9),
m1 AS (SELECT *, last_value(sub_at IGNORE NULLS) OVER (PARTITION BY doc_id, r_run, p_run ORDER BY at_) AS sub FROM m0),
m2 AS (SELECT *, sub_at IS NOT NULL AND sub_at IS DISTINCT FROM lag(sub) OVER (PARTITION BY doc_id, r_run, p_run ORDER BY at_) AS new_sub, i1 + (sub_at IS NOT NULL)::INT AS i FROM m1),
m3 AS (SELECT *, sum((root_at IS NOT NULL OR new_part OR new_sub)::INT) OVER (PARTITION BY doc_id ORDER BY at_) AS entry, root || coalesce('(' || part || ')', '') || coalesce('(' || sub || ')', '') AS label, coalesce(code, CASE WHEN i = 0 AND NOT coded AND regexp_matches(line, '^\d{1,2}$') THEN line::INT END) AS m FROM m2),
m4 AS (SELECT *, CASE WHEN m IS NULL THEN nullif(CASE WHEN i > 0 THEN array_to_string(t[i + 1:], ' ') ELSE line END, '') END AS content_at FROM m3 WHERE root IS NOT NULL),
m5 AS (SELECT doc_id, entry, arg_min(label, at_) AS label, string_agg(content_at, ' ' ORDER BY at_) AS content, nullif(sum(m), 0)::BIGINT AS marks FROM m4 GROUP BY doc_id, entry)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY entry) AS entry, label, content, marks FROM m5 WHERE content <> ''"""


@query(f"WITH {SCHEME_SQL}, {ENTRIES_SQL}", roles=False)
def entry_collect(spark: SparkSession, d: str) -> DataFrame:
    return R.scheme_entries(R.scheme_lines(scheme_lines(spark, d)))


BANDS_SQL = r"""
trimmed AS (SELECT doc_id, row_number() OVER w AS spot, trim(line) AS line, coalesce(bool_or(trim(line) = 'A*') OVER w, false) AS starred, list(trim(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS nxt FROM thresholds WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
heads AS (
  SELECT *, CASE kind WHEN 'c' THEN 7 WHEN 'p' THEN 9 ELSE 8 END AS long, CASE kind WHEN 'c' THEN nxt[1:6] WHEN 'p' THEN list_concat(nxt[1:1], nxt[3:8]) ELSE nxt[1:7] END AS numbers
  FROM (SELECT *, CASE WHEN NOT starred AND regexp_matches(line, '^Component \d+$') THEN 'c' WHEN starred AND regexp_matches(line, '^[A-Z]{2}$') THEN 'p' WHEN starred AND regexp_matches(line, '^\d{1,2}(,\s*\d{1,2})*$') THEN 'l' END AS kind FROM trimmed) WHERE kind IS NOT NULL),
taken AS (
  SELECT doc_id, min(spot) AS spot FROM heads GROUP BY doc_id
  UNION ALL SELECT t.doc_id, (SELECT min(n.spot) FROM heads n WHERE n.doc_id = t.doc_id AND n.spot >= h.spot + h.long) FROM taken t JOIN heads h ON h.doc_id = t.doc_id AND h.spot = t.spot),
used AS (SELECT h.* FROM heads h JOIN (SELECT DISTINCT doc_id, spot FROM taken WHERE spot IS NOT NULL) USING (doc_id, spot)),
verdicts AS (
  SELECT doc_id, CASE WHEN NOT bool_and(kind IS NULL OR coalesce(whole, false)) THEN 'not numbers' WHEN NOT coalesce(bool_or(kind = 'c'), false) OR NOT coalesce(bool_or(kind <> 'c'), false) THEN 'a table is missing' END AS problem
  FROM (SELECT DISTINCT doc_id FROM trimmed) LEFT JOIN (SELECT doc_id, kind, len(numbers) = CASE kind WHEN 'c' THEN 6 ELSE 7 END AND len(list_filter(numbers, lambda v: NOT regexp_matches(v, '^\d{1,9}$'))) = 0 AS whole FROM used) USING (doc_id) GROUP BY doc_id),
good AS (SELECT u.* FROM used u JOIN verdicts v USING (doc_id) WHERE v.problem IS NULL),
ranked AS (SELECT *, unnest(range(1, len(numbers)))::INT AS i FROM good),
read_bands AS (
SELECT doc_id, CASE kind WHEN 'c' THEN 'component' ELSE 'combination' END AS grain, CASE kind WHEN 'c' THEN line[11]::INT END AS component, CASE WHEN kind = 'c' AND length(line) = 12 THEN line[12]::INT END AS variant,
  CASE kind WHEN 'p' THEN line WHEN 'l' THEN replace(line, ' ', '') END AS combination, CASE kind WHEN 'p' THEN nxt[2] WHEN 'l' THEN line END AS components,
  CASE kind WHEN 'c' THEN ['A', 'B', 'C', 'D', 'E'][i] ELSE ['A*', 'A', 'B', 'C', 'D', 'E'][i] END AS grade, numbers[i + 1]::INT AS low, numbers[i]::INT - (i > 1)::INT AS high, NULL::VARCHAR AS problem
FROM ranked UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, problem FROM verdicts WHERE problem IS NOT NULL)"""


@query(f"WITH RECURSIVE {THRESHOLDS_SQL}, {BANDS_SQL} SELECT * FROM read_bands", roles=False)
def threshold_tables(spark: SparkSession, d: str) -> DataFrame:
    """Grade bands at both grains, and the documents that are refused."""
    return R.threshold_tables(threshold_lines(spark, d))


@query(
    f"WITH RECURSIVE {THRESHOLDS_SQL}, {BANDS_SQL}"
    """, fresh AS (SELECT doc_id, grain, coalesce(combination, component || coalesce('-' || variant, '')) AS unit, grade, max(low) AS low, max(high) AS high FROM read_bands WHERE problem IS NULL GROUP BY ALL),
stored AS (SELECT doc_id, grain, unit, grade, low + 1 AS low, high FROM fresh WHERE grade <> 'C' UNION ALL SELECT doc_id, grain, unit, 'U', 0, low - 1 FROM fresh WHERE grade = 'E')
SELECT doc_id, grain, unit, grade, coalesce(f.low, s.low) AS low, coalesce(f.high, s.high) AS high, s.doc_id IS NULL AS is_new
FROM (SELECT * FROM fresh WHERE doc_id % 2 = 0) f FULL JOIN stored s USING (doc_id, grain, unit, grade)""",
    roles=False,
)
def threshold_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What documents of even numbers say now replaces what was stored of both grains; other rows stay."""
    fresh = stored(R.band_units(R.threshold_tables(threshold_lines(spark, d))))
    least = fresh.where("grade = 'E'").select("doc_id", "grain", "unit", F.lit("U").alias("grade"), F.lit(0).alias("low"), (F.col("low") - 1).alias("high"))
    before = fresh.where("grade <> 'C'").withColumn("low", F.col("low") + 1).unionByName(least)
    return R.upserted_bands(before, fresh.where("doc_id % 2 = 0"))


@query(
    f"WITH RECURSIVE {THRESHOLDS_SQL}, {BANDS_SQL}"
    """, fresh AS (SELECT doc_id, grain, coalesce(combination, component || coalesce('-' || variant, '')) AS unit, grade, max(low) AS low, max(high) AS high FROM read_bands WHERE problem IS NULL GROUP BY ALL),
marks AS (SELECT DISTINCT doc_id, unit, mark FROM fresh, (SELECT unnest([-1, 29, 30, 45, 50, 59, 60, 75, 100, 140, 200]) AS mark))
SELECT m.doc_id, m.unit, m.mark, max(b.grade) AS grade FROM marks m LEFT JOIN fresh b ON b.doc_id = m.doc_id AND b.unit = m.unit AND m.mark BETWEEN b.low AND b.high GROUP BY ALL""",
    roles=False,
)
def mark_grades(spark: SparkSession, d: str) -> DataFrame:
    """The grade of some marks in each component and combination; none above the maximum or below the last grade."""
    fresh = stored(R.band_units(R.threshold_tables(threshold_lines(spark, d))))
    some = F.explode(F.array(*map(F.lit, (-1, 29, 30, 45, 50, 59, 60, 75, 100, 140, 200)))).alias("mark")
    return R.graded(fresh.select("doc_id", "unit").distinct().select("doc_id", "unit", some), fresh)


GRID_SQL = r"""
tokens AS (SELECT doc_id, page, line_no, trim(line) AS token FROM grids WHERE trim(line) <> ''),
sides AS (SELECT doc_id, page, regexp_matches(flat, 'question answer marks?') AS modern, regexp_matches(flat, 'question number key') AS legacy FROM (SELECT doc_id, page, lower(regexp_replace(string_agg(token, ' ' ORDER BY line_no), '\s+', ' ', 'g')) AS flat FROM tokens GROUP BY doc_id, page)),
seq AS (SELECT *, row_number() OVER w AS pos, upper(lead(token) OVER w) AS answer, lead(token, 2) OVER w AS marks FROM tokens JOIN sides USING (doc_id, page) WHERE modern OR legacy WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
keys AS (SELECT doc_id, page, min(pos) AS key FROM seq WHERE lower(token) = 'key' GROUP BY doc_id, page),
pairs AS (SELECT seq.*, key FROM seq LEFT JOIN keys USING (doc_id, page) WHERE regexp_matches(token, '^\d{1,9}$') AND regexp_matches(answer, '^[A-E]$')),
taken AS (
  SELECT doc_id, page, pos, token, answer FROM pairs WHERE modern AND regexp_matches(marks, '^\d+$')),
scan AS (
  SELECT doc_id, page, min(pos) AS pos FROM taken GROUP BY doc_id, page
  UNION ALL SELECT s.doc_id, s.page, (SELECT min(t.pos) FROM taken t WHERE t.doc_id = s.doc_id AND t.page = s.page AND t.pos >= s.pos + 3) FROM scan s WHERE s.pos IS NOT NULL),
found AS (
  SELECT doc_id, token, answer FROM taken JOIN scan USING (doc_id, page, pos)
  UNION ALL SELECT doc_id, token, answer FROM pairs WHERE NOT modern AND (key IS NULL OR pos > key)),
grid AS (SELECT doc_id, token::INT AS number, min(answer) AS answer FROM found GROUP BY doc_id, token::INT HAVING min(answer) = max(answer))"""


@query(f"WITH RECURSIVE {GRIDS_SQL}, {GRID_SQL} SELECT * FROM grid", roles=False)
def answer_grid(spark: SparkSession, d: str) -> DataFrame:
    return R.answer_grid(grid_lines(spark, d))


@query(
    f"WITH RECURSIVE {GRIDS_SQL}, {GRID_SQL}"
    """, expected AS (SELECT DISTINCT doc_id, (20 + doc_id % 10)::INT AS n FROM grids),
sized AS (SELECT e.doc_id, e.n, count(number)::INT AS found, min(number) AS least FROM expected e LEFT JOIN grid USING (doc_id) GROUP BY e.doc_id, e.n),
lost AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(range(1, n + 1))::INT AS i FROM sized WHERE found > 0) b WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.doc_id = b.doc_id AND g.number = b.i))
SELECT doc_id, 'count' AS kind, found AS first, n AS last FROM sized WHERE found <> n
UNION ALL SELECT doc_id, 'start', least, least FROM sized WHERE least <> 1
UNION ALL SELECT doc_id, 'missing', min(i), max(i) FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM lost) GROUP BY doc_id, run""",
    roles=False,
)
def grid_problems(spark: SparkSession, d: str) -> DataFrame:
    """Grids held against the number of questions that each paper should have (here, 20 to 29)."""
    return R.grid_problems(R.answer_grid(grid_lines(spark, d)), listed_docs(spark, d).select("doc_id", (20 + F.col("doc_id") % 10).alias("n")))
