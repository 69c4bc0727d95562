"""Queries of the column functions over text, labels, names and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.common import joined
from quillstone.plans.registry import query
from quillstone.plans.roles import bank, docs, lines, roots, spans, table, topics

#: Unicode lower and accent folding on both sides; then only letters, digits and spaces stay.
NORM = "regexp_replace(lower(strip_accents(regexp_replace({0}, '^\\s*\\d+\\s+', ''))), '[^a-z0-9 ]', '', 'g')"


@query(f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.normalise(F.col("text")).alias("norm"))


#: What extraction glues to a text or a scheme, by the id's remainder; the tables have no control characters of their own.
TEXT_DIRT = {0: " (3 marks) 27 ,\x03\x04 \x03,", 1: " 8 BLANK PAGE ,\x05, 4 ,\x06\x07,", 2: " level \x0e high \x0b", 3: " no\x00thing\x7fleft"}
SCHEME_DIRT = {0: " 2Mg + O2 \x01 2MgO", 1: " row\x01 \x01two", 2: " Zn2+ + 2OH–  \x01\tZn(OH)2; \x01 seen", 3: ""}


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    """Control characters in most texts and schemes, and in every eleventh comment nothing else."""
    pick = lambda table, n: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), (F.col("doc_id") % n).cast("int")), F.lit(""))
    comment = F.when(F.col("doc_id") % 11 == 0, F.lit("\x01\x02")).otherwise(F.col("source"))
    return docs(spark, d).select("doc_id", F.concat("text", pick(TEXT_DIRT, 5)).alias("text"), comment.alias("comment"), F.concat("lang", pick(SCHEME_DIRT, 7)).alias("scheme"))


def _sql_text(value: str) -> str:
    """A literal in which control characters are written as chr(n)."""
    return "'" + "".join(f"' || chr({ord(c)}) || '" if c < " " or c == "\x7f" else c for c in value) + "'"


def _sql_dirt(table: dict[int, str], n: int) -> str:
    return f"CASE doc_id % {n} " + " ".join(f"WHEN {k} THEN {_sql_text(v)}" for k, v in table.items()) + " ELSE '' END"


#: DuckDB's patterns cannot look behind, so what stands before is taken in and put back.
STRIP = rf"(?:BLANK PAGE[ \t]+)?,[{T.CONTROL}][{T.CONTROL}, ]*"
ARROW = r"([A-Za-z0-9)\]+–−])[ \t]+\x01[ \t]+([A-Z0-9(])"


def _sql_clean(column: str, symbols: bool = False) -> str:
    out = rf"regexp_replace(regexp_replace(replace({column}, chr(0), ''), '(\s)\d{{1,2}}[ \t]+{STRIP}(?:(?:\d{{1,2}}[ \t]+)?{STRIP})*', '\1', 'g'), '{STRIP}', '', 'g')"
    if symbols:
        out = rf"replace(regexp_replace({out}, '{ARROW}', '\1 → \2', 'g'), chr(1), '✓')"
    out = rf"regexp_replace(regexp_replace(regexp_replace({out}, '[{T.CONTROL}]', ' ', 'g'), ' {{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN regexp_matches({column}, '[{T.CONTROL}]') THEN {out} ELSE {column} END"


DIRTY = f"dirty AS (SELECT doc_id, text || {_sql_dirt(TEXT_DIRT, 5)} AS text, CASE WHEN doc_id % 11 = 0 THEN chr(1) || chr(2) ELSE source END AS comment, lang || {_sql_dirt(SCHEME_DIRT, 7)} AS scheme FROM documents)"


@query(f"WITH {DIRTY} SELECT doc_id, {_sql_clean('text')} AS clean, {_sql_clean('scheme', True)} AS scheme FROM dirty")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).select("doc_id", T.clean_extracted(F.col("text")).alias("clean"), T.clean_extracted(F.col("scheme"), symbols=True).alias("scheme"))


@query(f"""
WITH {DIRTY}, cleaned AS (SELECT doc_id, text AS t, comment AS c, scheme AS s, {_sql_clean('text')} AS text, {_sql_clean('comment')} AS comment, {_sql_clean('scheme', True)} AS scheme FROM dirty),
emptied AS (SELECT doc_id, t, c, s, CASE WHEN text = '' AND t <> '' THEN NULL ELSE text END AS text, CASE WHEN comment = '' AND c <> '' THEN NULL ELSE comment END AS comment, CASE WHEN scheme = '' AND s <> '' THEN NULL ELSE scheme END AS scheme FROM cleaned),
told AS (SELECT doc_id, text, comment, scheme, concat_ws(',', CASE WHEN t IS DISTINCT FROM text THEN 'text' END, CASE WHEN c IS DISTINCT FROM comment THEN 'comment' END, CASE WHEN s IS DISTINCT FROM scheme THEN 'scheme' END) AS changed FROM emptied)
SELECT doc_id, changed, text, comment, scheme FROM told WHERE changed <> ''""")
def clean_columns(spark: SparkSession, d: str) -> DataFrame:
    """Three columns cleaned at once; only changed rows are returned, emptied texts as null."""
    old = _dirty(spark, d)
    new = {"text": T.clean_column(F.col("text")), "comment": T.clean_column(F.col("comment")), "scheme": T.clean_column(F.col("scheme"), symbols=True)}
    out = old.select("doc_id", *(F.col(c).alias(f"old_{c}") for c in new), *(v.alias(c) for c, v in new.items()))
    changed = F.filter(F.array(*(F.when(~F.col(f"old_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in new)), lambda x: x.isNotNull())
    return out.withColumn("changed", F.array_join(changed, ",")).where("changed <> ''").select("doc_id", "changed", *new)


@query(r"""
WITH printed AS (SELECT doc_id, line_no, CASE line_no % 4 WHEN 0 THEN line_no || ' ,' || chr(1) || chr(7) || ',' WHEN 1 THEN line_no || ' Blank  PAGE' WHEN 2 THEN 'P, ' || line_no ELSE line END AS line FROM lines),
bare AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '[\x00-\x1F\x7F,\s]', ' ', 'g'), '(?i)BLANK\s+PAGE', '', 'g'), '[\x00-\x1F\x7F,\s]', '', 'g') AS bare FROM printed)
SELECT doc_id, line_no FROM bare WHERE regexp_matches(bare, '^\d*$')""")
def furniture_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are page furniture; three in four are printed as page numbers, notices and answers here."""
    n = F.col("line_no")
    printed = F.when(n % 4 == 0, F.concat(n, F.lit(" ,\x01\x07,"))).when(n % 4 == 1, F.concat(n, F.lit(" Blank  PAGE"))).when(n % 4 == 2, F.concat(F.lit("P, "), n)).otherwise(F.col("line"))
    return lines(spark, d).where(T.is_furniture(printed)).select("doc_id", "line_no")


@query(rf"""
WITH pages AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM spans GROUP BY doc_id, page),
noted AS (SELECT doc_id, page, CASE doc_id % 9 WHEN 0 THEN text || chr(10) || 'This document consists of 12 printed pages.' || chr(10) || '1 hour' WHEN 1 THEN text || chr(10) || 'Data Sheet' || chr(10) || '4 Which quantity' WHEN 2 THEN text || ' Blank Page [ 2 ]' WHEN 3 THEN 'Blank page' ELSE text END AS text FROM pages)
SELECT doc_id, page, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > {T.NO_TEXT_LAYER} AND len(list_filter([{', '.join(f"'{p}'" for p in T.NON_CONTENT_PHRASES)}], lambda p: contains(lower(text), p))) > 0
  AND NOT regexp_matches(text, '\[\s*\d{{1,2}}\s*\]') AND NOT regexp_matches(text, '(?m)^\s*\d{{1,2}}[.()]') AND NOT regexp_matches(text, '(?m)^\s*[A-D][.)\s]')
  AND len(list_filter(regexp_extract_all(text, '(?m)^\s*\d{{1,2}}\s+(\S+)', 1), lambda w: NOT regexp_matches(w, '^(?i)(hours?|minutes?)\b'))) = 0 AS non_content FROM noted""")
def non_content(spark: SparkSession, d: str) -> DataFrame:
    """Pages that need no reading; some are given a notice, a number, a mark or too little text here."""
    pages = spans(spark, d).groupBy("doc_id", "page").agg(joined(["line_no"], F.col("line"), "\n").alias("text"))
    nth, text = F.col("doc_id") % 9, F.col("text")
    noted = F.when(nth == 0, F.concat(text, F.lit("\nThis document consists of 12 printed pages.\n1 hour"))).when(nth == 1, F.concat(text, F.lit("\nData Sheet\n4 Which quantity")))
    noted = noted.when(nth == 2, F.concat(text, F.lit(" Blank Page [ 2 ]"))).when(nth == 3, F.lit("Blank page")).otherwise(text)
    return pages.select("doc_id", "page", T.is_non_content(noted).alias("non_content"))


@query("""
SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'topic') AS slug FROM documents""")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of whole texts, as if each were a title."""
    return docs(spark, d).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(replace(text, ' the ', chr(8194) || 'the' || chr(9) || chr(7)), chr(7), ''), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS text FROM documents""")
def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    """Wide spaces, tabs and private bullets are set into the texts here, around a common word."""
    set_in = F.replace("text", F.lit(" the "), F.lit(" the\t\x07"))
    return docs(spark, d).select("doc_id", T.collapse_spaces(set_in).alias("text"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    letter = F.when(F.col("l_linenumber") % 2 == 0, "B").otherwise("")
    raw = F.concat(F.lit(" "), letter, F.col("l_orderkey") % 150, F.lit(" ("), F.lower("l_returnflag"), F.lit(") ("), F.repeat(F.lit("I"), F.col("l_linenumber") % 3 + 1), F.lit(")"))
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", raw.alias("raw"))


RAW = "' ' || CASE WHEN l_linenumber % 2 = 0 THEN 'B' ELSE '' END || l_orderkey % 150 || ' (' || lower(l_returnflag) || ') (' || repeat('I', l_linenumber % 3 + 1) || ')'"


@query(f"""
SELECT l_orderkey, l_linenumber, regexp_extract(raw, '^\\s*([A-Z]?\\d{{1,2}})', 1) || array_to_string(list_transform(regexp_extract_all(raw, '\\(\\s*([a-zA-Z]+)\\s*\\)', 1), lambda g: '(' || lower(g) || ')'), '') AS label
FROM (SELECT *, {RAW} AS raw FROM lineitem)""")
def normalise_label(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("l_orderkey", "l_linenumber", T.normalise_label(F.col("raw")).alias("label"))


@query(f"""
SELECT label, split_part(label, '(', 1) AS root, regexp_extract(label, '(\\([^()]*\\)|[^()]+)$', 1) AS own, array_to_string(list_slice(string_split(label, '('), 1, 2), '(') AS folded
FROM (SELECT DISTINCT regexp_extract(raw, '^\\s*([A-Z]?\\d{{1,2}})', 1) || array_to_string(list_transform(regexp_extract_all(raw, '\\(\\s*([a-zA-Z]+)\\s*\\)', 1), lambda g: '(' || lower(g) || ')'), '') AS label FROM (SELECT *, {RAW} AS raw FROM lineitem))""")
def label_parts(spark: SparkSession, d: str) -> DataFrame:
    label = _labels(spark, d).select(T.normalise_label(F.col("raw")).alias("label")).distinct()
    return label.select("label", T.root_label(F.col("label")).alias("root"), T.own_label(F.col("label")).alias("own"), T.folded_label(F.col("label"), 1).alias("folded"))


@query("""
SELECT code, CASE WHEN contains(code, '.') THEN regexp_replace(code, '\\.[^.]+$', '') END AS parent, length(code) - length(replace(code, '.', '')) AS depth, n_objectives > 0 AS is_revisable FROM topics""")
def topic_tree(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("code")
    parent = F.regexp_replace(code, r"\.[^.]+$", "")
    return topics(spark, d).select("code", F.nullif(parent, code).alias("parent"), (F.length(code) - F.length(F.replace(code, F.lit("."), F.lit("")))).alias("depth"), (F.col("n_objectives") > 0).alias("is_revisable"))


MARKED = "body || ' [' || ordinal % 7 || '] and more' || CASE WHEN question_id % 3 = 0 THEN ' [' || ordinal % 4 || ']  ' ELSE '' END"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("question_id") % 3 == 0, F.concat(F.lit(" ["), F.col("ordinal") % 4, F.lit("]  "))).otherwise("")
    return bank(spark, d).select("question_id", F.concat("body", F.lit(" ["), F.col("ordinal") % 7, F.lit("] and more"), tail).alias("text"))


@query(f"""
SELECT question_id, CASE WHEN regexp_matches(text, '\\[\\d{{1,2}}\\]\\s*$') THEN list_sum(list_transform(regexp_extract_all(text, '\\[(\\d{{1,2}})\\]', 1), lambda x: x::INT))::INT END AS marks
FROM (SELECT question_id, {MARKED} AS text FROM bank)""")
def bracket_marks(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("question_id", T.bracket_marks(F.col("text")).alias("marks"))


@query("""
SELECT question_id, trim(regexp_replace(regexp_replace(text, '^\\s*\\d+\\s*\\([a-z]\\)\\s*', ''), '\\.{4,}', '', 'g')) AS text
FROM (SELECT question_id, question_id || ' (a) ' || body || ' ........ end' AS text FROM bank)""")
def strip_label(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("question_id", F.lit(" (a) "), "body", F.lit(" ........ end"))
    return bank(spark, d).select("question_id", F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*\d+\s*\([a-z]\)\s*", ""), r"\.{4,}", "")).alias("text"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT doc_id, line_no, round((x1 - x0) / nullif(y1 - y0, 0), 4) AS ratio FROM spans")
def aspect_ratio(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).select("doc_id", "line_no", F.round((F.col("x1") - F.col("x0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0)), 4).alias("ratio"))


@query("""
SELECT root, CASE priority WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Low' ELSE 'Other' END || ' paper ' || paper || coalesce(' variant ' || nullif(paper % 4, 0), '') AS title FROM roots""")
def paper_title(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(F.lit("1-URGENT"), F.lit("Urgent"), F.lit("5-LOW"), F.lit("Low"))
    variant = F.coalesce(F.concat(F.lit(" variant "), F.nullif(F.col("paper") % 4, F.lit(0))), F.lit(""))
    return roots(spark, d).select("root", F.concat(F.coalesce(F.try_element_at(names, F.col("priority")), F.lit("Other")), F.lit(" paper "), "paper", variant).alias("title"))


@query("""
SELECT root, CASE WHEN len(y) = 0 THEN NULL WHEN list_min(y) = list_max(y) THEN list_min(y) ELSE list_min(y) || '-' || list_max(y) END AS span
FROM (SELECT root, regexp_extract_all('exams of ' || year(o_orderdate) || ' to ' || (year(o_orderdate) + root % 3) || ' no 12', '\\b(?:19|20)\\d{2}\\b') AS y FROM roots)""")
def year_span(spark: SparkSession, d: str) -> DataFrame:
    prose = F.concat(F.lit("exams of "), F.year("o_orderdate"), F.lit(" to "), F.year("o_orderdate") + F.col("root") % 3, F.lit(" no 12"))
    years = F.regexp_extract_all(prose, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))
    low, high = F.array_min(years), F.array_max(years)
    return roots(spark, d).select("root", F.when(F.size(years) > 0, F.when(low == high, low).otherwise(F.concat_ws("-", low, high))).alias("span"))


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?m)^([BCD])', 1), lambda x: x))), '') AS letters FROM documents""")
def option_letters(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"(?m)^([BCD])"), F.lit(1))
    return docs(spark, d).select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), "").alias("letters"))


@query("""
SELECT question_id, CASE WHEN question_id % 50 <> 0 THEN (question_id % 10)::VARCHAR END AS topic_code, question_id % 50 = 0 AS is_corrupt FROM bank""")
def parse_answers(spark: SparkSession, d: str) -> DataFrame:
    """Model answers with a code fence and a trailing comma, repaired and parsed; what still fails is kept as corrupt."""
    raw = F.concat(F.lit("```json\n{\"question_id\": "), F.col("question_id"), F.lit(", \"topic_code\": \""), F.col("question_id") % 10, F.when(F.col("question_id") % 50 == 0, "").otherwise("\",}"), F.lit("\n```"))
    schema = "question_id bigint, topic_code string, corrupt string"
    parsed = F.from_json(T.repaired_json(raw), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return bank(spark, d).select("question_id", parsed.alias("a")).select("question_id", "a.topic_code", F.col("a.corrupt").isNotNull().alias("is_corrupt"))


@query("""
SELECT conv_id, string_agg(CASE WHEN turn < 26 THEN chr((65 + turn)::INT) ELSE (turn + 1)::VARCHAR END || '. ' || text, chr(10) ORDER BY turn, text) || chr(10) || 'Key: ' || chr((65 + conv_id % 4)::INT) AS rendered
FROM conversations WHERE NOT starts_with(text, '[figure') GROUP BY conv_id""")
def render_text(spark: SparkSession, d: str) -> DataFrame:
    """Options in order under a letter, beyond the alphabet under a number, and the key; figure options are left out."""
    turn = F.col("turn")
    rows = table(spark, d, "conversations").where(~F.startswith("text", F.lit("[figure")))
    body = joined(["turn", "text"], F.concat(F.when(turn < 26, F.char(65 + turn)).otherwise((turn + 1).cast("string")), F.lit(". "), "text"), "\n")
    return rows.groupBy("conv_id").agg(F.concat(body, F.lit("\nKey: "), F.char(65 + F.first("conv_id") % 4)).alias("rendered"))


CELL = """CASE question_id % 5 WHEN 0 THEN ordinal % 9 || '*' WHEN 1 THEN ordinal % 9 || 'ft' || chr(10) || 'B1 for 3' WHEN 2 THEN 'M1FT' || chr(10) || 'A' || ordinal % 3 || 'dep' WHEN 3 THEN '12 marks' ELSE 'soi' END"""


@query(f"""
SELECT question_id, coalesce(TRY_CAST(nullif(regexp_extract(trim(cell), '^(\\d{{1,2}})(?:\\s*\\*|ft)?(?:\\s|$)', 1), '') AS INT), list_sum(list_transform(regexp_extract_all(cell, '\\b[MABC](\\d)(?:FT|dep)?\\b', 1), lambda x: x::INT))::INT) AS marks
FROM (SELECT question_id, {CELL} AS cell FROM bank)""")
def mark_codes(spark: SparkSession, d: str) -> DataFrame:
    nth, n = F.col("question_id") % 5, F.col("ordinal")
    cell = F.when(nth == 0, F.concat(n % 9, F.lit("*"))).when(nth == 1, F.concat(n % 9, F.lit("ft\nB1 for 3"))).when(nth == 2, F.concat(F.lit("M1FT\nA"), n % 3, F.lit("dep"))).when(nth == 3, "12 marks").otherwise("soi")
    return bank(spark, d).select("question_id", T.code_marks(cell).alias("marks"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: regexp_replace(regexp_replace(printf('%.7g', x::DOUBLE), '(\\.\\d*?)0+(e|$)', '\\1\\2'), '\\.(e|$)', '\\1')), ',') || ']' AS stored FROM embeddings")
def vector_text(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in the text form that a vector column is written in."""
    return table(spark, d, "embeddings").select("vec_id", T.vector_text(F.col("embedding")).alias("stored"))
