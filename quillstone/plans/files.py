"""Queries of sources and sinks: manifests, names, links, replayed answers, triage and worksheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.common import joined
from quillstone.plans.registry import query
from quillstone.plans.roles import FLOOR, bank, docs, edges, table, topics
from quillstone.sources import names as N
from quillstone.sources.files import applied_decisions, changed_documents, decisions_map, manifest, replayed, work_folder


def _names(spark: SparkSession, d: str) -> DataFrame:
    """A document name for each question; some are of no known type or malformed."""
    k = F.col("question_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    tail = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("_"), 1 + k % 9)).otherwise(F.concat(F.lit("_"), 1 + k % 9, 1 + k % 3))
    stem = F.concat(F.lit(5000) + k % 100, F.lit("_"), pick("mswW", k), F.lpad((k % 100).cast("string"), 2, "0"), F.when(k % 17 == 0, "").otherwise("_"), pick(TYPES, k / 4), tail)
    return bank(spark, d).select("question_id", stem.alias("stem"))


TYPES = ("qp", "ms", "GT", "zz", "er")
NAMES = """names AS (
  SELECT question_id, (5000 + question_id % 100) || '_' || ['m', 's', 'w', 'W'][question_id % 4 + 1] || lpad((question_id % 100)::VARCHAR, 2, '0') || CASE WHEN question_id % 17 = 0 THEN '' ELSE '_' END || ['qp', 'ms', 'GT', 'zz', 'er'][question_id // 4 % 5 + 1] ||
    CASE question_id % 4 WHEN 0 THEN '' WHEN 1 THEN '_' || (1 + question_id % 9) ELSE '_' || (1 + question_id % 9) || (1 + question_id % 3) END AS stem FROM bank),
cut AS (
  SELECT question_id, stem, nullif(regexp_extract(stem, p, 1), '') AS syllabus, nullif(lower(regexp_extract(stem, p, 2)), '') AS letter, TRY_CAST(nullif(regexp_extract(stem, p, 3), '') AS INT) AS yy,
    nullif(lower(regexp_extract(stem, p, 4)), '') AS doc_type, TRY_CAST(nullif(regexp_extract(stem, p, 5), '') AS INT) AS component, TRY_CAST(nullif(regexp_extract(stem, p, 6), '') AS INT) AS variant
  FROM names, (SELECT '(?i)^(\\d{4})_([msw])(\\d{2})_(qp|ms|er|gt|in|ci)(?:_(\\d)(\\d)?)?$' AS p)),
parsed AS (
  SELECT *, CASE letter WHEN 'm' THEN 'feb_march' WHEN 's' THEN 'may_june' WHEN 'w' THEN 'oct_nov' END AS season, CASE letter WHEN 'm' THEN 'fm' WHEN 's' THEN 'mj' WHEN 'w' THEN 'on' END AS short, CASE WHEN yy >= 90 THEN yy + 1900 ELSE yy + 2000 END AS year FROM cut)"""


@query(f"WITH {NAMES} SELECT question_id, stem, syllabus, season, year, doc_type, component, variant FROM parsed")
def parse_doc_name(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("question_id", "stem", N.parsed_name(F.col("stem")).alias("p")).select("question_id", "stem", "p.*")


@query(f"""WITH {NAMES}, keyed AS (SELECT *, 'papers/' || syllabus || '/' || year || '-' || short || '/p' || component || coalesce(variant::VARCHAR, '') AS prefix, question_id % 30 AS number, question_id % 3 AS place FROM parsed WHERE syllabus IS NOT NULL)
SELECT question_id, stem, lower(stem) || '.pdf' AS rebuilt, prefix, prefix || '/' || doc_type || '.pdf' AS document, prefix || '/crops/' || number || '.png' AS crop,
  prefix || '/crops/' || number || '(a)' || CASE WHEN place = 0 THEN '' ELSE '.' || place END || '.png' AS structured_crop, prefix || '/crops/ms-' || number || '-a-iii' || CASE WHEN place = 0 THEN '' ELSE '.' || place END || '.png' AS scheme_crop FROM keyed""")
def build_doc_key(spark: SparkSession, d: str) -> DataFrame:
    """File name, prefix and the keys of a document and its pictures; names without a component have no keys."""
    p = parse_doc_name(spark, d).where("syllabus IS NOT NULL").withColumn("number", F.col("question_id") % 30)
    rebuilt = N.built_name(*(F.col(c) for c in ("syllabus", "season", "year", "doc_type", "component", "variant")))
    prefix, place = F.col("prefix"), F.col("question_id") % 3
    p = p.withColumn("prefix", N.storage_prefix(*(F.col(c) for c in ("syllabus", "year", "season", "component", "variant"))))
    return p.select(
        "question_id",
        "stem",
        rebuilt.alias("rebuilt"),
        "prefix",
        N.document_key(prefix, F.col("doc_type")).alias("document"),
        N.crop_key(prefix, F.col("number")).alias("crop"),
        N.structured_crop_key(prefix, F.concat("number", F.lit("(a)")), place).alias("structured_crop"),
        N.mark_scheme_crop_key(prefix, F.concat("number", F.lit("(a)(iii)")), place).alias("scheme_crop"),
    )


@query("""WITH found AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages),
links AS (SELECT page_id, unnest(range(len(h)))::INT AS place, unnest(h) AS href FROM found)
SELECT page_id, place, href, file FROM (SELECT *, row_number() OVER (PARTITION BY page_id, file ORDER BY place) AS n FROM (SELECT *, regexp_extract(href, '([^/]*)$', 1) AS file FROM links)) WHERE n = 1""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return N.page_links(table(spark, d, "pages")).select("page_id", "place", "href", "file")


@query()
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of two tables' files, held against an earlier manifest: the same, replaced, new and gone."""
    now = manifest(spark, f"{d}/documents.parquet").unionByName(manifest(spark, f"{d}/labels.parquet")).unionByName(manifest(spark, f"{d}/benchmark.parquet"))
    old = F.when(F.col("file").startswith("documents"), F.lit("0" * 64)).otherwise(F.col("checksum"))
    before = now.where(~F.col("file").startswith("labels")).withColumn("checksum", old)
    gone = before.where(F.col("file").startswith("documents")).withColumn("file", F.concat(F.lit("earlier-"), "file"))
    return changed_documents(before.unionByName(gone), now)


@query("""
SELECT question_id, question_id % 9 AS topic_id, CASE WHEN question_id % 13 <> 0 THEN question_id % 10 END AS current, CASE WHEN question_id % 13 = 0 THEN 'unknown' WHEN question_id % 9 = question_id % 10 THEN 'agreed' ELSE 'disagreed' END AS outcome
FROM bank WHERE status <> 'rejected'""")
def replay_answers(spark: SparkSession, d: str) -> DataFrame:
    """Model answers saved as JSON lines before any write, read back and applied to the current tags (some have none here)."""
    answers = bank(spark, d).where("status <> 'rejected'").select("question_id", (F.col("question_id") % 9).alias("topic_id"), F.lit(0.8).alias("confidence"))
    return replayed(spark, answers, edges(spark, d).where("is_primary AND question_id % 13 <> 0"))


@query("""
WITH sheet AS (SELECT paper AS sheet, ordinal::VARCHAR AS position, question_id FROM bank WHERE status <> 'rejected'),
told AS (SELECT paper AS sheet, (ordinal + CASE WHEN ordinal % 9 = 0 THEN 100 ELSE 0 END)::VARCHAR AS position, min(CASE WHEN ordinal % 8 = 0 THEN NULL WHEN ordinal % 5 = 0 THEN '9.9' ELSE '0.' || ordinal % 4 END) AS code FROM bank WHERE ordinal % 7 <> 0 GROUP BY ALL)
SELECT coalesce(s.sheet, t.sheet) AS sheet, coalesce(s.position, t.position) AS position, question_id, code,
  CASE WHEN t.sheet IS NULL THEN 'skipped' WHEN code IS NULL AND s.sheet IS NOT NULL THEN 'malformed' WHEN s.sheet IS NULL THEN 'unknown_position' WHEN code NOT IN (SELECT code FROM topics) THEN 'unknown_code' ELSE 'applied' END AS outcome
FROM sheet s FULL JOIN told t ON s.sheet = t.sheet AND s.position = t.position""")
def position_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions kept as one JSON object of position to code for each paper, read back and applied to its worksheet."""
    q = bank(spark, d)
    place = F.col("ordinal") + F.when(F.col("ordinal") % 9 == 0, 100).otherwise(0)
    code = F.when(F.col("ordinal") % 8 == 0, F.lit(None)).when(F.col("ordinal") % 5 == 0, "9.9").otherwise(F.concat(F.lit("0."), F.col("ordinal") % 4))
    told = q.where("ordinal % 7 <> 0").select("paper", place.cast("string").alias("position"), code.alias("code")).distinct()
    path = work_folder(spark)
    told.groupBy("paper").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("position", "code")))).alias("value")).write.partitionBy("paper").text(path)
    read = decisions_map(spark, path).withColumnRenamed("paper", "sheet")
    sheet = q.where("status <> 'rejected'").select(F.col("paper").alias("sheet"), F.col("ordinal").cast("string").alias("position"), "question_id")
    return applied_decisions(sheet, read, topics(spark, d))


@query(f"""WITH {NAMES} SELECT question_id, stem FROM parsed WHERE doc_type IN ('qp', 'er', 'gt') AND year BETWEEN 2010 AND 2040 AND (component IS NULL OR component IN (1, 2, 4))""")
def wanted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of some types, years and components; those that cover a whole session name none and stay."""
    parsed = N.parsed_name(F.col("stem"))
    return _names(spark, d).where(N.wanted(parsed, doc_types=("qp", "er", "gt"), years=(2010, 2040), components=(1, 2, 4))).select("question_id", "stem")


TRIAGE = """triage AS (
  SELECT question_id, paper, ordinal, confidence, CASE WHEN question_id % 10 = answer THEN 'agreed' WHEN question_id % 3 = 0 AND 10 + question_id % 7 = 10 + answer THEN 'reordered' ELSE 'disagreed' END AS outcome FROM bank)"""


@query(f"""WITH {TRIAGE}
SELECT CASE outcome WHEN 'disagreed' THEN 0 WHEN 'reordered' THEN 1 ELSE 2 END AS rank, paper, lpad(ordinal::VARCHAR, 4, '0') AS label, question_id, outcome FROM triage WHERE confidence < 75""")
def triage_report(spark: SparkSession, d: str) -> DataFrame:
    """Findings below the floor with the columns that order the report, disagreements first; the sink sorts."""
    outcome = F.when(F.col("question_id") % 10 == F.col("answer"), "agreed").when((F.col("question_id") % 3 == 0) & (F.col("question_id") % 7 == F.col("answer")), "reordered").otherwise("disagreed")
    rank = F.when(F.col("outcome") == "disagreed", 0).when(F.col("outcome") == "reordered", 1).otherwise(2)
    rows = bank(spark, d).where(F.col("confidence") < 100 * FLOOR).withColumn("outcome", outcome)
    return rows.select(rank.alias("rank"), "paper", F.lpad(F.col("ordinal").cast("string"), 4, "0").alias("label"), "question_id", "outcome")


@query("""
SELECT doc_id, source, length(text) < 40 AS sparse, text AS stem, (SELECT string_agg(code, ',' ORDER BY code) FROM topics WHERE n_objectives > 0) AS closed_list
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def tag_worksheet(spark: SparkSession, d: str) -> DataFrame:
    """Untagged documents with their whole text and the closed list of topics, which is one row of a handful of codes."""
    listed = topics(spark, d).where("n_objectives > 0").agg(joined(["code"], F.col("code"), ",").alias("closed_list"))
    rows = docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left_anti")
    return rows.select("doc_id", "source", (F.length("text") < 40).alias("sparse"), F.col("text").alias("stem"), listed.scalar().alias("closed_list"))
