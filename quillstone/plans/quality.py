"""Queries of constraint, completeness and reconciliation checks: each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.catalogue import published
from quillstone.operators.common import flagged, gaps, problems
from quillstone.plans.catalogue import TOPIC_COUNTS, _topic_counts
from quillstone.plans.registry import query
from quillstone.plans.roles import attempts, bank, docs, edges, leaves, roots, spans, table, topics


@query("""
WITH d AS (SELECT DISTINCT paper, ordinal FROM bank), m AS (SELECT paper, max(ordinal) AS top FROM d GROUP BY paper)
SELECT paper, x AS ordinal FROM (SELECT paper, unnest(range(1, top + 1)) AS x FROM m) WHERE (paper, x) NOT IN (SELECT paper, ordinal FROM d)""")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Numbers from 1 to a paper's largest that no question of it has."""
    return gaps(bank(spark, d).select("paper", "ordinal"), ["paper"], "ordinal")


@query("""
SELECT 'natural_key' AS rule, label AS key, count(*) AS n FROM leaves GROUP BY label HAVING count(*) > 1
UNION ALL SELECT 'one_primary_tag', question_id::VARCHAR, count(*) FILTER (is_primary) FROM (SELECT question_id, is_primary OR topic_id = 13 AS is_primary FROM edges) GROUP BY question_id HAVING count(*) FILTER (is_primary) > 1
UNION ALL SELECT 'one_current_version', n_regionkey::VARCHAR, count(*) FILTER (n_nationkey % 4 = 0) FROM nation GROUP BY n_regionkey HAVING count(*) FILTER (n_nationkey % 4 = 0) > 1""")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    """Natural keys, and keys that must be unique among the rows that meet a condition."""

    def rule(name: str, rows: DataFrame, key: str, only=F.lit(True)) -> DataFrame:
        return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count_if(only).alias("n")).where("n > 1").select(F.lit(name).alias("rule"), "key", "n")

    tags = edges(spark, d).withColumn("is_primary", F.col("is_primary") | (F.col("topic_id") == 13))
    versions = rule("one_current_version", table(spark, d, "nation"), "n_regionkey", F.col("n_nationkey") % 4 == 0)
    return rule("natural_key", leaves(spark, d), "label").unionByName(rule("one_primary_tag", tags, "question_id", F.col("is_primary"))).unionByName(versions)


@query("""
SELECT 'option_on_structured' AS rule, question_id FROM bank WHERE kind <> 'ECONOMY' AND answer = 3
UNION ALL SELECT 'confidence_range', question_id FROM bank WHERE NOT (confidence / 100.0 BETWEEN 0 AND 0.95)
UNION ALL SELECT 'ordinal_range', question_id FROM bank WHERE ordinal NOT BETWEEN 1 AND 45
UNION ALL SELECT 'year_range', question_id FROM bank WHERE year NOT BETWEEN 2001 AND 2030
UNION ALL SELECT 'withdrawn_has_target', question_id FROM bank WHERE status = 'rejected' AND answer IS NOT NULL""")
def check_violations(spark: SparkSession, d: str) -> DataFrame:
    """All rules in one pass over the bank: a row for each rule that a question breaks."""
    c = F.col
    broken = problems(
        flagged((c("kind") != "ECONOMY") & (c("answer") == 3), "option_on_structured"),
        flagged(~(c("confidence") / 100).between(0, 0.95), "confidence_range"),
        flagged(~c("ordinal").between(1, 45), "ordinal_range"),
        flagged(~c("year").between(2001, 2030), "year_range"),
        flagged((c("status") == "rejected") & c("answer").isNotNull(), "withdrawn_has_target"),
    )
    return bank(spark, d).select(F.explode(broken).alias("rule"), "question_id")


@query("""
SELECT 'orders.customer' AS fk, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)
UNION ALL SELECT 'lineitem.order', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 0)
UNION ALL SELECT 'attempts.question', seq FROM attempts WHERE question_id NOT IN (SELECT question_id FROM bank WHERE question_id < 90)
UNION ALL SELECT 'labels.document', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 40 <> 0)""")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose parent is missing, by foreign key (some parents are taken away here, as the tables have no orphans)."""

    def fk(name: str, rows: DataFrame, key: str, parent: DataFrame, id_col: str) -> DataFrame:
        left = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"))
        return left.join(parent.toDF("key"), "key", "left_anti").select(F.lit(name).alias("fk"), "id")

    t = lambda n: table(spark, d, n)
    out = fk("orders.customer", t("orders"), "o_custkey", t("customer").where("c_custkey % 50 <> 0").select("c_custkey"), "o_orderkey")
    out = out.unionByName(fk("lineitem.order", t("lineitem"), "l_orderkey", t("orders").where("o_orderkey % 100 <> 0").select("o_orderkey"), "l_orderkey"))
    out = out.unionByName(fk("attempts.question", attempts(spark, d), "question_id", bank(spark, d).where("question_id < 90").select("question_id"), "seq"))
    return out.unionByName(fk("labels.document", t("labels"), "doc_id", t("documents").where("doc_id % 40 <> 0").select("doc_id"), "doc_id"))


@query("""
WITH parents AS (SELECT DISTINCT split_part(code, '.', 1) AS code FROM topics WHERE contains(code, '.'))
SELECT code, 'duplicate_code' AS problem FROM topics GROUP BY code HAVING count(*) > 1
UNION ALL SELECT code, 'children_and_objectives' FROM topics WHERE code IN (SELECT code FROM parents) AND n_objectives > 0
UNION ALL SELECT code, 'leaf_without_objectives' FROM topics WHERE code NOT IN (SELECT code FROM parents) AND n_objectives = 0
UNION ALL SELECT code, 'section_number' FROM (SELECT code, row_number() OVER (PARTITION BY subject_id ORDER BY code::INT) AS rn FROM topics WHERE NOT contains(code, '.')) WHERE code::INT <> rn""")
def topic_tree_problems(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate codes, nodes with both children and objectives, leaves with none, and a subject's sections that are not 1 to n."""
    t = topics(spark, d)
    parents = t.where(F.contains("code", F.lit("."))).select(F.split_part("code", F.lit("."), F.lit(1)).alias("code")).distinct()
    tell = lambda rows, name: rows.select("code", F.lit(name).alias("problem"))
    twice = t.groupBy("code").count().where("count > 1")
    sections = t.where(~F.contains("code", F.lit("."))).withColumn("rn", F.row_number().over(Window.partitionBy("subject_id").orderBy(F.col("code").cast("int")))).where("CAST(code AS INT) <> rn")
    out = tell(twice, "duplicate_code").unionByName(tell(t.join(parents, "code", "left_semi").where("n_objectives > 0"), "children_and_objectives"))
    return out.unionByName(tell(t.join(parents, "code", "left_anti").where("n_objectives = 0"), "leaf_without_objectives")).unionByName(tell(sections, "section_number"))


@query("""
SELECT DISTINCT label, 'duplicate_label' AS problem FROM (SELECT label FROM leaves GROUP BY label HAVING count(*) > 1)
UNION ALL SELECT label, 'empty_text' FROM (SELECT DISTINCT label FROM leaves WHERE n = 2 AND flag = 'N' AND marks < 5)""")
def item_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = leaves(spark, d)
    twice = rows.groupBy("label").count().where("count > 1").select("label", F.lit("duplicate_label").alias("problem"))
    return twice.unionByName(rows.where("n = 2 AND flag = 'N' AND marks < 5").select("label").distinct().select("label", F.lit("empty_text").alias("problem")))


@query(r"""
WITH pages AS (SELECT doc_id, page, string_agg(line, ' ' ORDER BY line_no) AS text, min(x1 - x0) AS width FROM spans GROUP BY doc_id, page)
SELECT doc_id, page, array_to_string(list_filter([CASE WHEN NOT list_contains(regexp_extract_all(text, '\d{1,2}'), (doc_id % 10)::VARCHAR) THEN 'number_not_on_page' END, CASE WHEN width <= 0 THEN 'degenerate_box' END], lambda x: x IS NOT NULL), ',') AS problems
FROM pages WHERE trim(text) <> ''""")
def cross_check(spark: SparkSession, d: str) -> DataFrame:
    """A page's extracted number and boxes against the page's own text; pages without text are passed over."""
    from quillstone.operators.common import joined

    pages = spans(spark, d).groupBy("doc_id", "page").agg(joined(["line_no"], F.col("line"), " ").alias("text"), F.min(F.col("x1") - F.col("x0")).alias("width")).where("trim(text) <> ''")
    found = F.regexp_extract_all("text", F.lit(r"\d{1,2}"), F.lit(0))
    return pages.select("doc_id", "page", F.array_join(problems(flagged(~F.array_contains(found, (F.col("doc_id") % 10).cast("string")), "number_not_on_page"), flagged(F.col("width") <= 0, "degenerate_box")), ",").alias("problems"))


@query("SELECT subject_id, count(*) FILTER (status = 'approved' AND confidence < 75) AS below_floor, count(*) FILTER (status = 'approved' AND confidence < 60) AS below_06, count(*) AS n FROM bank GROUP BY subject_id")
def tag_quality(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("status") == "approved"
    return bank(spark, d).groupBy("subject_id").agg(F.count_if(ok & (F.col("confidence") < 75)).alias("below_floor"), F.count_if(ok & (F.col("confidence") < 60)).alias("below_06"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOPIC_COUNTS} SELECT topic_id, code FROM topics WHERE n_objectives > 0 AND topic_id NOT IN (SELECT topic_id FROM topic_counts WHERE n > 50)")
def topic_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Revisable topics with too few approved canonical questions (here, at most fifty)."""
    return topics(spark, d).where("n_objectives > 0").join(_topic_counts(spark, d).where("n > 50"), "topic_id", "left_anti").select("topic_id", "code")


@query("""
SELECT 'blank_and_no_crop' AS rule, question_id FROM bank WHERE status = 'approved' AND length(body) < 9 AND question_id NOT IN (SELECT part FROM leaves WHERE part IS NOT NULL AND flag = 'A')
UNION ALL SELECT 'no_answer', question_id FROM bank WHERE status = 'approved' AND nullif(answer, 0) IS NULL
UNION ALL SELECT 'no_primary_topic', question_id FROM bank WHERE status = 'approved' AND question_id NOT IN (SELECT question_id FROM edges WHERE is_primary AND topic_id <> 9)
UNION ALL SELECT 'no_marks', question_id FROM bank WHERE status = 'approved' AND ordinal = 13""")
def approved_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Approved questions that could not be shown as they are."""
    ok = published(bank(spark, d))
    crops = leaves(spark, d).where("flag = 'A' AND part IS NOT NULL").select(F.col("part").alias("question_id"))
    tagged = edges(spark, d).where("is_primary AND topic_id <> 9").select("question_id")
    tell = lambda rows, rule: rows.select(F.lit(rule).alias("rule"), "question_id")
    out = tell(ok.where("length(body) < 9").join(crops, "question_id", "left_anti"), "blank_and_no_crop").unionByName(tell(ok.where("nullif(answer, 0) IS NULL"), "no_answer"))
    return out.unionByName(tell(ok.join(tagged, "question_id", "left_anti"), "no_primary_topic")).unionByName(tell(ok.where("ordinal = 13"), "no_marks"))


@query(f"""WITH {TOPIC_COUNTS}, listed AS (SELECT topic_id, count(*) AS shown FROM edges JOIN bank USING (question_id) WHERE status = 'approved' GROUP BY topic_id)
SELECT topic_id, n AS counted, shown FROM topic_counts JOIN listed USING (topic_id) WHERE n <> shown""")
def count_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Topics whose count is not what a listing (here, one that forgets to fold duplicates) returns."""
    listed = edges(spark, d).join(published(bank(spark, d)).select("question_id"), "question_id").groupBy("topic_id").agg(F.count(F.lit(1)).alias("shown"))
    return _topic_counts(spark, d).join(listed, "topic_id").where("n <> shown").select("topic_id", F.col("n").alias("counted"), "shown")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) <> n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END")
def length_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are not as long as was recorded (here, one longer for every thirteenth)."""
    recorded = F.col("n_chars") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)
    return docs(spark, d).where(F.length("text") != recorded).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("SELECT root FROM roots WHERE o_totalprice < 2000 OR nullif(paper % 50, 7) IS NULL")
def root_problems(spark: SparkSession, d: str) -> DataFrame:
    """Questions worth too little, or without a paper (here, of every fiftieth paper)."""
    return roots(spark, d).where("o_totalprice < 2000 OR nullif(paper % 50, 7) IS NULL").select("root")
