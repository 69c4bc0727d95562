"""The test tables in the roles of the library: attempts, question bank, tags, trees, lines and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Confidence below which a tag goes to review.
FLOOR = 0.75


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def attempts(spark: SparkSession, d: str) -> DataFrame:
    correct = F.when(F.col("event_type").isin("purchase", "signup"), True).when(F.col("event_type").isin("click", "view"), False)
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("question_id"),
        "event_type",
        correct.alias("is_correct"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("time_ms"),
        F.col("ts").alias("created_at"),
    )


def bank(spark: SparkSession, d: str) -> DataFrame:
    """One multiple-choice question for each part."""
    key = F.col("p_partkey")
    status = F.element_at(F.array(*map(F.lit, ("rejected", "needs_review", "extracted", "approved", "approved"))), F.col("p_size") % 5 + 1)
    return table(spark, d, "part").select(
        key.alias("question_id"),
        F.col("p_name").alias("body"),
        F.col("p_type").alias("kind"),
        (F.col("p_size") % 4).alias("answer"),
        F.col("p_brand").alias("paper"),
        (key % 4).alias("subject_id"),
        F.col("p_size").alias("ordinal"),
        status.alias("status"),
        (F.lit(50) + key % 50).cast("int").alias("confidence"),
        (F.lit(2000) + key % 25).cast("int").alias("year"),
        F.col("p_retailprice").alias("price"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """A primary tag for each question, and a secondary one for every third."""
    q = bank(spark, d).select("question_id", "confidence")
    first = q.select("question_id", (F.col("question_id") % 10).alias("topic_id"), "confidence", F.lit("model").alias("source"), F.lit(True).alias("is_primary"))
    second = q.where("question_id % 3 = 0").select("question_id", (10 + F.col("question_id") % 7).alias("topic_id"), F.lit(60).alias("confidence"), F.lit("verifier").alias("source"), F.lit(False).alias("is_primary"))
    return first.unionByName(second)


def topics(spark: SparkSession, d: str) -> DataFrame:
    """Coded topics with a parent level: code ``g.n`` under ``g``, some without objectives."""
    leaf = edges(spark, d).select("topic_id").distinct()
    group = (F.col("topic_id") / 4).cast("int")
    leaf = leaf.select("topic_id", F.concat_ws(".", group, F.col("topic_id") % 4).alias("code"), (F.col("topic_id") % 4).alias("subject_id"), (F.col("topic_id") % 5).cast("int").alias("n_objectives"))
    inner = leaf.select(F.split_part("code", F.lit("."), F.lit(1)).alias("code")).distinct().select((F.lit(100) + F.col("code").cast("bigint")).alias("topic_id"), "code", (F.col("code").cast("bigint") % 4).alias("subject_id"), F.lit(0).alias("n_objectives"))
    return leaf.unionByName(inner)


def roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("root"), F.col("o_custkey").alias("paper"), F.col("o_orderstatus").alias("state"), "o_totalprice", "o_orderdate", F.col("o_orderpriority").alias("priority"))


def leaves(spark: SparkSession, d: str) -> DataFrame:
    """Parts of questions: ``label`` is ``root(n)``; labels may repeat, so lists of them are ordered to the end."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("root"),
        F.col("l_linenumber").alias("n"),
        F.concat("l_orderkey", F.lit("("), "l_linenumber", F.lit(")")).alias("label"),
        F.col("l_quantity").cast("int").alias("marks"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").alias("price"),
    )


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Lines laid out on pages of twenty."""
    x0 = F.lit(50) + (F.length("line") % 3) * 20
    y0 = F.lit(45) + (F.col("line_no") % 20) * 12
    return lines(spark, d).select("doc_id", "line_no", "line", (F.col("line_no") / 20).cast("int").alias("page"), y0.alias("y0"), (y0 + 10).alias("y1"), x0.alias("x0"), (x0 + F.length("line")).alias("x1"))


ROLES_SQL = """
attempts AS (
  SELECT event_id AS seq, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_id, event_type,
    CASE WHEN event_type IN ('purchase', 'signup') THEN true WHEN event_type IN ('click', 'view') THEN false END AS is_correct,
    CAST(floor(value * 1000) AS BIGINT) AS time_ms, ts AS created_at FROM events),
bank AS (
  SELECT p_partkey AS question_id, p_name AS body, p_type AS kind, p_size % 4 AS answer, p_brand AS paper, p_partkey % 4 AS subject_id, p_size AS ordinal,
    CASE p_size % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'extracted' ELSE 'approved' END AS status,
    (50 + p_partkey % 50)::INT AS confidence, (2000 + p_partkey % 25)::INT AS year, p_retailprice AS price FROM part),
edges AS (
  SELECT question_id, question_id % 10 AS topic_id, confidence, 'model' AS source, true AS is_primary FROM bank
  UNION ALL SELECT question_id, 10 + question_id % 7, 60, 'verifier', false FROM bank WHERE question_id % 3 = 0),
leaf_topics AS (
  SELECT topic_id, (topic_id // 4) || '.' || (topic_id % 4) AS code, topic_id % 4 AS subject_id, (topic_id % 5)::INT AS n_objectives FROM (SELECT DISTINCT topic_id FROM edges)),
topics AS (
  SELECT * FROM leaf_topics
  UNION ALL SELECT DISTINCT 100 + topic_id // 4, (topic_id // 4)::VARCHAR, (topic_id // 4) % 4, 0 FROM leaf_topics),
roots AS (SELECT o_orderkey AS root, o_custkey AS paper, o_orderstatus AS state, o_totalprice, o_orderdate, o_orderpriority AS priority FROM orders),
leaves AS (
  SELECT l_orderkey AS root, l_linenumber AS n, l_orderkey || '(' || l_linenumber || ')' AS label, CAST(l_quantity AS INT) AS marks, l_returnflag AS flag,
    l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price FROM lineitem),
doc_lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(range(len(parts)))::INT AS line_no, unnest(parts) AS line FROM doc_lines),
spans AS (
  SELECT doc_id, line_no, line, line_no // 20 AS page, 45 + 12 * (line_no % 20) AS y0, 55 + 12 * (line_no % 20) AS y1,
    50 + (length(line) % 3) * 20 AS x0, 50 + (length(line) % 3) * 20 + length(line) AS x1 FROM lines)
"""
