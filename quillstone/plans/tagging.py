"""Queries of topic tagging and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import tagging as G
from quillstone.operators.common import joined
from quillstone.plans.registry import query
from quillstone.plans.roles import bank, docs, edges, table, topics


@query("SELECT code, topic_id FROM topics WHERE n_objectives > 0")
def closed_topics(spark: SparkSession, d: str) -> DataFrame:
    return topics(spark, d).where("n_objectives > 0").select("code", "topic_id")


FIRST = """
first_pass AS (
  SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 9 ELSE quality END AS topic, 50 + doc_id % 50 AS confidence, CASE WHEN toxic = 0 AND doc_id % 3 = 0 THEN 'approved' WHEN doc_id % 5 = 0 THEN 'needs_review' ELSE 'extracted' END AS status,
    CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS answer FROM labels JOIN documents USING (doc_id))"""


def _first(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, d, "labels").join(docs(spark, d).select("doc_id", "n_chars"), "doc_id")
    status = F.when((F.col("toxic") == 0) & (k % 3 == 0), "approved").when(k % 5 == 0, "needs_review").otherwise("extracted")
    return rows.select("doc_id", F.when(k % 17 == 0, 9).otherwise(F.col("quality")).alias("topic"), (50 + k % 50).alias("confidence"), status.alias("status"), F.when(F.col("n_chars") >= 400, 1).otherwise(0).alias("answer"))


@query(f"WITH {FIRST} " + """
SELECT doc_id, topic, CASE WHEN topic IN (0, 1) THEN 'applied' ELSE 'unknown_code' END AS outcome, CASE WHEN topic NOT IN (0, 1) THEN status WHEN confidence < 75 AND status <> 'approved' THEN 'needs_review' ELSE status END AS new_status, topic IN (0, 1) AND confidence < 75 AS flagged
FROM first_pass""")
def apply_tags(spark: SparkSession, d: str) -> DataFrame:
    """First-pass decisions: a code outside the closed list is dropped and reported, a low confidence goes to review."""
    closed = spark.range(2).select(F.col("id").cast("int").alias("topic"), F.lit(True).alias("known"))
    rows = _first(spark, d).join(closed, "topic", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    low = F.col("known") & (F.col("confidence") < G.FLOOR)
    return rows.select("doc_id", "topic", F.when(F.col("known"), "applied").otherwise("unknown_code").alias("outcome"), F.when(low & (F.col("status") != "approved"), "needs_review").otherwise(F.col("status")).alias("new_status"), low.alias("flagged"))


@query(f"WITH {FIRST} SELECT doc_id, topic AS primary_code, CASE WHEN topic IN (0, 1) THEN confidence ELSE 0 END AS confidence, array_to_string(list_filter([answer, 1, 7], lambda s: s IN (0, 1) AND s <> topic), ',') AS secondary FROM first_pass")
def validate_tags(spark: SparkSession, d: str) -> DataFrame:
    closed = F.array(F.lit(0), F.lit(1))
    v = G.validated(F.col("topic"), F.col("confidence"), F.array("answer", F.lit(1), F.lit(7)), closed)
    return _first(spark, d).select("doc_id", v.alias("v")).select("doc_id", F.col("v.primary").alias("primary_code"), "v.confidence", F.array_join("v.secondary", ",").alias("secondary"))


SECOND = FIRST + """,
second AS (
  SELECT *, CASE WHEN topic = answer THEN 'agreed' ELSE 'disagreed' END AS outcome, CASE WHEN topic = answer THEN greatest(confidence, 90) ELSE least(confidence, 74) END AS new_confidence,
    CASE WHEN status = 'approved' THEN status WHEN topic = answer THEN CASE WHEN status = 'needs_review' THEN 'extracted' ELSE status END ELSE 'needs_review' END AS new_status, topic <> answer AND status <> 'approved' AS new_flag, CASE WHEN topic <> answer THEN answer END AS verifier_topic FROM first_pass)"""


@query(f"WITH {SECOND} SELECT doc_id, outcome, new_confidence, new_status, new_flag, verifier_topic FROM second")
def verify_mcq(spark: SparkSession, d: str) -> DataFrame:
    return G.second_opinion(_first(spark, d)).select("doc_id", "outcome", "new_confidence", "new_status", "new_flag", "verifier_topic")


@query(f"WITH {SECOND} SELECT topic, outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY topic), 4) AS share FROM second GROUP BY topic, outcome")
def verify_summary(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counts = G.second_opinion(_first(spark, d)).groupBy("topic", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("topic")), 4))


@query(f"WITH {SECOND} SELECT status AS subject, count(*) FILTER (confidence < 75) AS before, count(*) FILTER (new_confidence < 75) AS after_pass FROM second GROUP BY status")
def floor_movement(spark: SparkSession, d: str) -> DataFrame:
    rows = G.second_opinion(_first(spark, d))
    return rows.groupBy(F.col("status").alias("subject")).agg(F.count_if(F.col("confidence") < G.FLOOR).alias("before"), F.count_if(F.col("new_confidence") < G.FLOOR).alias("after_pass"))


@query("""
WITH lists AS (SELECT question_id, max(topic_id) FILTER (is_primary) AS p, coalesce(list(topic_id) FILTER (NOT is_primary), []) AS s FROM edges GROUP BY question_id),
model AS (SELECT question_id, answer + ordinal % 7 AS mp, [question_id % 10, ordinal % 10] AS ms FROM bank),
both_sides AS (SELECT *, CASE WHEN p = mp THEN 'agreed' WHEN list_contains(s, mp) OR list_contains(list_filter(ms, lambda x: x <> mp AND question_id % 2 = 0), p) THEN 'reordered' ELSE 'disagreed' END AS outcome FROM lists JOIN model USING (question_id) JOIN (SELECT question_id, confidence, status FROM bank) USING (question_id))
SELECT question_id, outcome, CASE outcome WHEN 'agreed' THEN greatest(confidence, 90) WHEN 'reordered' THEN confidence ELSE least(confidence, 74) END AS new_confidence,
  CASE WHEN status = 'approved' OR outcome = 'reordered' THEN status WHEN outcome = 'disagreed' THEN 'needs_review' WHEN status = 'needs_review' THEN 'extracted' ELSE status END AS new_status FROM both_sides""")
def verify_structured(spark: SparkSession, d: str) -> DataFrame:
    """Three outcomes: agreement never lowers confidence, a reordering writes nothing, a disagreement leaves approval."""
    lists = edges(spark, d).groupBy("question_id").agg(F.max(F.when(F.col("is_primary"), F.col("topic_id"))).alias("p"), F.collect_list(F.when(~F.col("is_primary"), F.col("topic_id"))).alias("s"))
    even = F.col("question_id") % 2 == 0
    model = bank(spark, d).select("question_id", "confidence", "status", (F.col("answer") + F.col("ordinal") % 7).cast("bigint").alias("mp"), F.array(F.col("question_id") % 10, (F.col("ordinal") % 10).cast("bigint")).alias("ms"))
    rows = lists.join(model, "question_id").withColumn("outcome", G.structured_outcome(F.col("p"), F.col("s"), F.col("mp"), F.filter("ms", lambda x: (x != F.col("mp")) & even)))
    o = F.col("outcome")
    confidence = F.when(o == "agreed", F.greatest("confidence", F.lit(G.AGREED))).when(o == "reordered", F.col("confidence")).otherwise(F.least("confidence", F.lit(G.FLOOR - 1)))
    status = F.when((F.col("status") == "approved") | (o == "reordered"), F.col("status")).when(o == "disagreed", "needs_review").when(F.col("status") == "needs_review", "extracted").otherwise(F.col("status"))
    return rows.select("question_id", "outcome", confidence.alias("new_confidence"), status.alias("new_status"))


@query("SELECT question_id, least(confidence, 74) AS confidence, length(body) AS n_chars FROM bank WHERE question_id NOT IN (SELECT question_id FROM edges WHERE topic_id < 5) AND body <> ''")
def tag_untagged(spark: SparkSession, d: str) -> DataFrame:
    """Only untagged rows with text are tagged; what a picture alone was read for stays below the floor."""
    tagged = edges(spark, d).where("topic_id < 5").select("question_id")
    rows = bank(spark, d).where("body <> ''").join(tagged, "question_id", "left_anti")
    return rows.select("question_id", F.least("confidence", F.lit(G.FLOOR - 1)).alias("confidence"), F.length("body").cast("bigint").alias("n_chars"))


@query("SELECT topic_id, string_agg(question_id, ',' ORDER BY question_id) AS questions FROM edges WHERE source = 'verifier' GROUP BY topic_id")
def verifier_tags(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("source = 'verifier'").groupBy("topic_id").agg(joined(["question_id"], F.col("question_id"), ",").alias("questions"))
