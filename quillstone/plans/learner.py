"""Queries of learner analytics, metering and the review ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import clock, duration
from quillstone.operators import learner as L
from quillstone.operators.common import latest_by
from quillstone.plans.registry import query
from quillstone.plans.roles import attempts, bank, edges, leaves, table, topics

CURRENT = """
current_a AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY seq DESC) AS rn FROM attempts) WHERE rn = 1),
mastery AS (
  SELECT user_id, topic_id, count(*) AS attempted, count(*) FILTER (is_correct) AS correct, round(avg(is_correct::INT), 4) AS accuracy,
    CAST(round_even(quantile_cont(time_ms, 0.5), 0) AS BIGINT) AS median_ms, max(created_at) AS last_attempt
  FROM current_a JOIN edges USING (question_id) WHERE is_correct IS NOT NULL GROUP BY user_id, topic_id),
weak AS (
  SELECT * FROM (SELECT user_id, topic_id, attempted, correct, accuracy, row_number() OVER (PARTITION BY user_id ORDER BY accuracy, topic_id) AS rank
    FROM mastery WHERE attempted >= 3 AND accuracy < 0.7) WHERE rank <= 5)
"""


@query("WITH " + CURRENT + "SELECT user_id, topic_id, attempted, correct, accuracy, median_ms, last_attempt FROM mastery")
def topic_mastery(spark: SparkSession, d: str) -> DataFrame:
    return L.topic_mastery(attempts(spark, d), edges(spark, d))


@query("WITH " + CURRENT + "SELECT user_id, question_id, seq, is_correct, time_ms FROM current_a")
def current_answers(spark: SparkSession, d: str) -> DataFrame:
    return L.current_answers(attempts(spark, d)).select("user_id", "question_id", "seq", "is_correct", "time_ms")


@query("WITH " + CURRENT + """
SELECT user_id, topic_id, count(*) AS attempted, count(*) FILTER (is_correct) AS correct, round(avg(is_correct::INT), 4) AS accuracy, quantile_cont(coalesce(time_ms, 0), 0.5) AS median_ms
FROM current_a JOIN (SELECT question_id FROM bank WHERE status = 'approved' AND subject_id = 1) USING (question_id) JOIN edges USING (question_id)
WHERE is_correct IS NOT NULL GROUP BY user_id, topic_id""")
def topic_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.topic_stats(attempts(spark, d), edges(spark, d), bank(spark, d), 1)


@query("WITH " + CURRENT + """
SELECT user_id, subject_id, count(*) AS attempted, count(*) FILTER (is_correct) AS correct FROM current_a JOIN bank USING (question_id) WHERE is_correct IS NOT NULL GROUP BY user_id, subject_id""")
def subject_tally(spark: SparkSession, d: str) -> DataFrame:
    answered = L.current_answers(attempts(spark, d)).where("is_correct IS NOT NULL")
    return answered.join(bank(spark, d).select("question_id", "subject_id"), "question_id").groupBy("user_id", "subject_id").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("is_correct").alias("correct"))


@query("WITH " + CURRENT + """
SELECT user_id, sum(attempted)::BIGINT AS attempted, round(sum(correct) / sum(attempted), 4) AS accuracy, count(*) AS covered, (SELECT count(*) FROM topics WHERE n_objectives > 0) AS all_topics,
  min(accuracy) AS worst, CASE WHEN sum(correct) / sum(attempted) >= 0.75 THEN 'good' WHEN sum(correct) / sum(attempted) >= 0.5 THEN 'fair' ELSE 'poor' END AS tone
FROM mastery GROUP BY user_id""")
def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    stats = L.topic_mastery(attempts(spark, d), edges(spark, d))
    every = topics(spark, d).where("n_objectives > 0").agg(F.count(F.lit(1)).alias("all_topics"))
    share = F.sum("correct") / F.sum("attempted")
    rows = stats.groupBy("user_id").agg(F.sum("attempted").alias("attempted"), F.round(share, 4).alias("accuracy"), F.count(F.lit(1)).alias("covered"), F.min("accuracy").alias("worst"), L.tone(share).alias("tone"))
    return rows.withColumn("all_topics", every.scalar())


@query("WITH " + CURRENT + "SELECT user_id, topic_id, attempted, accuracy, rank FROM weak")
def weak_topics(spark: SparkSession, d: str) -> DataFrame:
    return L.weak_topics(L.topic_mastery(attempts(spark, d), edges(spark, d))).select("user_id", "topic_id", "attempted", "accuracy", "rank")


@query("WITH " + CURRENT + """,
pool AS (SELECT DISTINCT user_id, question_id FROM weak JOIN edges USING (topic_id) JOIN bank USING (question_id) WHERE status = 'approved'),
ranked AS (
  SELECT p.user_id, p.question_id, CASE WHEN c.seq IS NULL THEN 1 WHEN NOT c.is_correct THEN 0 END AS rank
  FROM pool p LEFT JOIN current_a c ON p.user_id = c.user_id AND p.question_id = c.question_id)
SELECT * FROM (SELECT user_id, question_id, rank, row_number() OVER (PARTITION BY user_id ORDER BY rank, question_id) AS place FROM ranked WHERE rank IS NOT NULL) WHERE place <= 20""")
def revision_queue(spark: SparkSession, d: str) -> DataFrame:
    log, tags = attempts(spark, d), edges(spark, d)
    return L.revision_queue(L.weak_topics(L.topic_mastery(log, tags)), L.current_answers(log), tags, bank(spark, d))


@query("""
SELECT paper, count(*) AS questions, count(*) FILTER (seq IS NOT NULL AND chosen = answer) AS right_answers, round(100.0 * count(*) FILTER (seq IS NOT NULL AND chosen = answer) / count(*), 2) AS percent, coalesce(sum(time_ms), 0)::BIGINT AS total_ms
FROM (SELECT question_id, paper, answer FROM bank) LEFT JOIN (
  SELECT question_id, seq, time_ms, seq % 4 AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq DESC) AS rn FROM attempts) WHERE rn = 1) USING (question_id)
GROUP BY paper""")
def paper_score(spark: SparkSession, d: str) -> DataFrame:
    last = latest_by(attempts(spark, d), ["question_id"], F.desc("seq")).select("question_id", "seq", "time_ms", (F.col("seq") % 4).alias("chosen"))
    right = F.count_if(F.col("chosen") == F.col("answer"))
    return bank(spark, d).select("question_id", "paper", "answer").join(last, "question_id", "left").groupBy("paper").agg(
        F.count(F.lit(1)).alias("questions"), right.alias("right_answers"), F.round(100 * right / F.count(F.lit(1)), 2).alias("percent"), F.coalesce(F.sum("time_ms"), F.lit(0)).alias("total_ms")
    )


@query("""
SELECT root, sum(marks) FILTER (flag <> 'N')::BIGINT AS available, sum(marks // 2) FILTER (flag = 'A')::BIGINT AS awarded, count(*) FILTER (flag = 'R') AS unmarked,
  round(sum(marks // 2) FILTER (flag = 'A') / nullif(sum(marks) FILTER (flag = 'A'), 0), 4) AS score FROM leaves WHERE marks > 0 GROUP BY root""")
def self_marks(spark: SparkSession, d: str) -> DataFrame:
    marked = F.col("flag") == "A"
    awarded, out_of = F.sum(F.when(marked, F.floor(F.col("marks") / 2))), F.sum(F.when(marked, F.col("marks")))
    return leaves(spark, d).where("marks > 0").groupBy("root").agg(
        F.sum(F.when(F.col("flag") != "N", F.col("marks"))).alias("available"), awarded.alias("awarded"), F.count_if(F.col("flag") == "R").alias("unmarked"), F.round(awarded / F.nullif(out_of, F.lit(0)), 4).alias("score")
    )


@query("""
SELECT seq, CASE WHEN user_id % 10 = 0 THEN user_id + 1 ELSE user_id END AS user_id, question_id, user_id % 10 = 0 AS migrated FROM attempts
WHERE NOT (user_id % 10 = 0 AND seq IN (SELECT seq FROM attempts WHERE seq % 5 = 0))""")
def merge_logs(spark: SparkSession, d: str) -> DataFrame:
    """A device's log (users 0, 10, ...) joins its account (the next user); rows already migrated are not taken twice."""
    log = attempts(spark, d)
    device, account = log.where("user_id % 10 = 0"), log.where("user_id % 10 <> 0")
    done = log.where("seq % 5 = 0").select("seq")
    moved = device.join(done, "seq", "left_anti").select("seq", (F.col("user_id") + 1).alias("user_id"), "question_id", F.lit(True).alias("migrated"))
    return account.select("seq", "user_id", "question_id", F.lit(False).alias("migrated")).unionByName(moved)


@query("""
SELECT user_id, created_at::DATE AS day, count(*) AS asked, least(count(*), 3) AS used, greatest(count(*) - 3, 0) AS refused FROM attempts GROUP BY user_id, created_at::DATE""")
def quota_ledger(spark: SparkSession, d: str) -> DataFrame:
    ledger = L.quota_ledger(attempts(spark, d).withColumn("day", F.to_date("created_at")), 3)
    return ledger.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("asked"), F.count_if("admitted").alias("used"), F.count_if(~F.col("admitted")).alias("refused"))


@query("""
WITH RECURSIVE requests AS (
  SELECT user_id, created_at::DATE AS day, seq, 1 + question_id % 3 AS amount, row_number() OVER (PARTITION BY user_id, created_at::DATE ORDER BY seq) AS n FROM attempts),
scan AS (
  SELECT user_id, day, seq, amount, n, amount <= 5 AS admitted, CASE WHEN amount <= 5 THEN amount ELSE 0 END AS used FROM requests WHERE n = 1
  UNION ALL SELECT r.user_id, r.day, r.seq, r.amount, r.n, s.used + r.amount <= 5, s.used + CASE WHEN s.used + r.amount <= 5 THEN r.amount ELSE 0 END FROM scan s JOIN requests r ON r.user_id = s.user_id AND r.day = s.day AND r.n = s.n + 1)
SELECT user_id, day, seq, amount, admitted, used FROM scan""")
def quota_ledger_mixed(spark: SparkSession, d: str) -> DataFrame:
    requests = attempts(spark, d).select("user_id", F.to_date("created_at").alias("day"), "seq", (1 + F.col("question_id") % 3).alias("amount"))
    return L.quota_ledger_mixed(requests, 5)


@query("""
SELECT question_id, decision, seq, undone FROM (
  SELECT question_id, event_type AS decision, seq, event_type = 'error' AS undone, row_number() OVER (PARTITION BY question_id ORDER BY seq DESC) AS rn FROM attempts) WHERE rn = 1""")
def current_decisions(spark: SparkSession, d: str) -> DataFrame:
    return latest_by(attempts(spark, d), ["question_id"], F.desc("seq")).select("question_id", F.col("event_type").alias("decision"), "seq", (F.col("event_type") == "error").alias("undone"))


@query("""
SELECT o_orderkey AS submission, o_custkey AS user_id, o_orderdate AS submitted, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'""")
def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("submission"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("submitted"), F.row_number().over(w).alias("place"))


@query("""
SELECT user_id, seq AS event_id, (SELECT max(seq) FROM attempts WHERE seq % 2 = 0 AND user_id = a.user_id) AS last_seq,
  coalesce((SELECT max(seq) FROM attempts WHERE seq % 2 = 0 AND user_id = a.user_id), 0) + row_number() OVER (PARTITION BY user_id ORDER BY created_at, seq) AS new_seq
FROM attempts a WHERE seq % 2 = 1""")
def assign_seq(spark: SparkSession, d: str) -> DataFrame:
    log = attempts(spark, d)
    new = log.where("seq % 2 = 1").select("user_id", F.col("seq").alias("event_id"), "created_at")
    old = log.where("seq % 2 = 0")
    out = L.assigned_seq(new, old, "created_at", "event_id").select("user_id", "event_id", F.col("seq").alias("new_seq"))
    return out.join(old.groupBy("user_id").agg(F.max("seq").alias("last_seq")), "user_id", "left")


@query("""
SELECT seq, CASE WHEN time_ms // 1000 < 60 THEN (time_ms // 1000) || 's' ELSE (time_ms // 60000) || 'm ' || (time_ms // 1000 % 60) || 's' END AS spent,
  printf('%02d:%02d', time_ms // 60000, time_ms // 1000 % 60) AS clock FROM attempts WHERE time_ms >= 0""")
def format_duration(spark: SparkSession, d: str) -> DataFrame:
    return attempts(spark, d).where("time_ms >= 0").select("seq", duration(F.col("time_ms")).alias("spent"), clock(F.col("time_ms")).alias("clock"))


@query("SELECT seq, question_id, is_correct FROM attempts WHERE user_id = 8")
def owner_rows(spark: SparkSession, d: str) -> DataFrame:
    return attempts(spark, d).where("user_id = 8").select("seq", "question_id", "is_correct")


@query("""
WITH RECURSIVE items AS (SELECT doc_id, line_no AS place, (10 + length(line) // 4)::INT AS height FROM spans),
bins AS (
  SELECT doc_id, place, height, 0 AS bin, height AS total FROM items WHERE place = 0
  UNION ALL SELECT i.doc_id, i.place, i.height, CASE WHEN b.total + i.height > 900 THEN b.bin + 1 ELSE b.bin END, CASE WHEN b.total + i.height > 900 THEN i.height ELSE b.total + i.height END FROM bins b JOIN items i ON i.doc_id = b.doc_id AND i.place = b.place + 1)
SELECT doc_id, place, height, bin FROM bins""")
def pack_batches(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.plans.roles import spans

    return L.packed(spans(spark, d).select("doc_id", F.col("line_no").alias("place"), (10 + F.length("line") / 4).cast("int").alias("height")), 900)


@query("""
SELECT count(*)::BIGINT AS n FROM (SELECT seq, user_id, question_id FROM attempts WHERE seq % 10 <> 9 EXCEPT ALL SELECT seq, user_id, question_id FROM attempts)""")
def append_only_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an earlier snapshot of the log that the later one lacks or has changed: must be none."""
    log = attempts(spark, d).select("seq", "user_id", "question_id")
    return log.where("seq % 10 <> 9").exceptAll(log).agg(F.count(F.lit(1)).alias("n"))
