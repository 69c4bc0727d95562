"""Queries that run the streams over the log's file to its end; their SQL is that of their batch twins.

Times are given without a zone, as the log has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.learner import CURRENT
from quillstone.plans.registry import query
from quillstone.plans.roles import edges
from quillstone.streaming import attempts as S


def _time(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("WITH " + CURRENT + "SELECT user_id, question_id, seq, is_correct, time_ms FROM current_a")
def stream_current_answers(spark: SparkSession, d: str) -> DataFrame:
    return S.stream_current_answers(S.read_attempts(spark, d)).select("user_id", "question_id", "seq", "is_correct", "time_ms")


@query("WITH " + CURRENT + "SELECT user_id, topic_id, attempted, correct, accuracy, median_ms, last_attempt FROM mastery")
def stream_topic_mastery(spark: SparkSession, d: str) -> DataFrame:
    return S.stream_topic_mastery(S.read_attempts(spark, d), edges(spark, d)).withColumn("last_attempt", _time("last_attempt"))


@query("""
SELECT user_id, created_at::DATE AS day, count(*) AS used FROM attempts WHERE created_at::DATE + INTERVAL 2 DAY <= (SELECT max(created_at) FROM attempts) GROUP BY user_id, created_at::DATE""")
def stream_daily_usage(spark: SparkSession, d: str) -> DataFrame:
    """Days that the watermark, a day behind the latest event, has passed."""
    return S.stream_daily_usage(S.read_attempts(spark, d))


@query("SELECT seq, user_id, question_id, is_correct, time_ms, created_at FROM attempts")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The log sent twice; each submission is taken in once."""
    sent = S.read_attempts(spark, d)
    return S.stream_dedupe(sent.union(S.read_attempts(spark, d))).withColumn("created_at", _time("created_at"))


@query("""
WITH gaps AS (SELECT user_id, created_at, coalesce(created_at - lag(created_at) OVER w >= INTERVAL 30 MINUTE, true)::INT AS opens FROM attempts WINDOW w AS (PARTITION BY user_id ORDER BY created_at)),
sat AS (SELECT user_id, created_at, sum(opens) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS sitting FROM gaps),
sittings AS (SELECT user_id, min(created_at) AS "begin", max(created_at) + INTERVAL 30 MINUTE AS "end", count(*) AS attempts FROM sat GROUP BY user_id, sitting)
SELECT * FROM sittings WHERE "end" + INTERVAL 1 DAY <= (SELECT max(created_at) FROM attempts)""")
def stream_sittings(spark: SparkSession, d: str) -> DataFrame:
    """Sittings that the watermark, a day behind the latest event, has passed."""
    return S.stream_sittings(S.read_attempts(spark, d)).select("user_id", _time("begin"), _time("end"), "attempts")
