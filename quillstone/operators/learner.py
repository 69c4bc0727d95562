"""Learner analytics over an append-only attempt log: ``seq, user_id, question_id, is_correct, time_ms, created_at``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.common import latest_by, numbered

WEAK_ATTEMPTS, WEAK_ACCURACY, WEAK_TOPICS, QUEUE = 3, 0.7, 5, 20


def current_answers(attempts: DataFrame) -> DataFrame:
    """The attempt of greatest ``seq`` of each user and question; time stamps don't count."""
    return latest_by(attempts, ["user_id", "question_id"], F.desc("seq"))


def topic_mastery(attempts: DataFrame, edges: DataFrame) -> DataFrame:
    """Per user and topic: attempted, correct, accuracy, median time (half to even), last attempt.

    Self-marked answers (null correctness) stay out; all tags count; null times are ignored by the median.
    """
    answered = current_answers(attempts).where("is_correct IS NOT NULL")
    return (
        answered.join(edges.select("question_id", "topic_id"), "question_id")
        .groupBy("user_id", "topic_id")
        .agg(
            F.count(F.lit(1)).alias("attempted"),
            F.count_if("is_correct").alias("correct"),
            F.round(F.avg(F.col("is_correct").cast("int")), 4).alias("accuracy"),
            F.rint(F.percentile("time_ms", 0.5)).cast("bigint").alias("median_ms"),
            F.max("created_at").alias("last_attempt"),
        )
    )


def topic_stats(attempts: DataFrame, edges: DataFrame, questions: DataFrame, subject_id: int) -> DataFrame:
    """Like mastery, but within one subject's approved questions, with null times as 0 and the raw median."""
    listed = questions.where((F.col("status") == "approved") & (F.col("subject_id") == subject_id)).select("question_id")
    answered = current_answers(attempts).where("is_correct IS NOT NULL").join(listed, "question_id", "left_semi")
    return answered.join(edges.select("question_id", "topic_id"), "question_id").groupBy("user_id", "topic_id").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if("is_correct").alias("correct"), F.round(F.avg(F.col("is_correct").cast("int")), 4).alias("accuracy"), F.percentile(F.coalesce("time_ms", F.lit(0)), 0.5).alias("median_ms")
    )


def tone(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.75, "good").when(accuracy >= 0.5, "fair").otherwise("poor")


def weak_topics(stats: DataFrame) -> DataFrame:
    """Each user's five weakest topics of at least three attempts and an accuracy below 0.7."""
    weak = stats.where((F.col("attempted") >= WEAK_ATTEMPTS) & (F.col("accuracy") < WEAK_ACCURACY))
    w = Window.partitionBy("user_id").orderBy("accuracy", "topic_id")
    return weak.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= WEAK_TOPICS)


def revision_queue(weak: DataFrame, answers: DataFrame, edges: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions of a user's weak topics: those last answered wrong, then those never tried, by id; at most twenty.

    Topics are never joined with all their questions for each user. Wrong answers come from the log. Of a topic's
    numbered questions a user needs the first twenty and as many more as they have tried of it, which are looked up by
    number.
    """
    listed = edges.select("topic_id", "question_id").distinct().join(questions.where("status = 'approved'").select("question_id"), "question_id", "left_semi")
    ranked = numbered(listed, "topic_id", "question_id", "number")
    asked = weak.select("user_id", "topic_id")
    tried = answers.select("user_id", "question_id", "is_correct").join(listed, "question_id").join(asked, ["user_id", "topic_id"])
    wrong = tried.where("NOT is_correct").select("user_id", "question_id").distinct()
    counts = tried.groupBy("user_id", "topic_id").agg(F.count(F.lit(1)).alias("n"))
    reach = asked.join(counts, ["user_id", "topic_id"], "left").select("user_id", "topic_id", F.explode(F.sequence(F.lit(1), (QUEUE + F.coalesce("n", F.lit(0))).cast("int"))).alias("number"))
    found = reach.join(ranked, ["topic_id", "number"]).select("user_id", "question_id").distinct()
    new = found.join(answers.select("user_id", "question_id"), ["user_id", "question_id"], "left_anti")
    rows = wrong.withColumn("rank", F.lit(0)).unionByName(new.withColumn("rank", F.lit(1)))
    w = Window.partitionBy("user_id").orderBy("rank", "question_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= QUEUE).select("user_id", "question_id", "rank", "place")


def assigned_seq(new: DataFrame, log: DataFrame, *order: str) -> DataFrame:
    """New rows of each user numbered on from the user's last ``seq`` in the log, in a total order of their own."""
    last = log.groupBy("user_id").agg(F.max("seq").alias("last"))
    w = Window.partitionBy("user_id").orderBy(*order)
    return new.join(last, "user_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.row_number().over(w)).drop("last")


def quota_ledger(requests: DataFrame, limit: int) -> DataFrame:
    """Requests of one unit each by user and day: admitted while the count stays within the limit, in ``seq`` order."""
    w = Window.partitionBy("user_id", "day").orderBy("seq")
    return requests.withColumn("n", F.row_number().over(w)).withColumn("admitted", F.col("n") <= limit)


def quota_ledger_mixed(requests: DataFrame, limit: int) -> DataFrame:
    """As above with amounts: a refused request leaves the counter as it was, so each user's day is one ordered scan.

    A task scans all its users' days in one pass, batch by batch, and begins anew where the number is 1. A request without
    an amount is neither admitted nor refused.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = 0
        for batch in batches:
            admitted, counter = [], []
            for n, amount in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True):
                used = 0 if n == 1 else used
                ok = None if amount is None else used + amount <= limit
                used += amount if ok else 0
                admitted.append(ok)
                counter.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(admitted, pa.bool_()), pa.array(counter, pa.int64())], names=["user_id", "day", "seq", "amount", "admitted", "used"])

    rows = requests.select("user_id", "day", "seq", F.col("amount").cast("bigint").alias("amount")).repartition("user_id", "day").sortWithinPartitions("user_id", "day", "seq")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("seq")))
    return rows.mapInArrow(scan, "user_id bigint, day date, seq bigint, amount bigint, admitted boolean, used bigint")


def refunded(used: Column, amount: Column) -> Column:
    return F.greatest(F.lit(0), used - amount)


def packed(items: DataFrame, limit: int) -> DataFrame:
    """Greedy bins of a document's items in order: a bin closes when the next item would overfill it.

    An item beyond the limit has a bin of its own. Input: ``doc_id, place, height``.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, bin_no, height = None, 0, 0
        for rows in batches:
            bins = []
            for d, h in zip(rows["doc_id"], rows["height"], strict=True):
                if d != doc:
                    doc, bin_no, height = d, 0, 0
                elif height + h > limit:
                    bin_no, height = bin_no + 1, 0
                height += h
                bins.append(bin_no)
            yield rows.assign(bin=bins)

    ordered = items.select("doc_id", "place", "height").repartition("doc_id").sortWithinPartitions("doc_id", "place")
    return ordered.mapInPandas(pack, "doc_id bigint, place int, height int, bin int")
