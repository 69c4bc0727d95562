"""Topic tags from model answers: validation against a closed list, first pass, and second opinions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidences in hundredths: the review floor, what agreement lifts to, and a verifier's own tag.
FLOOR, AGREED, VERIFIER = 75, 90, 60


def validated(primary: Column, confidence: Column, secondary: Column, closed: Column) -> Column:
    """An answer with an unknown primary at confidence 0, and no unknown secondaries nor the primary among them."""
    known = F.array_contains(closed, primary)
    return F.struct(primary.alias("primary"), F.when(known, confidence).otherwise(F.lit(0)).alias("confidence"), F.filter(secondary, lambda s: F.array_contains(closed, s) & (s != primary)).alias("secondary"))


def second_opinion(rows: DataFrame) -> DataFrame:
    """Outcome and new state of multiple-choice rows: ``topic, confidence, status, flagged, answer``.

    Agreement lifts confidence to at least 0.9 and takes the flag off; a disagreement caps it just below the floor and
    flags the row. Only undecided rows change status.
    """
    agreed, approved = F.col("topic") == F.col("answer"), F.col("status") == "approved"
    confidence = F.when(agreed, F.greatest("confidence", F.lit(AGREED))).otherwise(F.least("confidence", F.lit(FLOOR - 1)))
    status = F.when(approved, F.col("status")).when(agreed, F.when(F.col("status") == "needs_review", "extracted").otherwise(F.col("status"))).otherwise("needs_review")
    return rows.select("*", F.when(agreed, "agreed").otherwise("disagreed").alias("outcome"), confidence.alias("new_confidence"), status.alias("new_status"), (~agreed & ~approved).alias("new_flag"), F.when(~agreed, F.col("answer")).alias("verifier_topic"))


def structured_outcome(primary: Column, secondary: Column, model_primary: Column, model_secondary: Column) -> Column:
    """Agreed on the same primary; reordered if either primary is in the other's list; else disagreed."""
    return F.when(primary == model_primary, "agreed").when(F.array_contains(secondary, model_primary) | F.array_contains(model_secondary, primary), "reordered").otherwise("disagreed")
