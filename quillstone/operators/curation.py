"""Text curation and duplicate folding over the question bank and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import normalise
from quillstone.operators.common import unambiguous
from quillstone.sources.files import stored

#: Normalised characters below which a text is never taken for a duplicate.
LEAST_CHARS = 60


def duplicate_key(norm: Column, answer: Column, row_id: Column) -> Column:
    """Equal texts with equal answers share a key; a short or missing text is alone. Hashed, so no text is shuffled."""
    alone = norm.isNull() | (F.length(norm) < LEAST_CHARS)
    return F.when(alone, F.concat(F.lit("solo:"), row_id.cast("string"))).otherwise(F.sha2(F.concat(norm, F.lit("\x00"), F.coalesce(answer.cast("string"), F.lit("\x01"))), 256))


def duplicates(rows: DataFrame, *, id_col: str, text_col: str, answer_col: str, newest: Sequence[str]) -> DataFrame:
    """``<id>, canonical_id`` of every row: groups of the same normalised text and answer, named by their newest row.

    Newest is the greatest by the columns of ``newest``, then by id. Only ids, those columns and a hash of the text are
    shuffled; a group's head is found by a partial aggregate, and members are rows, so a group may be of any size.
    """
    norm = rows.select(F.col(id_col), *(F.col(c) for c in dict.fromkeys([*newest, answer_col]) if c != id_col), normalise(F.col(text_col)).alias("_norm"))
    keyed = stored(norm.select(id_col, *(c for c in newest if c != id_col), duplicate_key(F.col("_norm"), F.col(answer_col), F.col(id_col)).alias("key")))
    heads = keyed.groupBy("key").agg(F.max_by(id_col, F.struct(*newest, id_col)).alias("canonical_id"))
    return keyed.select(id_col, "key").join(heads, "key").select(id_col, "canonical_id")


def pointers(rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """Every row's canonical id worked out anew: null for the canonical row itself and for rows without duplicates."""
    member = groups.where(F.col("canonical_id") != F.col(id_col))
    return rows.select(id_col).join(member, id_col, "left")


def matched(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries matched to questions by normalised label, or not at all: two claimants of a label both go.

    Input: ``doc, label, question_id`` and ``doc, label, entry_id``; result with ``outcome`` for the leftovers of both.
    """
    q, e = unambiguous(questions, ["doc", "label"]), unambiguous(entries, ["doc", "label"])
    both = q.join(e, ["doc", "label"])
    rest_q = questions.join(both.select("doc", "question_id"), ["doc", "question_id"], "left_anti").select("doc", "label", "question_id", F.lit(None).cast("bigint").alias("entry_id"))
    rest_e = entries.join(both.select("doc", "entry_id"), ["doc", "entry_id"], "left_anti").select("doc", "label", F.lit(None).cast("bigint").alias("question_id"), "entry_id")
    return both.select("doc", "label", "question_id", "entry_id").withColumn("outcome", F.lit("matched")).unionByName(rest_q.withColumn("outcome", F.lit("question_left"))).unionByName(rest_e.withColumn("outcome", F.lit("entry_left")))
