"""Keyed merges of snapshots and guarded state transitions: human decisions survive a re-run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.common import merged, newer

DECIDED = ("approved", "rejected")
UNMATCHED = "unmatched_mark_scheme"


def merge_questions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by ``key``: ``text, scheme, status, flags``.

    Text is replaced; a scheme is kept where the new read has none. A decided row keeps its status and flags. Else the
    flags are the old ones without the unmatched-scheme flag, with the new ones, and without that flag again where the
    row already had a scheme; the row needs review as long as a flag is left.
    """
    none = F.array().cast("array<string>")
    o_flags, n_flags = F.coalesce("o_flags", none), F.coalesce("n_flags", none)
    had_scheme = F.coalesce(F.col("o_scheme") != "", F.lit(False))
    joint = F.array_distinct(F.array_union(F.array_remove(o_flags, UNMATCHED), n_flags))
    joint = F.when(had_scheme, F.array_remove(joint, UNMATCHED)).otherwise(joint)
    keeps = ~F.col("in_new") | F.coalesce(F.col("o_status").isin(*DECIDED), F.lit(False))
    flags = F.array_sort(F.when(keeps, o_flags).otherwise(joint))
    status = F.when(keeps, F.col("o_status")).when(F.size(joint) > 0, "needs_review").otherwise("extracted")
    rules = {"text": newer("text"), "scheme": F.coalesce("n_scheme", "o_scheme"), "status": status, "flags": flags}
    return merged(old, new, ["key"], rules)


def cascade(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """A decision on a root applies to its whole subtree, but only to rows that nobody has decided yet."""
    both = rows.join(decisions.select("root", "decision"), "root", "left")
    open_ = F.col("status").isin("extracted", "needs_review")
    moved = F.col("decision").isNotNull() & open_
    return both.select(*rows.columns, F.when(moved, F.col("decision")).otherwise(F.col("status")).alias("new_status"), moved.alias("moved"), (F.col("decision").isNotNull() & ~open_).alias("conflict"))


def undone(flags: Column) -> Column:
    return F.when(F.size(flags) > 0, "needs_review").otherwise("extracted")


def retagged(tags: DataFrame, chosen: DataFrame) -> DataFrame:
    """A person's choice replaces the primary tag of its questions, with full confidence."""
    old = tags.where("is_primary").join(chosen.select("question_id"), "question_id", "left_semi")
    kept = tags.join(old.select("question_id", F.lit(True).alias("is_primary")), ["question_id", "is_primary"], "left_anti").select(*tags.columns)
    new = chosen.select("question_id", "topic_id", F.lit(100).alias("confidence"), F.lit("human").alias("source"), F.lit(True).alias("is_primary"))
    # A secondary tag of the chosen topic would repeat it.
    return kept.join(new.select("question_id", "topic_id"), ["question_id", "topic_id"], "left_anti").select(*tags.columns).unionByName(new)


def defaults_inserted(rows: DataFrame, known: DataFrame, key: str, **values: Column) -> DataFrame:
    """A row of defaults for each key that has none."""
    new = known.select(key).distinct().join(rows, key, "left_anti")
    return rows.unionByName(new.select(key, *(v.alias(c) for c, v in values.items())))
