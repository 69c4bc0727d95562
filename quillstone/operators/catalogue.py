"""Read views of the question bank: one aggregate for each child table, then left joins on ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.common import joined, sorted_list


def published(questions: DataFrame) -> DataFrame:
    """The publication gate that every public view goes through."""
    return questions.where("status = 'approved'")


def canonical_ids(questions: DataFrame) -> DataFrame:
    """``question_id, canonical_id``: rows of equal body, kind and answer (null equals null); the greatest id stands for them.

    Only ids and a 256-bit hash of the key are shuffled, and a group's head comes from a partial aggregate.
    """
    keyed = questions.select("question_id", F.unhex(F.sha2(F.to_json(F.struct("body", "kind", "answer")), 256)).alias("key"))
    heads = keyed.groupBy("key").agg(F.max("question_id").alias("canonical_id"))
    return keyed.join(heads, "key").select("question_id", "canonical_id")


def topic_codes(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """Each question's topic codes, the primary one first, then by code."""
    rows = edges.join(topics.select("topic_id", "code"), "topic_id").withColumn("rank", F.when(F.col("is_primary"), 0).otherwise(1))
    return rows.groupBy("question_id").agg(joined(["rank", "code"], F.col("code"), ",").alias("topic_codes"))


def also_in(groups: DataFrame, questions: DataFrame) -> DataFrame:
    """Where the questions of each duplicate group appear: ``canonical_id, question_id, year, paper, others``.

    A question's other sittings are its group's rows but its own; they are given once for each group and not once for
    each member, which would be the square of a group's size. Questions without a duplicate have no row.
    """
    sizes = groups.groupBy("canonical_id").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return groups.join(sizes, "canonical_id").join(questions.select("question_id", "year", "paper"), "question_id")


def leaf_rows(roots: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows of the tree without children: parts, and roots that have none."""
    bare = roots.join(leaves.select("root").distinct(), "root", "left_anti")
    return leaves.select("root", F.col("label"), "n", "marks").unionByName(bare.select("root", F.col("root").cast("string").alias("label"), F.lit(0).alias("n"), F.lit(0).alias("marks")))


def first_asset(assets: DataFrame) -> DataFrame:
    """The first asset of each owner by sort order, then page, then key."""
    return assets.groupBy("owner").agg(F.min_by("asset", F.struct("sort_order", "page", "asset")).alias("asset"))


def empty_if_null(name: str, like: DataFrame) -> Column:
    """A nested list or map of a left join: empty where the join found nothing."""
    kind = like.schema[name].dataType.simpleString()
    return F.coalesce(F.col(name), F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind)).alias(name)


def crop_lists(assets: DataFrame, kind: str, name: str) -> DataFrame:
    """``owner`` and its assets of a kind as structs ``page_number, storage_key, aspect_ratio``, by sort order.

    Assets have ``owner, kind, sort_order, page_number, storage_key, x0, y0, x1, y1``; the order is total by page and key. A
    box without width has no ratio.
    """
    ratio = F.round((F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0)), 4)
    rows = assets.where(F.col("kind") == kind).withColumn("aspect_ratio", ratio)
    return rows.groupBy("owner").agg(sorted_list(["sort_order", "page_number", "storage_key"], "page_number", "storage_key", "aspect_ratio").alias(name))


def nested_parts(tree: DataFrame, assets: DataFrame) -> DataFrame:
    """``root`` and its leaves as structs ``display_label, max_marks, mark_scheme_text, review_flag, mark_scheme_crops``.

    The tree has ``id, parent, root, ordinal, max_marks, mark_scheme_text, review_flag``; leaves are rows with a parent that
    are no row's parent, in order of ordinal. Each leaf's own crops are a list inside it, empty and never null.
    """
    inner = tree.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
    leaf = tree.where("parent IS NOT NULL").join(inner, "id", "left_anti")
    crops = crop_lists(assets, "mark_scheme_crop", "mark_scheme_crops")
    rows = leaf.join(crops.withColumnRenamed("owner", "id"), "id", "left").withColumn("mark_scheme_crops", empty_if_null("mark_scheme_crops", crops)).withColumnRenamed("id", "display_label")
    return rows.groupBy("root").agg(sorted_list(["ordinal", "display_label"], "display_label", "max_marks", "mark_scheme_text", "review_flag", "mark_scheme_crops").alias("parts"))


def structured_view(tree: DataFrame, assets: DataFrame) -> DataFrame:
    """Top-level questions with their crops, their parts (each with its crops), and the crops of their own mark scheme."""
    parts = nested_parts(tree, assets)
    found = tree.where("parent IS NULL").select("id", "max_marks", "mark_scheme_text").join(parts.withColumnRenamed("root", "id"), "id", "left")
    lists = {"parts": parts}
    for kind, name in (("question_crop", "crops"), ("mark_scheme_crop", "mark_scheme_crops")):
        lists[name] = crop_lists(assets, kind, name)
        found = found.join(lists[name].withColumnRenamed("owner", "id"), "id", "left")
    return found.select("id", "max_marks", "mark_scheme_text", *(empty_if_null(name, lists[name]) for name in ("crops", "parts", "mark_scheme_crops")))


def option_maps(options: DataFrame) -> DataFrame:
    """``question_id`` and a map of option to content; of an option given twice the content that sorts first."""
    once = options.groupBy("question_id", "option").agg(F.min("content").alias("content"))
    return once.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("option", "content")))).alias("options"))


def mcq_view(questions: DataFrame, options: DataFrame, assets: DataFrame) -> DataFrame:
    """Questions with a key (``correct_option``): the options map, and key and ratio of the first crop by sort order and page."""
    made, crops = option_maps(options), crop_lists(assets, "question_crop", "crops").withColumnRenamed("owner", "question_id")
    rows = questions.where("correct_option IS NOT NULL").join(made, "question_id", "left").join(crops, "question_id", "left")
    first = F.get("crops", F.lit(0))
    return rows.select(*questions.columns, empty_if_null("options", made), first["storage_key"].alias("crop_storage_key"), first["aspect_ratio"].alias("crop_aspect_ratio"))


def proposed_topics(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """``question_id`` and its topics as structs ``code, title, confidence``, most certain first, then by code."""
    rows = edges.join(topics.select("topic_id", "code", "title"), "topic_id").withColumn("_least", -F.col("confidence"))
    return rows.groupBy("question_id").agg(sorted_list(["_least", "code"], "code", "title", "confidence").alias("proposed_topics"))


def review_view(tree: DataFrame, assets: DataFrame, proposed: DataFrame) -> DataFrame:
    """Questions that await a decision, with nested crops, parts and proposed topics.

    A flagged leaf flags the whole; ``flags`` are the leaves' distinct ones. ``primary_topic_confidence`` is that of the first
    proposed topic, null without any.
    """
    rows = structured_view(tree, assets).join(proposed.withColumnRenamed("question_id", "id"), "id", "left").withColumn("proposed_topics", empty_if_null("proposed_topics", proposed))
    flags = F.array_sort(F.array_distinct(F.filter(F.transform("parts", lambda p: p["review_flag"]), lambda f: f.isNotNull())))
    return rows.withColumn("flags", flags).withColumn("primary_topic_confidence", F.get("proposed_topics", F.lit(0))["confidence"])


def primary_topics(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """``question_id`` and its primary topic as a struct ``code, title, confidence, source``."""
    rows = edges.where("is_primary").join(topics.select("topic_id", "code", "title"), "topic_id")
    return rows.groupBy("question_id").agg(F.min(F.struct("code", "title", "confidence", "source")).alias("primary_topic"))


def in_subtree(label: Column, parent: Column) -> Column:
    """Whether a label lies under a parent: ``1`` has ``1(a)`` and not ``10(a)``."""
    return F.startswith(label, F.concat(parent, F.lit("(")))
