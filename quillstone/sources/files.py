"""File manifests, JSON-line answers that can be replayed, and snapshot and report sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWERS = "question_id bigint, topic_id bigint, confidence double"


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a local session without it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or None
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='quillstone-')).rstrip('/')}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, so that what several branches read is worked out once."""
    path = work_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, byte size and SHA-256 of each file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("checksum"))


def changed_documents(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files that are new, gone, or whose content was replaced under the same name."""
    both = before.select("file", F.col("checksum").alias("old")).join(now, "file", "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("checksum").isNull(), "gone").when(F.col("old") != F.col("checksum"), "replaced").otherwise("same")
    return both.select("file", "byte_size", "checksum", state.alias("state"))


def replayed(spark: SparkSession, answers: DataFrame, tags: DataFrame) -> DataFrame:
    """Save the answers as JSON lines, read them back by schema, and compare with the current primary tags.

    A pure function of answers and tags, so that a second replay says the same.
    """
    path = work_folder(spark)
    answers.write.json(path)
    back = spark.read.schema(ANSWERS).json(path)
    both = back.join(tags.select("question_id", F.col("topic_id").alias("current")), "question_id", "left")
    outcome = F.when(F.col("current").isNull(), "unknown").when(F.col("current") == F.col("topic_id"), "agreed").otherwise("disagreed")
    return both.select("question_id", "topic_id", "current", outcome.alias("outcome"))


def decisions_map(spark: SparkSession, path: str) -> DataFrame:
    """``position, code``, and what the path's folders name, of files that are each one JSON object of position to code.

    A file that is no such object has null for both.

    A value that is no text counts as malformed too: its code is null.
    """
    files = spark.read.option("wholetext", "true").text(path)
    return files.select(*(c for c in files.columns if c != "value"), F.explode_outer(F.from_json("value", "map<string,string>")).alias("position", "code"))


def applied_decisions(sheet: DataFrame, decisions: DataFrame, closed: DataFrame) -> DataFrame:
    """What a pass over a worksheet does: ``sheet, position, question_id, code, outcome``.

    The sheet has ``sheet, position, question_id`` (several rows of a group may share a position), decisions
    ``sheet, position, code``, the closed list ``code``. Rows are ``applied``, ``unknown_code`` (outside the list),
    ``malformed`` (no code) or ``skipped`` (no decision); a decision on a position that is not on its sheet is
    ``unknown_position``, a sheet that could not be read at all ``malformed`` without one.
    """
    known = closed.select("code").distinct().withColumn("known", F.lit(True))
    told = decisions.withColumn("told", F.lit(True)).join(known, "code", "left")
    both = sheet.withColumn("listed", F.lit(True)).join(told, ["sheet", "position"], "full_outer")
    outcome = F.when(F.col("told").isNull(), "skipped").when(F.col("position").isNull() | (F.col("code").isNull() & F.col("listed").isNotNull()), "malformed").when(F.col("listed").isNull(), "unknown_position").when(F.col("known").isNull(), "unknown_code").otherwise("applied")
    return both.select("sheet", "position", "question_id", "code", outcome.alias("outcome"))


#: In which order a reader gets each view's rows.
VIEW_ORDERS = {"v_subjects": ("level", "subject"), "v_topics": ("topic_id", "code"), "v_papers": ("-year", "paper"), "v_mcq": ("paper", "ordinal", "question_id")}


def write_report(rows: DataFrame, path: str, *order: str) -> None:
    """A report as CSV files with a header, sorted over all of them by the named columns; ``-`` before a name turns it."""
    by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    rows.orderBy(*by).write.mode("overwrite").option("header", True).csv(path)


def write_view(rows: DataFrame, path: str, view: str) -> None:
    """A view's rows in its reader's order."""
    write_report(rows, path, *VIEW_ORDERS[view])


def swap_snapshot(rows: DataFrame, path: str) -> DataFrame:
    """Write a snapshot beside the others and return it; readers of earlier ones are not disturbed."""
    target = f"{path.rstrip('/')}/snapshot={uuid.uuid4().hex}"
    rows.write.parquet(target)
    return rows.sparkSession.read.schema(rows.schema).parquet(target)
