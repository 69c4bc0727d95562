"""The attempt log as a stream: current answers, mastery, a daily meter, intake without repeats, sittings."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators.common import latest_by
from quillstone.operators.learner import topic_mastery
from quillstone.sources.files import work_folder

#: A base is written anew once the batches since hold as many bytes as it does, and at least so many; bytes of a base's
#: part; a number above all batches'.
LEAST_BYTES, PART_BYTES, ALL = 64 << 20, 128 << 20, 1 << 62
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_attempts(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The log's files as a stream, with event time as a timestamp in the session's zone."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    correct = F.when(F.col("event_type").isin("purchase", "signup"), True).when(F.col("event_type").isin("click", "view"), False)
    return raw.select(F.col("event_id").alias("seq"), "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("question_id"), correct.alias("is_correct"), F.floor(F.col("value") * 1000).cast("bigint").alias("time_ms"), F.col("ts").cast("timestamp").alias("created_at"))


def run_to_end(writer, folder: str) -> StreamingQuery:
    q = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


class Snapshot:
    """A keyed table that grows by batches: each writes its own rows and no others, and readers take every key's newest.

    ``v=<n>`` has the rows of batch n, ``base=<n>-<parts>`` those of all batches before n, in so many parts by a hash of the
    user. A base is written anew once the batches since have grown as large as it is, into parts of a bounded size, so a
    row is rewritten a logarithmic number of times however long the stream runs. A repeated batch overwrites what it wrote
    and reads what was there before it: a base never holds the batch that wrote it, and only what no repeated batch can
    ask for is deleted. ``newest`` picks the rows that count among those of several batches, numbered by ``_v``.
    """

    def __init__(self, folder: str, newest: Callable[[DataFrame], DataFrame], *, least_bytes: int = LEAST_BYTES, part_bytes: int = PART_BYTES):
        self.folder, self.newest, self.least_bytes, self.part_bytes = folder, newest, least_bytes, part_bytes

    @staticmethod
    def part(parts: int, user: str = "user_id") -> Column:
        return F.pmod(F.xxhash64(user), F.lit(parts)).cast("int")

    def written(self) -> tuple[dict[int, int], dict[tuple[int, int], int], dict[int, set[int]]]:
        """Bytes of each complete batch and of each complete base (by number and parts), and the parts that a base's number has."""
        files, at = pyarrow.fs.FileSystem.from_uri(self.folder)
        sizes: dict[str, int] = {}
        done, parts = set(), {}
        for f in files.get_file_info(pyarrow.fs.FileSelector(at, recursive=True, allow_not_found=True)):
            top, *rest = f.path.removeprefix(at.rstrip("/")).strip("/").split("/")
            if f.type == pyarrow.fs.FileType.File and rest:
                sizes[top] = sizes.get(top, 0) + f.size
                if rest == ["_SUCCESS"]:
                    done.add(top)
                if m := re.fullmatch(r"part=(\d+)", rest[0]):
                    parts.setdefault(top, set()).add(int(m[1]))
        batches = {int(m[1]): sizes[t] for t in done if (m := re.fullmatch(r"v=(\d+)", t))}
        bases = {(int(m[1]), int(m[2])): sizes[t] for t in done if (m := re.fullmatch(r"base=(\d+)-(\d+)", t))}
        return batches, bases, {n: parts.get(f"base={n}-{k}", set()) for n, k in bases}

    def _rows(self, spark: SparkSession, before: int, users: DataFrame | None = None) -> DataFrame | None:
        batches, bases, held = self.written()
        number, parts = max((b for b in bases if b[0] <= before), default=(0, 0))
        later = [f"{self.folder}/v={v}" for v in sorted(batches) if number <= v < before]
        found = spark.read.parquet(*later) if later else None
        if parts:
            chosen = held[number]
            if users is not None:  # at most as many numbers as the base has parts
                chosen = chosen & {r[0] for r in users.select(self.part(parts)).distinct().collect()}
            if chosen:
                base = spark.read.parquet(*(f"{self.folder}/base={number}-{parts}/part={p}" for p in sorted(chosen)))
                found = base if found is None else found.unionByName(base)
        if found is not None and users is not None:
            asked = users.select(F.col("user_id").alias("asked")).distinct()
            found = found.join(asked, F.col("user_id").eqNullSafe(F.col("asked")), "left_semi")
        return None if found is None else self.newest(found)

    def read(self, spark: SparkSession, before: int, users: DataFrame | None = None) -> DataFrame | None:
        """The rows as they were before a batch, of some users or of all; None if there are none yet."""
        rows = self._rows(spark, before, users)
        return None if rows is None else rows.drop("_v")

    def write(self, rows: DataFrame, number: int) -> None:
        rows.withColumn("_v", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{self.folder}/v={number}")
        batches, bases, _ = self.written()
        base = max((b for b in bases if b[0] <= number), default=(0, 0))
        grown, held = sum(n for v, n in batches.items() if base[0] <= v < number), bases.get(base, 0)
        if grown <= max(self.least_bytes, held):
            return
        parts = max(1, -(-(grown + held) // self.part_bytes))
        whole = self._rows(rows.sparkSession, number).withColumn("part", self.part(parts))
        whole.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/base={number}-{parts}")
        files, at = pyarrow.fs.FileSystem.from_uri(self.folder)
        for name in [*(f"v={v}" for v in batches if v < number), *(f"base={n}-{k}" for n, k in bases if n < number)]:
            files.delete_dir(f"{at}/{name}")


def latest_answers(rows: DataFrame) -> DataFrame:
    """Of a user's answers to a question the one of the greatest ``seq``, whichever batch it came with."""
    return latest_by(rows, ["user_id", "question_id"], F.desc("seq"), F.desc("_v"))


def latest_of_user(rows: DataFrame) -> DataFrame:
    """All rows of a user's newest batch: what it has no more is gone."""
    newest = F.max("_v").over(Window.partitionBy("user_id"))
    return rows.withColumn("_newest", newest).where("_v = _newest").drop("_newest")


def _merge_answers(state: Snapshot, batch: DataFrame, number: int) -> None:
    state.write(latest_by(batch, ["user_id", "question_id"], F.desc("seq")), number)


def stream_current_answers(attempts: DataFrame) -> DataFrame:
    """Latest answers by ``seq``: a batch adds its own, and a late smaller ``seq`` never wins when they are read."""
    spark, folder = attempts.sparkSession, work_folder(attempts.sparkSession)
    state = Snapshot(f"{folder}/answers", latest_answers)
    run_to_end(attempts.writeStream.foreachBatch(lambda batch, number: _merge_answers(state, batch, number)), folder)
    found = state.read(spark, ALL)
    return found if found is not None else spark.createDataFrame([], attempts.schema)


def stream_topic_mastery(attempts: DataFrame, edges: DataFrame) -> DataFrame:
    """Mastery on submit: worked out anew, from their current answers, for the users of a batch; the others' stays.

    A median cannot be merged, but it needs only the latest answers, not the log. A user without any topic left has one row
    without a topic, which readers pass over.
    """
    spark, folder = attempts.sparkSession, work_folder(attempts.sparkSession)
    answers, mastery = Snapshot(f"{folder}/answers", latest_answers), Snapshot(f"{folder}/mastery", latest_of_user)

    def merge(batch: DataFrame, number: int) -> None:
        _merge_answers(answers, batch, number)
        users = batch.select("user_id").distinct()
        current = answers.read(batch.sparkSession, number + 1, users)
        if current is not None:
            found = topic_mastery(current, edges)
            mastery.write(found.unionByName(users.join(found, "user_id", "left_anti"), allowMissingColumns=True), number)

    run_to_end(attempts.writeStream.foreachBatch(merge), folder)
    found = mastery.read(spark, ALL)
    return found.where("topic_id IS NOT NULL") if found is not None else topic_mastery(spark.createDataFrame([], attempts.schema), edges)


def _appended(rows: DataFrame, mode: str = "append") -> DataFrame:
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession)
    run_to_end(rows.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out"), folder)
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def stream_daily_usage(attempts: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Uses by user and day; a day is given out once the watermark has passed it, and rows later than that are dropped."""
    days = attempts.withWatermark("created_at", lateness).groupBy("user_id", F.window("created_at", "1 day")).agg(F.count(F.lit(1)).alias("used"))
    return _appended(days.select("user_id", F.to_date("window.start").alias("day"), "used"))


def stream_dedupe(attempts: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Submissions seen once, however often they are sent within the lateness."""
    return _appended(attempts.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["seq"]))


def stream_sittings(attempts: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """A user's attempts in sittings that end after a gap without any."""
    sat = attempts.withWatermark("created_at", lateness).groupBy("user_id", F.session_window("created_at", gap)).agg(F.count(F.lit(1)).alias("attempts"))
    return _appended(sat.select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "attempts"))
