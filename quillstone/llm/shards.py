"""Sharding by a two-pass external shuffle: seeded scatter into memory-sized buckets, Fisher-Yates in each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from quillstone.llm._store import column, new_path, small_batches, written

#: Bytes of a bucket, which one task holds at a time, and of the run of buckets that it works through.
BUCKET_BYTES, RUN_BYTES = 16 << 20, 128 << 20
ROW_OVERHEAD = 16
#: Rows equal in every column beyond which their copies are scattered one by one.
HOT_COPIES = 4096


def row_size(text_col: str | Column):
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + ROW_OVERHEAD


def _scattered(df: DataFrame, text_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows as ``h, row`` with the hash that scatters them, and how many rows and bytes have each hash.

    All columns are hashed, so rows of one id, text or source are spread. Rows that repeat in every column are
    interchangeable; many of them are numbered in a written table first, and scattered by that number.
    """
    keys = [column(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = df.select(F.xxhash64(F.lit(seed), *keys).alias("h"), row_size(column(text_col)).alias("size"), F.struct(*(column(c) for c in df.columns)).alias("row"))
    tally = (F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    each = written(rows.groupBy("h").agg(*tally), "shard-hashes")
    hot = each.where(F.col("n") > HOT_COPIES).select("h")
    if hot.isEmpty():
        return rows.select("h", "row"), each
    marked = rows.join(written(hot.withColumn("hot", F.lit(True)), "shard-hot"), "h", "left")
    copies = written(marked.where("hot").select(F.xxhash64(F.lit(seed), "h", F.monotonically_increasing_id()).alias("h"), "size", "row"), "shard-copies")
    each = each.where(F.col("n") <= HOT_COPIES).unionByName(copies.groupBy("h").agg(*tally))
    return marked.where("hot IS NULL").select("h", "row").unionByName(copies.select("h", "row")), each


def shuffled(df: DataFrame, n_shards: int, *, text_col: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows in a uniformly random order, with ``shard`` and ``slot``: row counts of shards differ by one at most.

    Pass one scatters rows by a seeded hash of all their columns into buckets of about ``bucket_bytes``; pass two sorts
    each bucket by that hash (so that a retried task sees the same order) and shuffles it by Fisher-Yates with the
    bucket's own seed. A task works through a run of neighbouring buckets, one in memory at a time. Buckets in turn give a
    row its place among all, and shards are equal runs of places. Nulls hash like any value; repeated rows each keep a
    place of their own and may change places with each other only. Columns named ``shard`` or ``slot`` are replaced;
    map columns are carried but not hashed. An empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    df = df.select(*(column(c) for c in df.columns if c not in ("shard", "slot")))
    rows, each = _scattered(df, text_col, seed)
    n, size = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    runs = min(buckets, max(-(-size // RUN_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bucket = F.pmod("h", F.lit(buckets)).cast("bigint")
    run = F.floor(bucket * runs / buckets).cast("int")
    laid = rows.select(run.alias("run"), bucket.alias("bucket"), "h", "row").repartitionById(runs, F.col("run")).sortWithinPartitions("bucket", "h")

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, place = -1, 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal place
            table = pa.Table.from_batches(held)
            order = np.random.default_rng([seed, number]).permutation(len(table))  # a Fisher-Yates shuffle
            table = table.take(order).select(["run", "row"]).append_column("place", pa.array(np.arange(place, place + len(table), dtype=np.int64)))
            place += len(table)
            held.clear()
            yield from table.to_batches()

        for batch in batches:
            own = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if held and own[begin] != number:
                    yield from done()
                number = int(own[begin]) if end > begin else number
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
        if held:
            yield from done()

    dealt = laid.mapInArrow(shuffle, StructType([laid.schema["run"], laid.schema["row"]]).add("place", LongType()))
    # One row for each run of RUN_BYTES or more: 16 bytes in 128 MB, small enough for one window and a broadcast.
    counts = written(each.groupBy(run.alias("run")).agg(F.sum("n").alias("n")), "shard-runs")
    begins = counts.select("run", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    at = dealt.join(F.broadcast(begins), "run").select("row", (F.col("begin") + F.col("place")).alias("at"))
    whole, more = divmod(n, n_shards)
    long = F.lit(more * (whole + 1))
    shard = F.when(F.col("at") < long, F.floor(F.col("at") / (whole + 1))).otherwise(more + F.floor((F.col("at") - long) / max(1, whole)))
    begin = F.col("shard") * whole + F.least(F.col("shard"), F.lit(more))
    return at.select("row.*", "at", shard.cast("int").alias("shard")).withColumn("slot", (F.col("at") - begin).cast("bigint")).drop("at")


def write_shards(df: DataFrame, path: str, n_shards: int, **options) -> DataFrame:
    """Shuffle, and write one folder for each shard, in files by slot; the written table.

    A task's run of places lies in one shard or in neighbouring ones, so a shard has one file for each task that it spans.
    """
    out = shuffled(df, n_shards, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 40 shards by the law ``rows``; null texts have the overhead alone for a size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = write_shards(docs, new_path(spark, "shards"), 40)
    return done.select(
        "doc_id", row_size("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op4_sharding": op4_sharding}
ORACLES: dict[str, str] = {}
