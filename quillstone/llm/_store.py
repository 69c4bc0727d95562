"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch; Spark's own default is 16 times as large, which several workers cannot hold beside a heap.
BATCH_BYTES = 4 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size for the operators' tasks, unless the session has a size of its own.

    Spark reads the setting when a query is planned, which may be long after an operator has returned, so it stays set.
    """
    if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def column(name: str) -> Column:
    """The column of exactly this name, dots, spaces and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without the setting gets a temporary folder, a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or None
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths made within the innermost open ``discarded`` of this context: other threads' and tasks' paths are never on it.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def discard(*paths: str) -> None:
    """Delete folders that nothing will read again; those that are not there are passed over."""
    for path in paths:
        files, at = pyarrow.fs.FileSystem.from_uri(path)
        if files.get_file_info(at).type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(at)


@contextmanager
def discarded() -> Iterator[None]:
    """Intermediate tables written inside are deleted at its end: what is to stay must have been stored elsewhere by then.

    Lazy results read such tables, and a lost executor may read them again, so only who stores a result can say when it is
    stored; the operators themselves delete nothing. Runs in other threads keep their own lists.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        discard(*made)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
