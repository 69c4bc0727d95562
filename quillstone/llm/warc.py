"""WARC archives: a writer that stores equal payloads once, and a Python data source that reads them back."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from quillstone.llm._store import new_path

#: Payloads of fewer bytes are always stored whole.
MIN_REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, content_length bigint, payload_length bigint, path string, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: Bytes of records in an archive, before compression, from which on the next one is begun.
ARCHIVE_BYTES = 1 << 30
_READ = 1 << 20
_BATCH_BYTES = 8 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, length: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with only the HTTP head of what it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def with_roles(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The pages with ``payload, payload_bytes, payload_hash, first_id``: ``first_id`` is set where a page repeats another's payload.

    Of equal payloads of at least ``min_bytes`` bytes, the smallest id is stored and the others revisit it; rows that
    repeat that id, too, are stored. Null payloads are empty; null ids come after all others, and without another
    id they are stored. Equal payloads are counted before the join, so a payload that a third of all pages share makes
    one row of the smaller side, and the larger side's partition can be split.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.withColumn("payload", payload).withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_hash", F.unhex(F.sha1("payload")))
    firsts = (
        pages.select(F.col(id_col).alias("first_id"), payload.alias("payload"))
        .where(F.octet_length("payload") >= min_bytes)
        .groupBy(F.unhex(F.sha1("payload")).alias("payload_hash"))
        .agg(F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
        .drop("n")
    )
    first = F.when(~F.col(id_col).eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(firsts, "payload_hash", "left").withColumn("first_id", first)


def write_archives(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", urn: str = "urn:page:", date: str = "1970-01-01T00:00:00Z", min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write gzip archives of about ``archive_bytes`` of records, a member for each record; returns path and records of each.

    A task writes its partition's records in a total order of their own, so archives begin and end at the same records
    however often it runs; each is written under a name of the attempt and renamed when it is whole, so a retried task
    leaves one archive of each number. Null ids are written without a number; repeated rows are records of their own.
    """
    rows = with_roles(pages, id_col=id_col, payload_col=payload_col, min_bytes=min_bytes).select(
        F.concat(F.lit(urn), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("record_id"),
        F.col(url_col).alias("url"),
        F.when(F.col("first_id").isNull(), F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_hash",
        F.concat(F.lit(urn), F.col("first_id").cast("string")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pa.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        own, paths, counts = f"{at}/.{task.taskAttemptId()}.tmp", [], []
        out, n, held = None, 0, 0

        def close() -> None:
            out.close()
            paths.append(f"{at}/part-{task.partitionId():06d}-{len(paths):04d}.warc.gz")
            counts.append(n)
            files.move(own, paths[-1])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    out, n, held = files.open_output_stream(own, compression=None), 0, 0
                record_id, url, payload, length, digest, refers_to = (x.as_py() for x in row)
                whole = record(record_id, url, payload or b"", length, base64.b32encode(digest).decode(), refers_to, date)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(packer.compress(whole) + packer.flush())
                n, held = n + 1, held + len(whole)
                if held >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    files, at = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    from quillstone.llm._store import written

    ordered = rows.sortWithinPartitions("record_id", "payload_hash", "refers_to", "url")
    return written(ordered.mapInArrow(write, "path string, records bigint"), "warc-manifest")


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """One partition for each archive. Predicates on record type and header columns are tested once a record's headers
    are parsed; the payload of a record that fails is skipped over without being kept or decoded."""

    COMPARE = {EqualTo: lambda x, y: x == y, In: lambda x, y: x in y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y}

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[str, Any, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            known = len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in (*HEADERS, "content_length")
            if known and isinstance(f, (IsNotNull, IsNull)):
                self.tests.append((f.attribute[0], isinstance(f, IsNull), None))
            elif known and type(f) in self.COMPARE:
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, at = pa.fs.FileSystem.from_uri(self.folder)
        found = files.get_file_info(pa.fs.FileSelector(at, recursive=True))
        return [Archive(f.path) for f in sorted(found, key=lambda f: -(f.size or 0)) if f.path.endswith((".warc", ".warc.gz"))] or [Archive("")]

    def wanted(self, row: dict[str, Any]) -> bool:
        for name, test, value in self.tests:
            x = row[name]
            if isinstance(test, bool):
                if (x is None) != test:
                    return False
            elif x is None or not next(f for kind, f in self.COMPARE.items() if kind.__name__ == test)(x, value):
                return False
        return True

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = pa.fs.FileSystem.from_uri(self.folder)
        rows: list[dict[str, Any]] = []
        held = 0
        with files.open_input_stream(partition.path, compression="gzip" if partition.path.endswith(".gz") else None, buffer_size=_READ) as stream:
            for row in self.records(_Lines(stream), partition.path):
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held > _BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        yield _batch(rows)

    def records(self, source: _Lines, path: str) -> Iterator[dict[str, Any]]:
        while (line := source.line()) is not None:
            if not line.startswith(b"WARC/"):
                if line:
                    raise ValueError(f"{path}: a record should begin here, not {line[:60]!r}")
                continue
            head = source.headers()
            length = int(head.get("content-length", 0))
            row: dict[str, Any] = {column: (head.get(name.lower()) or None) for column, name in HEADERS.items()}
            for c in ("record_id", "refers_to"):
                row[c] = row[c] and row[c].strip("<>")
            row["payload_digest"] = row["payload_digest"] and row["payload_digest"].rpartition(":")[2]
            row |= {"content_length": length, "payload_length": length, "path": path, "payload": None}
            if not self.wanted(row):
                source.skip(length)
                continue
            if head.get("content-type", "").startswith("application/http"):
                before = source.at
                source.line()
                http = source.headers()
                length -= source.at - before
                row["payload_length"] = int(http.get("content-length", length))
            if (self.payload or self.verify) and row["record_type"] != "revisit":
                body = source.take(length)
                if self.verify and row["payload_digest"] != sha1_base32(body):
                    raise ValueError(f"{path}: the payload of {row['record_id']} is not what its digest says")
                row["payload"] = body if self.payload else None
            else:
                source.skip(length)
            yield row


class _Lines:
    """Lines, blocks and skips over a byte stream, holding one buffer at a time."""

    def __init__(self, stream):
        self.stream, self.buffer, self.place, self.at = stream, b"", 0, 0

    def _more(self) -> bool:
        more = self.stream.read(_READ)
        self.buffer, self.place = self.buffer[self.place :] + more, 0
        return bool(more)

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\n", self.place)) < 0:
            if not self._more():
                return None if self.place == len(self.buffer) else self.take(len(self.buffer) - self.place)
        line = self.buffer[self.place : end].rstrip(b"\r")
        self.at += end + 1 - self.place
        self.place = end + 1
        return line

    def headers(self) -> dict[str, str]:
        found = {}
        while line := self.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found[name.strip().lower()] = value.strip()
        return found

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            part = self.buffer[self.place : self.place + left]
            parts.append(part)
            left -= len(part)
            self.place += len(part)
            if left and not self._more():
                raise EOFError("the archive ends inside a record")
        self.at += n
        return b"".join(parts)

    def skip(self, n: int) -> None:
        left = n
        while left > len(self.buffer) - self.place:
            left -= len(self.buffer) - self.place
            self.place = len(self.buffer)
            if not self._more():
                raise EOFError("the archive ends inside a record")
        self.place += left
        self.at += n


def _batch(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[c.split()[1]]) for n, c in zip(names, SCHEMA.split(", "), strict=True)], names=names)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: ``payload`` (false leaves payloads out), ``verify``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The records of a folder's archives. Sets filterPushdown of Python sources in the session, which Spark leaves off.

    Spark keeps the predicates that one query pushed into a source for a later query that pushes none. Every query made
    from this table therefore pushes one at least: that there is a record type, which each WARC record must have.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(folder).where(F.col("record_type").isNotNull())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each page written to archives and read back: its payload's size and digest, and what it repeats."""
    folder = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    back = read_archives(spark, folder, payload="false", verify="true")
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("bigint")
    return back.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))


#: DuckDB has SHA-1 but no base-32 encoder: its 40 hex digits are regrouped into 32 five-bit letters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT page_id, array_to_string(list_transform(range(1, 41), lambda i: right(bin(('0x' || substr(hex, i, 1))::INT + 16), 4)), '') AS b FROM p),
digest AS (
  SELECT page_id, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: substr(b, i * 5 + j + 1, 1)::INT * (16 >> j)))::INT, 1)), '') AS payload_digest FROM bits),
firsts AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN digest USING (page_id) JOIN firsts USING (hex)
"""

QUERIES = {"op7_warc": op7_warc}
ORACLES = {"op7_warc": ORACLE}
