"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quillstone.llm._store import column, new_path, small_batches, written

WINDOW = 10
#: Nodes of one automaton at most, about (a window adds a node for each of its characters); a node takes about 56 bytes of
#: each Python worker. A larger benchmark is dealt into several automata.
BLOCK_NODES = 4_000_000

#: Words of the text as it stands; with A-Z, which count as the lower-case letters that the automaton reads.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SPAN = StructType([StructField(n, LongType()) for n in ("item_id", "first_word", "end_word", "begin", "end")])


def normalised(text: str | None) -> bytes:
    """The words, A-Z lower-cased, each between single spaces; empty without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return b" " + b" ".join(found) + b" " if found else b""


def windows(text: str | None, window: int = WINDOW) -> list[str]:
    """Distinct runs of ``window`` words of a normalised item; a shorter item, but not an empty one, is one window."""
    found = normalised(text).decode("utf-8", "surrogatepass").split()
    if not found:
        return []
    return sorted({f" {' '.join(found[i : i + window])} " for i in range(max(1, len(found) - window + 1))})


def automaton(found: Iterable[tuple[str, int | None]]) -> ahocorasick.Automaton:
    """One automaton over windows, each with its number of words and the items that have it (a null id is no item)."""
    built, owners = ahocorasick.Automaton(), {}
    for w, item_id in found:
        owners.setdefault(w, set()).add(item_id)
    for w, ids in owners.items():
        built.add_word(w, (w.count(" ") - 1, tuple(i for i in ids if i is not None)))
    if len(built):
        built.make_automaton()
    return built


def spans_of(text: str | None, built: ahocorasick.Automaton, spans: bool = True) -> tuple[int, int, list[int], list[dict]]:
    """Words, hit words, items, and, if asked for, each occurrence with its word range and its code-point range in the text."""
    folded = normalised(text)
    n_words = max(0, folded.count(b" ") - 1)
    if not n_words or not len(built):
        return n_words, 0, [], []
    plain = folded.decode("utf-8", "surrogatepass")
    found = list(built.iter(plain))
    if not found:
        return n_words, 0, [], []
    gaps = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    places = [m.span() for m in WORD.finditer(text)] if spans else []
    hit, windows_hit, told = np.zeros(n_words, bool), {}, []
    for at, (length, owners) in found:
        end = int(np.searchsorted(gaps, at))
        hit[end - length : end] = True
        windows_hit[id(owners)] = owners  # a window's items are told once, however often it occurs
        if spans:
            told += [{"item_id": i, "first_word": end - length, "end_word": end, "begin": places[end - length][0], "end": places[end - 1][1]} for i in owners or (None,)]
    return n_words, int(hit.sum()), sorted(set().union(*windows_hit.values()), key=str), told


def window_table(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``window, item`` of each item's distinct windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), _texts(batch.column(1)), strict=True):
                found = windows(text, window)
                for i in range(0, len(found), 4096):
                    part = found[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([item.as_py()] * len(part), pa.int64())], names=["window", "item"])

    rows = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(cut, "window string, item bigint").distinct()


def _block(folder: str, number: int) -> Iterator[tuple[str, int | None]]:
    """The windows of one block, read by a task from the shared folder."""
    files, at = pa.fs.FileSystem.from_uri(f"{folder}/block={number}")
    for info in files.get_file_info(pa.fs.FileSelector(at, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            table = pq.read_table(info.path, filesystem=files, columns=["window", "item"], partitioning=None)
            yield from zip(table["window"].to_pylist(), table["item"].to_pylist(), strict=True)


@lru_cache(maxsize=1)
def _automaton(folder: str, number: int) -> ahocorasick.Automaton:
    """A block's automaton, kept in the worker from one task to the next; one at a time, so that blocks don't add up."""
    return automaton(_block(folder, number))


def _scan(docs: DataFrame, id_col: str, text_col: str, folder: str, number: int, spans: bool = True) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _automaton(folder, number)
        out = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "first_word", "end_word", "begin", "end")]))
        for batch in batches:
            rows = [spans_of(t, built, spans) for t in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], out)],
                names=["id", "n_words", "n_hit", "item_ids", "spans"],
            )

    chosen = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    schema = StructType([StructField("id", chosen.schema["id"].dataType), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("item_ids", ArrayType(LongType())), StructField("spans", ArrayType(_SPAN))])
    return chosen.mapInArrow(scan, schema)


def _texts(column: pa.Array) -> Iterator[str | None]:
    """One Python string at a time, so that a batch is not held twice."""
    for value in column:
        yield value.as_py()


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_nodes: int = BLOCK_NODES, spans: bool = True
) -> DataFrame:
    """For each document row: words, hit words, items with an occurring window, and the spans in the original text.

    Columns: ``id, n_words, n_hit, item_ids, spans``; the id may be of any type, a struct of oddly named columns
    included. Null or wordless texts have no words and no hits; a null item id hits words but is no item; repeated rows
    give repeated rows; empty tables give no rows, or no hits. The benchmark's distinct windows are written to the shared
    folder in blocks of about ``block_nodes`` automaton nodes, and each task reads the block it needs, so nothing of the
    benchmark passes through the driver. With one block, as is usual, each text is scanned once by the one automaton and
    nothing is shuffled; with more, each block's automaton scans all texts and the blocks' spans are combined per row. Without
    ``spans`` one block gives empty ones: a window of very many items then costs no more than another.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    found = written(window_table(benchmark, item_col=item_col, text_col=item_text_col, window=window), "windows")
    nodes = found.agg(F.coalesce(F.sum(F.length("window")), F.lit(0))).first()[0]
    blocks = max(1, -(-nodes // block_nodes))
    folder = new_path(spark, "window-blocks")
    found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int")).repartition(F.col("block")).write.partitionBy("block").parquet(folder)
    if blocks == 1:
        return _scan(docs, id_col, text_col, folder, 0, spans)
    rows = written(docs.select(column(id_col).alias("doc"), column(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "decontaminate")
    parts = None
    for k in range(blocks):
        part = _scan(rows, "row", "text", folder, k)
        parts = part if parts is None else parts.unionByName(part)
    whole = parts.groupBy("id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first_word"], s["end_word"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda s: s["item_id"].cast("string")), lambda i: i.isNotNull())))
    return rows.select("row", F.col("doc").alias("id")).join(whole.withColumnRenamed("id", "row"), "row").select(
        "id", "n_words", covered.cast("bigint").alias("n_hit"), F.transform(ids, lambda i: i.cast("bigint")).alias("item_ids"), "spans"
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, hit words and items of the benchmark; null and empty texts have none."""
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return digest(contamination(docs.select("doc_id", "text"), bench.select("item_id", "text"), spans=False))


def items_sha256(ids: Iterable[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.n, d.i, m.item_id FROM doc_windows d JOIN item_windows m ON d.win = m.win AND d.n = m.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": ORACLE}
