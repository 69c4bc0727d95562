"""Harmonic packing: pieces of documents in reciprocal-capacity classes, a fixed number of them in each bin."""

from __future__ import annotations

import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from quillstone.llm._store import column, small_batches, written
from quillstone.llm.token_counts import byte_letters, vocabulary_path

CAPACITY, END_ID = 4096, 2
#: Tokens of padding that a cut must save.
CUT_COST = 8.0
#: Words that a worker remembers of late, and as many from before, and the bytes of the longest one.
REMEMBERED, LONGEST = 400_000, 48
#: Bytes of a text that are split into words at a time, and of ids in an Arrow batch that goes back.
STRETCH, BATCH_IDS = 1 << 20, 1 << 20
#: Times ``capacity`` the pieces that one task takes after the first round. Open bins of all classes hold fewer than 8 times
#: as many up to a capacity of a million, and at 4096 about 21,000 pieces of 2 MB at most.
REST = 64

PIECE = ("start", "length", "doc_tokens", "ids", "sequence_id", "offset")

_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Printable ASCII and Latin letters that no normal form composes further and that lower-case one by one.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
#: The tokenizer's own rule for parts of a stretch, on these characters.
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^0-9a-zß-öø-ſ]+")


class Words(dict):
    """A tokenizer's ids, as little-endian bytes, of each stretch of a text between ASCII white space.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its stretches in turn. A stretch
    of common characters is cut by the tokenizer's rule and goes to the library's model at once, without its normaliser;
    anything else, and what may be a special token, goes through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})
        self.before: dict[bytes, bytes] = {}

    def plain(self, word: str) -> list[int]:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    def found(self, stretch: bytes) -> bytes:
        text = stretch.decode("utf-8", "replace")
        if _SIMPLE.fullmatch(text) and "<|" not in text:
            ids = []
            for part in _PART.findall(text.lower()):
                ids += self.plain(part)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()

    def __missing__(self, stretch: bytes) -> bytes:
        ids = self.before.get(stretch)
        if ids is None:
            ids = self.found(stretch)
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[stretch] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        if len(text) <= STRETCH:
            return b"".join(map(self.__getitem__, text.split()))
        done, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + STRETCH)
            end = cut.start() if cut else len(text)
            done.append(b"".join(map(self.__getitem__, text[at:end].split())))
            at = end
        return b"".join(done)


@cache
def _words(path: str) -> Words:
    return Words(path)


@cache
def cuts(capacity: int, cut_cost: float = CUT_COST) -> np.ndarray:
    """For each length below ``capacity`` the length of the first piece to cut off, the length itself for no cut.

    A piece of n tokens is of class k = capacity // n and shares its bin with k - 1 others, so it brings capacity / k - n
    tokens of padding. The cuts are those with the least padding, where each must save ``cut_cost`` of it.
    """
    n = np.arange(1, capacity)
    waste = np.concatenate([[0.0], capacity / (capacity // n) - n])
    least, first = waste.copy(), np.arange(capacity)
    for n in range(2, capacity):
        both = waste[1:n] + least[n - 1 : 0 : -1]
        at = int(np.argmin(both))
        if both[at] + cut_cost < least[n]:
            least[n], first[n] = both[at] + cut_cost, at + 1
    return first


def pieces(n: int, capacity: int, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces: whole bins as long as they fill, then the cuts of what remains."""
    at = 0
    while n - at >= capacity:
        yield at, capacity
        at += capacity
    while at < n:
        yield at, int(first[n - at])
        at += int(first[n - at])


class _Filler:
    """Bins of one task: the k-th class's open one closes with its k-th piece. Rows come out in Arrow batches."""

    def __init__(self, schema: pa.Schema, capacity: int, numbers: Iterator[int]):
        self.schema, self.capacity, self.numbers = schema, capacity, numbers
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        group = self.open[k]
        group.append(piece)
        if len(group) == k:
            del self.open[k]
            self.close(group)

    def close(self, group: list[tuple]) -> None:
        number, at = next(self.numbers), 0
        for piece in group:
            self.put((*piece, number, at))
            at += piece[2]

    def put(self, row: tuple) -> None:
        self.rows.append(row)
        self.held += row[2]

    def left(self) -> None:
        """The pieces of open bins, without a sequence."""
        for group in self.open.values():
            for piece in group:
                self.put((*piece, None, None))

    def last(self) -> None:
        """Open bins laid end to end and cut at every ``capacity``; what remains at last, at powers of two."""
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        total = sum(piece[2] for piece in rest)
        ends = [*range(self.capacity, total + 1, self.capacity)]
        at = ends[-1] if ends else 0
        while at < total:
            at += 1 << ((total - at).bit_length() - 1)
            ends.append(at)
        group, place, ends = [], 0, iter(ends)
        end = next(ends, 0)
        for key, start, length, tokens, ids in rest:
            done = 0
            while done < length:
                part = min(length - done, end - place)
                group.append((key, start + done, part, tokens, ids[4 * done : 4 * (done + part)]))
                done, place = done + part, place + part
                if place == end:
                    self.close(group)
                    group, end = [], next(ends, 0)

    def batches(self, least: int = BATCH_IDS // 4) -> Iterator[pa.RecordBatch]:
        if self.held >= least and self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
            self.rows, self.held = [], 0


def _numbers(level: int) -> Iterator[int]:
    """Sequence numbers of this task: level, partition and a count, so that tasks need not know of each other."""
    base = (level << 56) | (TaskContext.get().partitionId() << 28)
    return iter(range(base, base + (1 << 28)))


def packed(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID, cut_cost: float = CUT_COST) -> DataFrame:
    """Sequences of at most ``capacity`` tokens: a row for each piece of a document.

    A document is its text's ids, as the tokenizers library gives them without added special tokens, and ``end_id``. Each
    row has ``id_col``, ``start`` (ids of the document before the piece), ``length``, ``doc_tokens`` (of the document),
    ``ids`` (little-endian unsigned 32-bit numbers), ``sequence_id`` and ``offset`` (place there, without gaps).

    Every task fills the bins of each class by itself. The pieces of bins that are open at its end are dealt to fewer tasks,
    round by round, until one bounded task has them all, which fills bins once more and lays end to end what is left. So
    padding is what pieces lack to their class's share. Null texts count as empty; a document without tokens (an empty
    text and no ``end_id``) has no rows. Ids may be null or repeat, each row is a document of its own. Other columns are
    dropped; ``id_col`` must not have the name of a column above (ValueError). An empty table gives no rows.
    """
    if id_col in PIECE:
        raise ValueError(f"the id column can't be called {id_col}")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(column(id_col).alias("key"), column(text_col).cast("string").alias("text"))
    schema = StructType([docs.schema[0]])
    for name in PIECE:
        schema = schema.add(name, BinaryType() if name == "ids" else LongType())
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def filler(kind: pa.DataType, level: int) -> _Filler:
        kinds = {"ids": pa.binary()}
        return _Filler(pa.schema([("key", kind), *((name, kinds.get(name, pa.int64())) for name in PIECE)]), capacity, _numbers(level))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first, bins = _words(tokenizer), cuts(capacity, cut_cost), None
        for batch in batches:
            bins = bins or filler(batch.schema.field(0).type, 0)
            for key, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                ids = words.ids(text.as_py() or b"") + end
                n, key = len(ids) // 4, key.as_py()
                for start, length in pieces(n, capacity, first):
                    bins.add((key, start, length, n, ids[4 * start : 4 * (start + length)]))
                yield from bins.batches()
        if bins:
            bins.left()
            yield from bins.batches(0)

    def refill(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins = None
            for batch in batches:
                bins = bins or filler(batch.schema.field(0).type, level)
                for piece in _pieces(batch):
                    bins.add(piece)
                yield from bins.batches()
            if bins:
                bins.last() if last else bins.left()
                yield from bins.batches(0)

        return run

    done, level, tasks = written(docs.mapInArrow(fill, schema), "packing"), 0, 1 << 28
    full = done.where("sequence_id IS NOT NULL")
    left = done.where("sequence_id IS NULL")
    while (n := left.count()) > 0:
        level += 1
        tasks = max(1, min(-(-n // (REST * capacity)), tasks // 2))
        rest = left.repartition(1) if tasks == 1 else left.repartition(tasks, "key", "start")
        done = written(rest.mapInArrow(refill(level, tasks == 1), schema), "packing-rest")
        full = full.unionByName(done.where("sequence_id IS NOT NULL"))
        left = done.where("sequence_id IS NULL")
    return full.select(F.col("key").alias(id_col), *PIECE)


def _pieces(batch: pa.RecordBatch) -> Iterable[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)


def sequences(pieces: DataFrame, *, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``sequence_id, n_tokens, ids``: each sequence's ids in a row, padded to ``capacity`` unless a power of two."""
    size = F.sum("length")
    laid = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    ids = F.unhex(F.array_join(laid, ""))
    padded = F.when(F.bit_count(F.col("n_tokens")) == 1, F.col("ids")).otherwise(F.rpad("ids", F.lit(4 * capacity), F.lit(np.array([pad_id], "<u4").tobytes())))
    return pieces.groupBy("sequence_id").agg(size.alias("n_tokens"), ids.alias("ids")).select("sequence_id", "n_tokens", padded.alias("ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096: the place of each piece and the digest of its ids; null is empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = packed(docs, vocabulary_path())
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op11_packing": op11_packing}
ORACLES: dict[str, str] = {}
