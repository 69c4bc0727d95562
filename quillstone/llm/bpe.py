"""Byte-level BPE encoding and decoding; long unsplit text by tree concatenation."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import groupby

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from quillstone.llm._store import column, small_batches
from quillstone.llm._text import row_slices
from quillstone.llm.token_counts import byte_letters

#: Bytes of one stretch that the pre-tokenizer does not split, from which on it is encoded as a tree of halves.
LONG_PIECE = 1 << 12
LEAF_BYTES = 1 << 10
#: UTF-8 bytes of a text from which on its parts are encoded as rows of their own.
LONG_TEXT = 1 << 20
PART_BYTES = 1 << 18
#: What decoding adds: the text, and the digest of the decimal ids joined by commas.
DECODED = ("decoded", "ids_sha256")
#: The pre-tokenizer of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Coder:
    """A byte-level BPE vocabulary file (``vocab`` and ``added_tokens``): texts to ids and back."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes_of = [b""] * (1 + max(*ranks.values(), *self.special.values()))
        for body, i in (*ranks.items(), *((c.encode(), i) for c, i in self.special.items())):
            self.bytes_of[i] = body
        self.digits = [str(i) for i in range(len(self.bytes_of))]
        self.spaces = re.compile(rf"\s{{{LONG_PIECE // 4}}}")
        self.split = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def ids(self, text: str | None) -> list[int]:
        """Ids of a whole text; null is empty. Strings of special tokens in a text are those tokens."""
        if not text:
            return []
        if len(text) < LONG_PIECE // 4 or max(map(len, text.split()), default=0) < LONG_PIECE // 4 and not self.spaces.search(text):
            return self.encoding.encode(text, allowed_special="all", disallowed_special=())
        return [i for body, special in self.pieces(text) for i in ([special] if special is not None else self.tree(body))]

    def pieces(self, text: str) -> Iterator[tuple[bytes, int | None]]:
        """What the pre-tokenizer makes of a text: each piece's bytes, and a special token's id."""
        at = 0
        for mark in [*(self.marks.finditer(text) if self.marks else ()), None]:
            for m in self.split.finditer(text[at : mark.start() if mark else len(text)]):
                yield m.group().encode("utf-8", "replace"), None
            if mark:
                yield mark.group().encode(), self.special[mark.group()]
                at = mark.end()

    def leaf(self, piece: bytes) -> list[int]:
        return self.encoding._encode_single_piece(piece)

    def tree(self, piece: bytes) -> list[int]:
        """Ids of one unsplit piece: its halves' ids, joined where they meet."""
        if len(piece) <= LEAF_BYTES:
            return self.leaf(piece)
        middle = len(piece) // 2
        return self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the two sides' bytes together.

        A window of ids around the join is encoded again, twice as wide each time, until its first id is the left
        side's and its last the right side's. Ids are an encoding if and only if each neighbouring pair is, so what
        lies beyond an agreed id need not be looked at again.
        """
        if not left or not right:
            return left + right
        reach = 4
        while True:
            a, b = left[-reach:], right[:reach]
            again = self.leaf(b"".join(map(self.bytes_of.__getitem__, a + b)))
            from_start, to_end = reach >= len(left), reach >= len(right)
            if (from_start or again[0] == a[0]) and (to_end or again[-1] == b[-1]) and (len(again) > 1 or from_start and to_end):
                return left[:-reach] + again + right[reach:]
            reach *= 2

    def text(self, ids: list[int]) -> str:
        """The decoded text, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def ids_sha256(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.digits.__getitem__, ids)).encode()).hexdigest()

    def parts(self, text: str, size: int = PART_BYTES) -> Iterator[tuple[int | None, int | None, list[bytes]]]:
        """A text as parts of about ``size`` bytes: (glue, special, bodies).

        A part is whole pieces, or a special token, or one slice of a piece beyond that size; slices of one piece
        carry the same ``glue`` and are joined once encoded.
        """
        held: list[bytes] = []
        weight = 0
        for n, (body, special) in enumerate(self.pieces(text)):
            if special is None and len(body) <= size:
                held.append(body)
                weight += len(body)
                if weight < size:
                    continue
            if held:
                yield None, None, held
                held, weight = [], 0
            if special is not None:
                yield None, special, []
            elif len(body) > size:
                for i in range(0, len(body), size):
                    yield n, None, [body[i : i + size]]
        if held:
            yield None, None, held

    def joined(self, parts: list[list[int]]) -> list[int]:
        """Ids of the slices of one piece together: neighbours are joined in pairs, then the pairs, as a tree."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def encoded(docs: DataFrame, vocabulary: str, *, text_col: str = "text", long_text: int = LONG_TEXT, carried: Sequence[str] | None = None, decode: bool = False) -> DataFrame:
    """The rows with ``ids`` and ``n_tokens`` added (columns of these names are replaced).

    Each whole text gets the ids that the tokenizers library gives it without added special tokens. Null and empty
    texts have none. Texts of at least ``long_text`` bytes are cut into parts at places where the pre-tokenizer always
    splits; the parts are dealt over all tasks and their ids put together again by text. Other rows are not shuffled.
    Only the ``carried`` columns come back from the workers, by default all. With ``decode`` the same workers add what
    ``decoded`` would, so that ids need not be sent to others.
    """
    from quillstone.llm._store import written

    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    docs = docs.select(*(column(c) for c in kept))
    at = kept.index(text_col)
    back = [i for i, c in enumerate(kept) if (carried is None or c in carried) and not (decode and c in DECODED)]
    names = [*(kept[i] for i in back), "ids", "n_tokens", *(DECODED if decode else ())]
    schema = StructType([docs.schema.fields[i] for i in back]).add("ids", ArrayType(IntegerType())).add("n_tokens", LongType())
    if decode:
        schema = schema.add(DECODED[0], StringType()).add(DECODED[1], StringType())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            for begin, end in row_slices(batch.column(at)):
                rows = batch.slice(begin, end - begin)
                found = [own.ids(t.as_py()) for t in rows.column(at)]
                more = [pa.array(map(f, found), pa.string()) for f in (own.text, own.ids_sha256)] if decode else []
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in back), pa.array(found, pa.list_(pa.int32())), pa.array(map(len, found), pa.int64()), *more], names=names)

    size = F.coalesce(F.octet_length(column(text_col)), F.lit(0))
    if not docs.where(size >= long_text).limit(1).count():
        return docs.mapInArrow(encode, schema)

    row = F.struct(*(column(c) for c in kept))
    long = written(docs.where(size >= long_text).select(F.monotonically_increasing_id().alias("key"), row.alias("row")), "bpe-long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                for n, (glue, special, bodies) in enumerate(own.parts(text.as_py())):
                    values = ([key.as_py()], [n], [glue], [special], [bodies])
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary())), strict=True)], names=["key", "part", "glue", "special", "bodies"])

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            found = [[s] if s is not None else [i for body in bodies for i in own.tree(body)] for s, bodies in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["key", "part", "glue", "ids"])

    def assemble(table: pa.Table) -> pa.Table:
        own, out = coder(vocabulary), []
        rows = table.sort_by("part")
        for glue, group in groupby(zip(rows["glue"].to_pylist(), rows["ids"].to_pylist(), strict=True), key=lambda r: r[0]):
            ids = [i for _, i in group]
            out += own.joined(ids) if glue is not None else [x for i in ids for x in i]
        return pa.table({"key": rows["key"][:1], "ids": pa.array([out], pa.list_(pa.int32()))})

    dealt = long.select("key", F.col("row").getField(text_col).alias("text")).mapInArrow(cut, "key bigint, part int, glue bigint, special int, bodies array<binary>").repartition("key", "part")
    ids = dealt.mapInArrow(encode_part, "key bigint, part int, glue bigint, ids array<int>").groupBy("key").applyInArrow(assemble, "key bigint, ids array<int>")
    whole = long.join(ids, "key", "left").select(*(F.col("row").getField(kept[i]).alias(kept[i]) for i in back), "ids", F.size("ids").cast("bigint").alias("n_tokens"))
    if decode:
        whole = decoded(whole, vocabulary)
    return docs.where(size < long_text).mapInArrow(encode, schema).unionByName(whole)


def decoded(df: DataFrame, vocabulary: str, *, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded`` and ``ids_sha256`` (of the decimal ids joined by commas) added; null ids are none."""
    kept = [c for c in df.columns if c not in DECODED]
    df = df.select(*(column(c) for c in kept))
    at = kept.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            for begin in range(0, len(batch), 512):
                rows = batch.slice(begin, 512)
                ids = [i.values.to_pylist() if i.is_valid else [] for i in rows.column(at)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(map(own.text, ids), pa.string()), pa.array(map(own.ids_sha256, ids), pa.string())], names=[*kept, *DECODED])

    return df.mapInArrow(decode, StructType([*df.schema.fields]).add("decoded", StringType()).add("ids_sha256", StringType()))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of ids and the digests of its ids and of the text decoded from them; null is empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = vocabulary_path()
    return encoded(docs, path, carried=["doc_id"], decode=True).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
