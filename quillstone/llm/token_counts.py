"""Greedy word-piece lengths by a linear longest-match automaton, without building the pieces."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from quillstone.llm._store import column

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = -1
#: Distinct words whose counts a task remembers, and the bytes of the longest one that it does.
REMEMBERED, LONGEST = 200_000, 64


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def pieces(path: str, end: str = "</w>") -> list[tuple[bytes, bool]]:
    """A byte-level vocabulary file's pieces: their bytes, and whether they close a word."""
    letters = byte_letters()
    found = []
    for token in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        closes = token.endswith(end)
        body = token[: -len(end)] if closes else token
        if body and all(c in letters for c in body):
            found.append((bytes(letters[c] for c in body), closes))
    return found


class LongestMatch:
    """A trie over pieces in which each node knows where to go when the next byte does not continue it.

    A node stands for the bytes read since the last piece was settled. Where no child fits, ``fail`` leads to the node
    of the bytes that remain once the longest pieces were taken off, and ``popped`` says how many pieces that were;
    so a word is counted in time linear in its length. A word that cannot be cut into pieces counts as one.
    """

    def __init__(self, vocabulary: Iterable[tuple[bytes, bool]]):
        self.children: list[dict[int, int]] = [{}]
        piece: list[bool] = [False]
        for body, closes in vocabulary:
            node = 0
            for b in [*body, END] if closes else body:
                if (after := self.children[node].get(b)) is None:
                    after = self.children[node][b] = len(self.children)
                    self.children.append({})
                    piece.append(False)
                node = after
            piece[node] = True
        self.fail: list[int | None] = [None] * len(self.children)
        self.popped = [0] * len(self.children)
        level = [0]
        while level:
            after = []
            for parent in level:
                for b, node in self.children[parent].items():
                    after.append(node)
                    if piece[node]:
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    at, count = self.fail[parent], self.popped[parent]
                    while at is not None and b not in self.children[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at is not None:
                        self.fail[node], self.popped[node] = self.children[at][b], count
            level = after

    def count(self, word: bytes) -> int:
        node, total = 0, 0
        children, fail, popped = self.children, self.fail, self.popped
        for b in (*word, END):
            while (after := children[node].get(b)) is None:
                total += popped[node]
                if (node := fail[node]) is None:
                    return 1
            node = after
        while node:
            total += popped[node]
            if (node := fail[node]) is None:
                return 1
        return total


class Counts(dict):
    """Pieces of a word, remembered if it is short: a bound on words and on their bytes, within a text as between texts."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


@cache
def _automaton(path: str) -> LongestMatch:
    return LongestMatch(pieces(path))


def counted(docs: DataFrame, vocabulary: str, *, text_col: str = "text") -> DataFrame:
    """The rows with ``n_words`` and ``n_tokens`` added (columns of these names are replaced).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, each closed by the end mark. Null and empty texts have none.
    Each task builds the automaton from the file once and remembers a bounded number of short words; nothing is shuffled.
    Repeated rows are counted each, and an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    docs = docs.select(*(column(c) for c in kept))
    at = kept.index(text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counts(_automaton(vocabulary))
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(at):
                found = (text.as_py() or "").encode("utf-8", "replace").translate(_LOWER).split()
                words.append(len(found))
                tokens.append(sum(map(known.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*kept, "n_words", "n_tokens"])

    return docs.mapInArrow(count, StructType([*docs.schema.fields]).add("n_words", LongType()).add("n_tokens", LongType()))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of words and of the pieces they are greedily cut into; null is empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return counted(docs, vocabulary_path()).select("doc_id", "n_words", "n_tokens")


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
