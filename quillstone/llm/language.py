"""Language identification by compression: one zstandard raw-content dictionary for each language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from quillstone.llm._store import column, small_batches
from quillstone.llm.toxicity import remainder_is

#: A dictionary's bytes, about how many distinct texts of a language fill it, and the most that one text gives.
DICTIONARY_BYTES, SAMPLE_ROWS, ROW_BYTES = 128 << 10, 96, 4096
LEVEL, PIECE_BYTES = 3, 2048
#: Relative margin between the two smallest encodings below which a text is rejected.
MIN_MARGIN = 0.002
#: Bytes of letters below which a margin says nothing, so that no short text is rejected for it.
MIN_LETTERS = 32
UNKNOWN = "und"

_NO_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def letters(text: str | None) -> bytes:
    """Lower-case letters, with all ASCII that is no letter as single spaces; empty if the text has no letter (numerals are none)."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "


class Classifier:
    """Sizes of a text encoded with each language's dictionary; the smallest wins."""

    def __init__(self, contents: dict[str, bytes]):
        self.contents = contents
        self.coders = {}
        for language, content in sorted(contents.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders[language] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin (1 for a very short text); ``und``, 0 and 0 without a letter or a learned language.

        The whole text is encoded, in pieces small enough that the dictionary and not the text itself explains them.
        Equal sizes are told apart by how many 4-byte runs of the text the dictionaries hold, then by name.
        """
        folded = letters(text)
        if not folded or not self.coders:
            return UNKNOWN, 0.0, 0.0
        pieces = [folded[i : i + PIECE_BYTES] for i in range(0, len(folded), PIECE_BYTES)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), language) for language, c in self.coders.items())
        best = [language for size, language in sizes if size == sizes[0][0]]
        if len(best) > 1:
            runs = {folded[i : i + 4] for i in range(max(1, len(folded) - 3))}
            counted = sorted((-sum(r in self.contents[language] for r in runs), language) for language in best)
            margin = 1.0 if counted[0][0] < counted[1][0] else 0.0
            return counted[0][1], 1 / len(best), margin if len(folded) >= MIN_LETTERS else 1.0
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
        return best[0], 1 / math.fsum(2.0 ** max(-60, sizes[0][0] - s) for s, _ in sizes), margin if len(folded) >= MIN_LETTERS else 1.0


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES, row_bytes: int = ROW_BYTES) -> dict[str, bytes]:
    """A dictionary's content for each language: parts of at least about ``sample_rows`` distinct texts, chosen by a hash.

    The share that is drawn comes from the (estimated) number of a language's distinct texts, so copies neither count nor
    displace others; all are drawn where there are fewer than twice ``sample_rows``. A longer text gives ``row_bytes``
    characters from a place of it that a hash chooses, wherever that is, all ASCII but letters being folded before. Rows with null language or
    text teach nothing. What is collected is bounded by the parameters and the number of languages, whatever the table's
    size.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    hashed = F.xxhash64("text", F.lit(41))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(hashed).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * sample_rows / max(1, n)) * (1 << 30)))))
    at = F.pmod(hashed, F.lit(1 << 30))
    folded = rows.where(at < share[F.col("lang")]).select("lang", at.alias("at"), F.xxhash64("text", F.lit(43)).alias("place"), F.regexp_replace("text", _NO_LETTERS, " ").alias("text"))
    begin = F.pmod("place", F.greatest(F.lit(1), F.length("text") - row_bytes + 1)).cast("int") + 1
    picked = folded.select("lang", F.col("text").substr(begin, F.lit(row_bytes)).alias("text"), "at").distinct()
    contents: dict[str, bytes] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["at"], r["text"])):
        have = contents.setdefault(r["lang"], b"")
        if len(have) < dictionary_bytes:
            contents[r["lang"]] = have + letters(r["text"])[:row_bytes]
    return {lang: content[:dictionary_bytes] for lang, content in contents.items() if len(content) >= 8}


def identified(docs: DataFrame, contents: dict[str, bytes], *, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows with ``lang_pred``, ``lang_score`` and ``lang_rejected`` added (columns of these names are replaced).

    Null texts and texts without a letter are ``und`` and rejected; others get a learned language, and are rejected
    when the margin is narrower than ``min_margin``. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(contents)
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    docs = docs.select(*(column(c) for c in kept))
    at = kept.index(text_col)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(held.value)
        for batch in batches:
            found = [classifier.classify(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] == UNKNOWN or f[2] < min_margin for f in found], pa.bool_())],
                names=[*kept, "lang_pred", "lang_score", "lang_rejected"],
            )

    return docs.mapInArrow(identify, StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType()).add("lang_rejected", BooleanType()))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, learned from those whose ids may be; null texts and texts without a letter are ``und``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    contents = fit(docs.where(~remainder_is(F.col("doc_id"), 4, 2)))
    return identified(docs.select("doc_id", "text"), contents).select("doc_id", remainder_is(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


QUERIES = {"op9_language": op9_language}
ORACLES: dict[str, str] = {}
