"""A corpus from raw documents to token ids: five stages, each a training-data operator applied to what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, decontaminate, language, near_dedup, toxicity
from quillstone.llm._store import column, discard, discarded, new_path, written

#: Ids of removed documents up to which they are broadcast, so that no text is shuffled to leave them out.
BROADCAST_IDS = 1 << 20


def _packed(docs: DataFrame) -> DataFrame:
    """The text beside the other columns as one struct, so that no name of theirs can clash with an operator's."""
    return docs.select("text", F.struct(*(column(c) for c in docs.columns if c != "text")).alias("others"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; null and empty texts have nothing to reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = toxicity.fit(toxicity.training_rows(docs, labels))
    return _unpacked(toxicity.scored(_packed(docs), grammar).where("score < 0.7"), docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language by more than a narrow margin; null texts and texts without a letter go."""
    contents = language.fit(docs.where(~toxicity.remainder_is(F.col("doc_id"), 4, 2)))
    return _unpacked(language.identified(_packed(docs), contents).where("NOT lang_rejected"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates (runs of five words, similarity 0.8 or more).

    Rows that share an id are one document, of which one row stays; rows with a null id stay.
    """
    found = written(near_dedup.near_duplicates(docs.select("doc_id", "text")), "groups").where("doc_id IS NOT NULL")
    gone = found.where("NOT kept").select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:  # else both sides are shuffled
        gone = F.broadcast(gone)
    repeated = written(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    columns = [column(c) for c in docs.columns]
    left = docs.join(gone, "doc_id", "left_anti").select(*columns)
    if repeated.isEmpty():
        return left
    return left.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(left.join(repeated, "doc_id", "left_semi").select(*columns).dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item (or all words of a shorter one)."""
    rows = docs.select("text", F.struct(*(column(c) for c in docs.columns)).alias("row"))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.contamination(rows, benchmark, id_col="row", spans=False).where("n_hit = 0").select("id.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their number and digest, and the digest of the text decoded from them."""
    path = bpe.vocabulary_path()
    ids = bpe.encoded(docs.select("doc_id", "text"), path, carried=["doc_id"], decode=True)
    return ids.select("doc_id", "n_tokens", "ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]

#: Learned scores and token ids have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each stored and read again; the last one's rows.

    What a stage stored on its way is deleted once its result is, and a result once the next one is. Empty tables give no
    rows.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with discarded():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last is not None:
            discard(last)
        last = path
    return docs
