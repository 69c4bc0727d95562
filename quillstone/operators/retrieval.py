"""Vectors: thresholded top-k by cosine, exact similarity search in blocks, and incremental embedding plans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import cosine
from quillstone.sources.files import stored, work_folder

THRESHOLD, LIMIT = 0.82, 5
#: Queries that are held in memory at a time by a similarity search.
QUERY_BLOCK = 2048
#: Vectors that are held against a block at a time.
CORPUS_BLOCK = 4096
#: What a similarity in single precision may be off by.
SINGLE = 1e-5


def match_vector(corpus: DataFrame, query: list[float], *, threshold: float = THRESHOLD, limit: int = LIMIT, subject: int | None = None) -> DataFrame:
    """The nearest vectors of one query above a similarity, nearest first; without a subject all are searched."""
    rows = corpus if subject is None else corpus.where(F.col("subject") == subject)
    scored = rows.withColumn("similarity", cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "vec_id").limit(limit)


def search(corpus: DataFrame, queries: DataFrame, *, threshold: float, limit: int = LIMIT) -> DataFrame:
    """The ``limit`` nearest vectors above a similarity for each of a stated set of queries, exactly.

    Queries are written to the shared folder in blocks of bounded size; one pass over the vectors holds a batch of them
    and one block at a time, so neither is collected, however many they are. A task keeps its best few of a batch for each
    query, so what is shuffled does not grow with the corpus' density around a query. Null vectors match nothing, nor do
    vectors of other lengths than the query's or of length zero; a vector never matches itself (by id).
    """
    spark = corpus.sparkSession
    folder = work_folder(spark)
    sized = F.size("embedding")
    asked = queries.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (sized > 0))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked.withColumn("dim", sized).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition("dim", "block").write.partitionBy("dim", "block").parquet(folder)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pa.fs.FileSystem.from_uri(folder)
        found = sorted(f.path for f in files.get_file_info(pa.fs.FileSelector(at, recursive=True)) if f.path.endswith(".parquet"))
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(1)).to_numpy()
            for dim in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == dim))
                own = rows.column(0).to_numpy()
                v = _matrix(rows.column(1), int(dim))
                for path in found:
                    if f"/dim={dim}/" in path:
                        ids, q = _block(folder, path, int(dim))
                        for begin in range(0, len(own), CORPUS_BLOCK):
                            part = slice(begin, begin + CORPUS_BLOCK)
                            yield _best(ids, q, own[part], v[part], threshold, limit)

    vectors = corpus.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (sized > 0))
    out = vectors.mapInArrow(score, "query_id bigint, vec_id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


@lru_cache(maxsize=4)
def _block(folder: str, path: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A block of queries, kept by the worker: with few blocks it is read once and not for every batch."""
    block = pq.read_table(path, filesystem=pa.fs.FileSystem.from_uri(folder)[0], columns=["vec_id", "embedding"], partitioning=None).combine_chunks()
    return block["vec_id"].to_numpy(), _matrix(block["embedding"].combine_chunks(), dim)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(vectors), dim)


def _best(ids: np.ndarray, q: np.ndarray, own: np.ndarray, v: np.ndarray, threshold: float, limit: int) -> pa.RecordBatch:
    """The best few of a batch of vectors for each query of a block, by similarity and then by id.

    In single precision all that may be among them are found, those as near as the last of them included, so that copies of
    a vector stand in line by their ids; they are ranked in double precision.
    """
    found = _unit(q) @ _unit(v).T
    found[ids[:, None] == own] = -2
    k = min(limit, len(own))
    last = np.partition(found, len(own) - k, axis=1)[:, len(own) - k]
    i, at = np.nonzero(found >= np.maximum(last, threshold)[:, None] - 2 * SINGLE)
    exact = (q[i].astype(np.float64) * v[at]).sum(axis=1) / np.maximum(1e-300, np.linalg.norm(q[i].astype(np.float64), axis=1) * np.linalg.norm(v[at].astype(np.float64), axis=1))
    order = np.lexsort((own[at], -exact, i))
    i, at, exact = i[order], at[order], exact[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = (exact >= threshold) & (rank < limit)
    return pa.RecordBatch.from_arrays([pa.array(ids[i][keep]), pa.array(own[at][keep]), pa.array(exact[keep])], names=["query_id", "vec_id", "similarity"])


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def embedding_plan(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Which groups need a vector: the hash of their text against the one that is stored; a missing text is reported."""
    both = candidates.withColumn("hash", F.sha2("text", 256)).join(stored, "group_id", "left")
    state = F.when(F.col("text").isNull() | (F.trim("text") == ""), "missing_text").when(F.col("stored_hash").isNull(), "new").when(F.col("stored_hash") == F.col("hash"), "unchanged").otherwise("stale")
    return both.select("group_id", state.alias("state"))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-cased text, with two spaces before it and one after."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def fuzzy_search(texts: DataFrame, queries: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """Texts whose trigram sets are at least ``threshold`` alike to those of a stated set of queries, exactly.

    Both sides are distinct texts, so repeated questions add nothing. Each set is ordered from its rarest trigram on; two
    sets as alike as that share one among the first n - ceil(threshold * n) + 1 of either, so candidates meet on those
    alone and not on trigrams that most texts have. Sizes are held against each other before the sets are. Null texts
    match nothing.
    """
    exact = threshold - 0.00005  # similarities are rounded to four decimals
    every = texts.select("text").union(queries.select("query")).where("text IS NOT NULL").distinct().select("text", trigrams(F.col("text")).alias("grams"))
    each = every.select("text", F.explode("grams").alias("g"))
    common = each.groupBy("g").agg(F.count(F.lit(1)).alias("texts"))
    ordered = each.join(common, "g").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("texts", "g"))).alias("by"))
    n = F.size("by")
    sets = ordered.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", F.transform("by", lambda x: x["g"]).alias("grams"), n.alias("n"), (n - F.ceil(n * exact) + 1).cast("int").alias("ahead"))
    sets = stored(sets)

    def of(rows: DataFrame, prefix: str) -> DataFrame:
        chosen = sets.join(rows.toDF("text").distinct(), "text", "left_semi")
        return chosen.select(*(F.col(c).alias(prefix + c) for c in sets.columns))

    def first(rows: DataFrame, prefix: str) -> DataFrame:
        """Only keys and sizes ride with the trigrams; sets are fetched for the pairs that are left."""
        return rows.select(f"{prefix}key", f"{prefix}n", F.explode(F.slice(f"{prefix}grams", F.lit(1), F.col(f"{prefix}ahead"))).alias("g"))

    asked, held = of(queries.select("query"), "q_"), of(texts.select("text"), "t_")
    met = first(asked, "q_").join(first(held, "t_"), "g").where(F.least("q_n", "t_n") >= F.greatest("q_n", "t_n") * exact)
    pairs = met.select("q_key", "t_key").distinct()
    pairs = pairs.join(asked.select("q_key", F.col("q_text").alias("query"), F.col("q_grams").alias("qt")), "q_key").join(held.select("t_key", F.col("t_text").alias("text"), F.col("t_grams").alias("tt")), "t_key")
    shared = F.size(F.array_intersect("qt", "tt"))
    return pairs.select("query", "text", F.round(shared / (F.size("qt") + F.size("tt") - shared), 4).alias("similarity")).where(F.col("similarity") >= threshold)
