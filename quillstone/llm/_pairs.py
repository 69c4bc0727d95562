"""Exact comparison of candidate pairs of documents on their whole shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _text
from quillstone.llm._store import written

#: Slots that candidate ids are hashed into to keep other texts from being shuffled; bounds what is broadcast for it.
SLOTS = 1 << 20
#: Members that one task compares with a centre's text before the centre is dealt out again.
FAN = 256

#: Shingle hashes and places of a slice of texts, from their bytes and offsets.
Shingler = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def plain_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = _text.words(data, offsets)
    return _text.shingles(_text.word_hashes(data, starts, ends), at, k)


def among(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose ``doc`` falls into the slot of one that is wanted: at most SLOTS numbers are broadcast."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS)).alias("slot")
    return texts.withColumn("slot", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")


def compared(pairs: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, shingler: Shingler) -> DataFrame:
    """``u, v, shared, joint`` of the pairs whose shingle sets share something: sizes of intersection and union.

    Pairs are laid out by ``u``, whose text comes first and is compared with each ``v`` that follows; a ``u`` of many
    partners is dealt out several times, so that no task gets them all.
    """
    # Written, so that its size is known: a short list is broadcast, and no task gets all pairs of a large family.
    many = written(pairs.groupBy("u").count().where(F.col("count") > FAN).select("u", F.ceil(F.col("count") / FAN).alias("deals")), "large-fans")
    dealt = pairs.join(many, "u", "left").select("u", "v", F.when(F.col("deals").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("v"), F.col("deals"))).alias("deal"))
    rows = dealt.select("u", "deal", F.lit(1).alias("place"), F.col("v").alias("doc")).union(dealt.select("u", "deal", F.lit(0), F.col("u")).distinct())
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    texts = among(texts, rows)  # before they are shuffled
    laid = rows.join(texts, "doc").select("u", "deal", "place", "doc", "text").repartition("u", "deal").sortWithinPartitions("u", "deal", "place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, members = None, np.empty(0, np.uint64)
        for batch in batches:
            u, place, doc = (batch.column(i).to_numpy() for i in (0, 2, 3))
            out: list[tuple[int, int, int, int]] = []
            for begin, _, data, offsets in _text.text_chunks(batch.column(4)):
                values, places = shingler(data, offsets)
                for i in range(len(offsets) - 1):
                    own, row = np.unique(values[places[i] : places[i + 1]]), begin + i
                    if place[row] == 0:
                        centre, members = u[row], own
                        continue
                    shared = len(np.intersect1d(members, own, assume_unique=True)) if centre == u[row] else 0
                    if shared:
                        out.append((int(u[row]), int(doc[row]), shared, len(own) + len(members) - shared))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["u", "v", "shared", "joint"])

    return laid.mapInArrow(compare, "u bigint, v bigint, shared bigint, joint bigint")
