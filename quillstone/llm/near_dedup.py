"""Near-duplicate documents: banded MinHash candidates, odd sketches to sift them, full shingle sets to confirm."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import _text
from quillstone.llm._pairs import Shingler, compared, plain_shingles
from quillstone.llm._store import small_batches, written
from quillstone.llm.components import components

#: A pair of similarity 0.8 shares none of 32 bands of 5 minima with probability (1 - 0.8^5)^32 < 4e-6.
BANDS, ROWS, SEED, LEAST_PERCENT = 32, 5, 90_071, 80
#: Bits of the odd sketch of a document's minima, and the estimate below which a pair is passed over: with 160 samples
#: a pair of similarity 0.8 comes out below 0.55 about once in 10^8 times.
SKETCH_BITS, SIFT = 1024, 0.55
#: Bits of the parity bitmap of a document's whole set, whose XOR can only understate a symmetric difference.
PARITY_BITS = 2048
#: Rows of a key in one block, and rows, as often as they meet others, that one task takes at a time.
BLOCK, GROUP = 1024, 8192


def _parities(rows: np.ndarray, places: np.ndarray, n: int, bits: int) -> np.ndarray:
    """``n`` parity bitmaps: each (row, place) flips a bit."""
    odd = (np.bincount(rows * bits + places, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1)


def odd_sketches(minima: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of each row's (sample, minimum) pairs."""
    n, k = minima.shape
    place = _text.mix64(minima.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << np.uint64(32))) & np.uint64(bits - 1)
    return _parities(np.repeat(np.arange(n), k), place.astype(np.int64).ravel(), n, bits)


def set_parities(values: np.ndarray, places: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    n = len(places) - 1
    place = _text.mix64(values ^ np.uint64(0x7C15D3A9E84B62F1)) & np.uint64(bits - 1)
    return _parities(np.repeat(np.arange(n), np.diff(places)), place.astype(np.int64), n, bits)


def most_odd_bits(similarity: float, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """The XOR population count at which two sketches' estimated similarity is this: J = 1 + bits/(4 samples) ln(1 - 2x/bits)."""
    return int(bits / 2 * (1 - np.exp(4 * samples * (similarity - 1) / bits)))


def possible_pairs(component: np.ndarray, n: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``left`` against rows of ``right`` in other components that may be similar enough.

    The estimate from the odd sketches passes what is clearly apart. Then the bitmaps of whole sets: with J >= p the
    symmetric difference is at most (1 - p) / (1 + p) of both sizes together, and no XOR has more bits than it; so a pair
    that is dropped there is not similar enough, for certain.
    """
    words, most = SKETCH_BITS // 64, most_odd_bits(SIFT * percent / 80)
    for begin in range(0, len(left), 64):
        rows = left[begin : begin + 64]
        i, j = np.nonzero((component[rows][:, None] < component[right]) & (np.minimum(n[rows][:, None], n[right]) * 100 >= np.maximum(n[rows][:, None], n[right]) * percent))
        for at in range(0, len(i), 1 << 16):
            a, b = rows[i[at : at + (1 << 16)]], right[j[at : at + (1 << 16)]]
            near = np.bitwise_count(sketch[a, :words] ^ sketch[b, :words]).sum(axis=1, dtype=np.int64) <= most
            a, b = a[near], b[near]
            apart = np.bitwise_count(sketch[a, words:] ^ sketch[b, words:]).sum(axis=1, dtype=np.int64)
            near = apart * (100 + percent) <= (100 - percent) * (n[a] + n[b])
            yield a[near], b[near]


def sketched(docs: DataFrame, *, id_col: str, text_col: str, shingler: Shingler) -> DataFrame:
    """``doc_id, n, h1, h2, keys, sketch`` of each row: shingles, a 128-bit hash of their set, band keys, both bitmaps."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _text.MinHash(BANDS * ROWS, SEED)
        for batch in batches:
            for begin, end, data, offsets in _text.text_chunks(batch.column(1)):
                values, places = _text.distinct(*shingler(data, offsets))
                n = np.diff(places)
                sums = [np.append(np.uint64(0), np.cumsum(_text.mix64(values ^ np.uint64(c)))) for c in (0x9D8A3C5B7E1F2647, 0x3B9F62D1A5C4E807)]
                h1, h2 = ((s[places[1:]] - s[places[:-1]]).view(np.int64) for s in sums)
                minima = hasher.signatures(values, places)
                key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(n), 0)
                for i in range(ROWS):
                    key = _text.mix64(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, i::ROWS].astype(np.uint64) + np.uint64(1))
                full = np.flatnonzero(n > 0)
                at_keys = np.zeros(len(n) + 1, np.int32)
                np.cumsum((n > 0) * BANDS, out=at_keys[1:])
                bits = np.concatenate([odd_sketches(minima), set_parities(values, places)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        pa.array(n, pa.int64()),
                        pa.array(h1),
                        pa.array(h2),
                        pa.ListArray.from_arrays(pa.array(at_keys), pa.array(key[full].ravel().view(np.int64))),
                        pa.array([b.tobytes() for b in bits], pa.binary()),
                    ],
                    names=["doc_id", "n", "h1", "h2", "keys", "sketch"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, "doc_id bigint, n bigint, h1 bigint, h2 bigint, keys array<bigint>, sketch binary")


def confirmed(pairs: DataFrame, docs: DataFrame, *, id_col: str, text_col: str, shingler: Shingler, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose full shingle sets have 100 * intersection >= percent * union."""
    return compared(pairs, docs, id_col=id_col, text_col=text_col, shingler=shingler).where(F.col("shared") * 100 >= F.col("joint") * percent).select("u", "v")


def meetings(rows: DataFrame) -> DataFrame:
    """The rows of each key dealt out to meet those of other components: ``task, meeting, first, second`` and their own columns.

    A key of at most BLOCK rows is one meeting. In a larger one the largest component and all the others are dealt into
    blocks apart, and each block of the others meets every block; the largest component never meets itself. Tasks are
    counted from the rows as dealt out, so that each gets about GROUP of them and no key is one task's.
    """
    of_component = rows.groupBy("key", "component").count()
    sizes = of_component.groupBy("key").agg(F.sum("count").alias("all"), F.max("count").alias("most"), F.max_by("component", F.struct("count", "component")).alias("main")).where(F.col("all") > BLOCK)
    few = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    sizes = written(sizes.select("key", "all", "most", "main", few.alias("few"), F.ceil(F.col("most") / BLOCK).cast("int").alias("many")), "sizes")
    more = sizes.agg(F.coalesce(F.sum((F.col("all") - F.col("most")) * (F.col("few") + F.col("many")) + F.col("most") * F.col("few") - F.col("all")), F.lit(0))).first()[0]
    tasks = max(1, -(-(rows.count() + more) // GROUP))
    dealt = rows.join(sizes.select("key", "main", "few", "many"), "key", "left")
    # Blocks of the others come first; a row of the largest component meets only these.
    mine = F.coalesce(F.col("component") == F.col("main"), F.lit(False))
    few, many = F.coalesce("few", F.lit(1)), F.coalesce("many", F.lit(0))
    block = F.when(mine, few + F.pmod(F.xxhash64("class"), many)).otherwise(F.pmod(F.xxhash64("class"), few)).cast("int")
    dealt = dealt.select("key", "class", "component", "n", "sketch", block.alias("block"), F.explode(F.sequence(F.lit(0), F.when(mine, few).otherwise(few + many) - 1)).alias("other"))
    met = dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("meeting"), (F.col("block") <= F.col("other")).alias("first"), (F.col("block") >= F.col("other")).alias("second"), "class", "component", "n", "sketch")
    return met.withColumn("task", F.pmod("meeting", F.lit(tasks)))


def across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u, v`` of possible links between components within a key's group: ``key, class, component, n, sketch``."""

    def pairs(table: pa.Table) -> pa.Table:
        table = table.sort_by("meeting")
        meeting, first, second, ids, component, n = (table[c].to_numpy() for c in ("meeting", "first", "second", "class", "component", "n"))
        sketch = np.frombuffer(b"".join(b.as_py() for b in table["sketch"]), np.uint64).reshape(len(table), -1)
        cuts = np.append(np.flatnonzero(np.append(True, meeting[1:] != meeting[:-1])), len(meeting))
        found = [np.empty((0, 2), np.int64)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.arange(begin, end)
            one, two = at[first[at]], at[second[at]]
            sides = [(one, two)] if (first[at] & second[at]).all() else [(one, two), (two, one)]
            for left, right in sides:
                for a, b in possible_pairs(component, n, sketch, left, right, percent):
                    found.append(np.column_stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]))
        rows = np.concatenate(found)
        return pa.table([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["u", "v"])

    return meetings(rows).groupBy("task").applyInArrow(pairs, "u bigint, v bigint").distinct()


def groups(members: DataFrame, confirm: Callable[[DataFrame], DataFrame], bitmaps: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``node, component`` of the classes with links: ``members`` has ``key, class, u``, ``u`` being the key's smallest class.

    ``confirm`` keeps of the pairs ``u, v`` those that are links, ``bitmaps`` gives ``class, n, sketch`` for at least the
    classes it is asked about, of whose keys some span several components once every class was tried against the smallest.
    """
    pairs = written(members.where("class <> u").select("u", F.col("class").alias("v")).distinct(), "pairs")
    links = written(confirm(pairs), "confirmed")
    first = components(links)

    placed = members.join(first.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("component", "class").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    met = placed.join(split, "key")
    open_rows = written(met.join(bitmaps(met.select("class")), "class"), "open")
    more = written(across(open_rows, percent), "pairs")
    return first if more.isEmpty() else components(links.unionByName(confirm(more)))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row: groups of documents linked by near-equal shingle sets.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set has the distinct runs of ``k`` words, or the whole
    sequence of a shorter text. Null, empty and wordless texts have no set and link with nothing; a row with a null id
    links with nothing, has a null component and is kept. Rows that share an id are one document. The bands are made for
    80 % and find more above; a lower ``percent``, at which they would miss pairs, is refused.

    1. Documents with equal sets are one class, named by its smallest id; only classes go on.
    2. Classes that share a band's key are candidates. In each key's group every class is tried against the smallest
       one, never every pair; links are confirmed on full sets, and groups of links become components.
    3. Where a key's group still spans several components, pairs across components whose sizes and bitmaps allow the
       similarity are confirmed as well. Pairs within a component could add no link that matters.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent lies between {LEAST_PERCENT}, which the bands are made for, and 100")
    small_batches(docs.sparkSession)
    names = {"id_col": id_col, "text_col": text_col, "shingler": partial(plain_shingles, k=k)}
    sketches = written(sketched(docs, **names), "sketches")
    sets = sketches.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("class")), "classes")
    own = sets.join(classes.withColumnRenamed("class", "doc_id"), ["h1", "h2", "doc_id"])
    grouped = own.select(F.explode("keys").alias("key"), F.col("doc_id").alias("class"))
    shared = grouped.groupBy("key").agg(F.min("class").alias("u"), F.max("class").alias("last")).where("u <> last").drop("last")
    members = written(grouped.join(shared, "key").select("key", "class", "u"), "bands")
    found = groups(members, lambda pairs: confirmed(pairs, docs, **names, percent=percent), lambda _: own.select(F.col("doc_id").alias("class"), "n", "sketch"), percent)

    whole = sketches.join(classes, ["h1", "h2"], "left").join(found.withColumnRenamed("node", "class"), "class", "left")
    component = F.when((F.col("n") > 0), F.coalesce("component", "class")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group by word pairs; null and empty texts are alone."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=2)


QUERIES = {"op10_near_duplicates": op10_near_duplicates}
ORACLES: dict[str, str] = {}
