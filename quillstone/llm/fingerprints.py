"""Document fingerprints: MinHash over word shingles, banded candidates joined in Spark, Jaccard verified."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import _text, near_dedup
from quillstone.llm._pairs import among
from quillstone.llm._store import column, small_batches, written

PERMUTATIONS, SEED, SHINGLE = 64, 20_240_607, 5
#: Texts are laid out in runs of ids of about this many bytes, each of which one task reads in order of id; and the most
#: runs of a table, which then grow instead (1.5 GB each at 100 TB): they bound what the driver and a broadcast hold.
RUN_BYTES, MOST_RUNS = 16 << 20, 1 << 16
#: Rows of one id and text beyond which they are laid out as one row with a count.
HOT_COPIES = 4096
#: What percentage of the shingles of either text near texts share.
NEAR_PERCENT = 80
#: The probability with which a pair right at the threshold may share no band.
MISSED = 0.001
_PAD = np.uint64(0x5851F42D4C957F2D)


def padded(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k - 1 pads before each text's words, so that short texts, too, share shingles with what begins like them."""
    n = np.diff(at)
    some = np.where(n > 0, k - 1, 0)
    places = np.zeros(len(at), np.int64)
    np.cumsum(n + some, out=places[1:])
    out = np.full(int(places[-1]), _PAD, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(places[:-1] + some - at[:-1], n)] = hashes
    return out, places


def text_shingles(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, shingle hashes, places) of a text column."""
    for begin, end, data, offsets in _text.text_chunks(column):
        starts, ends, at = _text.words(data, offsets)
        yield begin, end, *_text.shingles(*padded(_text.word_hashes(data, starts, ends), at, k), k)


def signatures(column: pa.Array, permutations: int = PERMUTATIONS, k: int = SHINGLE) -> np.ndarray:
    """A row of ``permutations`` 32-bit minima for each text; all ones without a word."""
    hasher = _text.MinHash(permutations, SEED)
    out = np.empty((len(column), permutations), np.uint32)
    for begin, end, values, places in text_shingles(column, k):
        out[begin:end] = hasher.signatures(values, places)
    return out


def hexes(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in np.ascontiguousarray(rows.astype(">u4"))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal minima, which estimates the Jaccard similarity of the shingle sets."""
    return (a == b).mean(axis=1)


def fingerprinted(docs: DataFrame, *, text_col: str = "text", permutations: int = PERMUTATIONS, k: int = SHINGLE) -> DataFrame:
    """The rows with ``fingerprint`` (binary, 4 bytes a permutation) added, a column of that name being replaced.

    Null and empty texts have all ones; repeated rows have equal fingerprints each; an empty table gives no rows.
    """
    from pyspark.sql.types import BinaryType, StructType

    kept = [c for c in docs.columns if c != "fingerprint"]
    docs = docs.select(*(column(c) for c in kept))
    at = kept.index(text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r.tobytes() for r in signatures(batch.column(at), permutations, k).astype(">u4")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*kept, "fingerprint"])

    return docs.mapInArrow(sign, StructType([*docs.schema.fields]).add("fingerprint", BinaryType()))


def banding(threshold: float) -> tuple[int, int]:
    """Bands and rows of each: the longest rows of the permutations, or of more single ones, that miss at most MISSED."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies above 0, and is 1 at most")
    for rows in (8, 4, 2, 1):
        if (1 - threshold**rows) ** (PERMUTATIONS // rows) <= MISSED:
            return PERMUTATIONS // rows, rows
    return math.ceil(math.log(MISSED) / math.log1p(-threshold)), 1


def copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, representative`` of each row with a text: the smallest id of those with an equal text."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("h"))
    return rows.join(rows.groupBy("h").agg(F.min("id").alias("representative")), "h").select("id", "representative")


def similar(queries: DataFrame, corpus: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int | None = None, k: int = SHINGLE) -> DataFrame:
    """Pairs (query_id, id, jaccard) whose shingle sets are at least ``threshold`` alike, for a stated set of queries.

    Signatures' bands, by default as many as the threshold needs, are joined on equal keys; each candidate is verified
    on both whole texts. Equal texts of the corpus are represented by their smallest id, and queries likewise (see
    ``copies``); a query's own text is represented by the smallest id that is not the query's. Texts without words are
    like nothing.
    """
    bands, rows = banding(threshold) if bands is None else (bands, PERMUTATIONS // bands)

    def texts(df: DataFrame, name: str, h: str) -> DataFrame:
        """One row of each distinct text with a word."""
        one = df.where(F.col(text_col).isNotNull()).groupBy(F.sha2(text_col, 256).alias(h)).agg(F.min(id_col).alias(name), F.first(text_col).alias("text"))
        return one.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))

    def banded(one: DataFrame, name: str, h: str) -> DataFrame:
        keys = F.array(*(F.substring("fingerprint", i * rows * 4 + 1, rows * 4) for i in range(bands)))
        return fingerprinted(one, permutations=bands * rows, k=k).select(h, name, F.posexplode(keys).alias("band", "key"))

    asked, held = texts(queries, "query_id", "hq"), texts(corpus, "id", "hc")
    pairs = banded(asked, "query_id", "hq").join(banded(held, "id", "hc"), ["band", "key"]).where("hq <> hc AND query_id <> id").select("hq", "hc", "query_id", "id").distinct()
    both = pairs.join(held.select("hc", F.col("text").alias("b")), "hc").join(asked.select("hq", F.col("text").alias("a")), "hq")
    others = corpus.where(F.col(text_col).isNotNull()).select(F.sha2(text_col, 256).alias("hq"), F.col(id_col).alias("id"))
    equal = others.join(asked.select("hq", "query_id"), "hq").where("query_id <> id").groupBy("query_id").agg(F.min("id").cast("bigint").alias("id"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.unique(v[p[i] : p[i + 1]]) for _, _, v, p in text_shingles(batch.column(c), k) for i in range(len(p) - 1)] for c in (2, 3)]
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
            jaccard = [s / max(1, len(x) + len(y) - s) for s, x, y in zip(shared, *sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(jaccard, pa.float64())], names=["query_id", "id", "jaccard"])

    return both.select("query_id", "id", "a", "b").mapInArrow(verify, "query_id bigint, id bigint, jaccard double").where(F.col("jaccard") >= threshold).unionByName(equal.withColumn("jaccard", F.lit(1.0)))


def _shingles_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = _text.words(data, offsets)
    return _text.shingles(*padded(_text.word_hashes(data, starts, ends), at, k), k)


def signed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = SHINGLE) -> DataFrame:
    """``doc_id, tie, size, digest, keys`` of each row, a written table.

    ``tie`` is a hash of the text, which rows of one id are ordered by, ``size`` its bytes; ``digest`` a hash of the set of
    its shingles, ``keys`` those of its bands. Null and empty texts, and texts without words, have no keys.
    """
    bands, rows = banding(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _text.MinHash(bands * rows, SEED)
        for batch in batches:
            for begin, end, values, places in text_shingles(batch.column(3), k):
                values, places = _text.distinct(values, places)
                minima = hasher.signatures(values, places).astype(np.uint64)
                digest = np.zeros(end - begin, np.uint64)
                some = np.flatnonzero(np.diff(places) > 0)
                if len(some):
                    digest[some] = np.add.reduceat(_text.mix64(values ^ _PAD), places[:-1][some])
                key = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], end - begin, 0)
                for i in range(rows):
                    key = _text.mix64(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, i::rows] + np.uint64(1))
                full = np.diff(places) > 0
                at = np.zeros(end - begin + 1, np.int32)
                np.cumsum(full * bands, out=at[1:])
                keys = pa.ListArray.from_arrays(pa.array(at), pa.array(key[full].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, end - begin) for i in range(3)), pa.array(digest.view(np.int64)), keys], names=["doc_id", "tie", "size", "digest", "keys"])

    text = F.coalesce(column(text_col), F.lit(""))
    rows_in = docs.select(column(id_col).cast("bigint").alias("doc_id"), _tie(text).alias("tie"), F.octet_length(text).cast("bigint").alias("size"), text.alias("text"))
    return written(rows_in.mapInArrow(sign, "doc_id bigint, tie bigint, size bigint, digest bigint, keys array<bigint>"), "signed")


def _tie(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def linked(docs: DataFrame, sketches: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = NEAR_PERCENT, k: int = SHINGLE) -> DataFrame:
    """``doc_id, near_class`` of documents that links lead to a smaller id from: the smallest one reachable.

    Texts are linked whose shingle sets are at least ``percent`` alike, verified on both whole texts; ``sketches`` is what
    ``signed`` gave for this threshold. Documents of equal sets are linked. The rest share a band with what they are linked
    to, but for a pair right at 0.8 in 4,500: each is tried against the smallest one of each of its bands, and where a band's
    group is then of several components, all pairs across these whose bitmaps don't show that they are apart. Pairs within
    a component would change no class. Null ids are linked with nothing. Ids should be those of one text: rows that share one
    get the smallest of their classes, and links of all but one of their texts may be missed.
    """
    names = {"id_col": id_col, "text_col": text_col, "shingler": partial(_shingles_of, k=k)}
    rows = sketches.where("doc_id IS NOT NULL AND size(keys) > 0")
    classes = written(rows.groupBy("digest").agg(F.min("doc_id").alias("class"), F.first("keys").alias("keys")), "near-classes")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = classes.select("class", F.explode("keys").alias("key")).repartition(tasks, "key")
    shared = keyed.groupBy("key").agg(F.min("class").alias("u"), F.max("class").alias("last")).where("u <> last").drop("last")
    members = written(keyed.join(shared, "key").select("key", "class", "u"), "near-bands")

    def bitmaps(open_: DataFrame) -> DataFrame:
        texts = docs.select(column(id_col).cast("bigint").alias("doc"), column(text_col).alias("text")).where("text IS NOT NULL")
        return near_dedup.sketched(among(texts, open_.select(F.col("class").alias("doc"))), id_col="doc", text_col="text", shingler=names["shingler"]).select(F.col("doc_id").alias("class"), "n", "sketch")

    found = near_dedup.groups(members, lambda pairs: near_dedup.confirmed(pairs, docs, **names, percent=percent), bitmaps, percent)
    named = classes.select("digest", "class").join(found, F.col("class") == F.col("node"), "left").select("digest", F.coalesce("component", "class").alias("near_class"))
    return rows.select("doc_id", "digest").join(named, "digest").where("near_class <> doc_id").groupBy("doc_id").agg(F.min("near_class").alias("near_class"))


def _units(facts: DataFrame, size: int, run_bytes: int) -> tuple[list[float], DataFrame]:
    """Where runs are cut, and the ids that fill several runs, with the number of parts that they are dealt into."""
    runs = min(MOST_RUNS, max(1, -(-size // run_bytes)))
    run_bytes = max(run_bytes, -(-size // runs))
    hot = written(facts.groupBy("doc_id").agg(F.sum("size").alias("size")).where(F.col("size") > run_bytes).select("doc_id", F.ceil(F.col("size") / run_bytes).alias("parts")), "hot-ids")
    cuts: set[float] = set()
    if runs > 1:
        ranged = facts.where("doc_id IS NOT NULL").select("doc_id").repartitionByRange(runs, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"))
        cuts = {float(r["low"]) for r in ranged.collect()}
        for r in hot.where("doc_id IS NOT NULL").collect():
            cuts |= {float(r["doc_id"]), math.nextafter(float(r["doc_id"]), math.inf)}
    return sorted(cuts), hot


def with_edits(docs: DataFrame, facts: DataFrame | None = None, near: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document's.

    The next document follows in descending id order (nulls last, ties by a hash of the text, then the text); after the
    last comes the first. The edited text has its last floor(n/2) code points replaced by the first as many (or all) of
    the next document's. A single row is its own next document; repeated rows are each other's. Texts move once: runs of
    ids, and parts of an id that fills several runs, are dealt to tasks, and each also gets the first row of the one
    after it, so that every row finds its next one in its own task. ``facts`` is what ``signed`` gave, if it is at hand;
    ``near`` is what ``linked`` gave, whose rows go to the same tasks: ``near_class`` is added, the own id where it gave none.
    """
    from pyspark.ml.feature import Bucketizer  # takes tens of MB, which other operators' drivers and workers need not hold

    spark = docs.sparkSession
    small_batches(spark)
    facts = (signed(docs, id_col=id_col, text_col=text_col) if facts is None else facts).select("doc_id", "tie", "size")
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).cast("bigint").alias("doc_id"), text.alias("text")).select("doc_id", _tie(F.col("text")).alias("tie"), "text", F.lit(1).cast("bigint").alias("copies"))
    size = facts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts, hot = _units(facts, size, run_bytes)
    several = hot.where("parts > 1")
    splits = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_id", outputCol="_run") if cuts else None

    def placed(df: DataFrame) -> DataFrame:
        """With ``run`` and ``part``, in descending order of ids; nulls are the last run."""
        df = df.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
        run = F.lit(len(cuts)) - F.col("_run") if splits else F.lit(0)
        df = (splits.transform(df) if splits else df).withColumn("run", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(run).cast("int"))
        if any_several:
            parts = several.select(F.col("doc_id").alias("hot_id"), "parts")
            df = df.join(F.broadcast(parts), F.col("doc_id").eqNullSafe(F.col("hot_id")), "left").withColumn("part", F.coalesce(F.shiftright(F.shiftright("tie", 32) * F.col("parts"), 31), F.lit(0)).cast("int"))
        else:
            df = df.withColumn("part", F.lit(0))
        return df.drop("_id", "_run", "hot_id", "parts")

    any_several = not several.isEmpty()
    repeated = written(facts.groupBy("doc_id", "tie").count().where(F.col("count") > HOT_COPIES).select(F.col("doc_id").alias("r_id"), F.col("tie").alias("r_tie")), "repeated")
    if not repeated.isEmpty():
        both = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tie") == F.col("r_tie"))
        one = rows.join(repeated, both, "left_semi").groupBy("doc_id", "tie", "text").agg(F.sum("copies").alias("copies"))
        rows = rows.join(repeated, both, "left_anti").unionByName(one)

    # One row for each unit, of which there are about MOST_RUNS at most: small enough for one window and a broadcast.
    heads = written(placed(facts).groupBy("run", "part").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("k"), "tie")).alias("head")), "heads")
    w = Window.orderBy("run", "part")
    ends = heads.agg(F.max(F.struct("run", "part")).alias("end"))
    before = F.lag(F.struct("run", "part")).over(w)
    heads = heads.withColumn("before", before).withColumn("one", F.lit(1)).join(F.broadcast(ends.withColumn("one", F.lit(1))), "one").select(F.bitwise_not("head.k").alias("head_id"), F.col("head.tie").alias("head_tie"), F.coalesce("before", "end").alias("before"))
    units = heads.count()

    own = placed(rows).select("run", "part", F.lit(0).alias("ahead"), "doc_id", "tie", "text", "copies")
    first = own.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")), "left")
    at = F.array(F.struct("run", "part", F.lit(0).alias("ahead")))
    at = F.when(F.col("before").isNull(), at).otherwise(F.concat(at, F.array(F.struct("before.run", "before.part", F.lit(1).alias("ahead")))))
    laid = first.select(F.explode(at).alias("at"), "doc_id", "tie", "text", "copies").select("at.run", "at.part", "at.ahead", "doc_id", "text", "tie", "copies", F.lit(None).cast("bigint").alias("near_class"))
    if near is not None:  # a row without copies comes before its document's own
        notes = placed(near.withColumn("tie", F.lit(0).cast("bigint")))
        if any_several:
            notes = notes.join(F.broadcast(several.select("doc_id", "parts")), "doc_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)).cast("int") - 1)))
        laid = laid.unionByName(notes.select("run", "part", F.lit(0).alias("ahead"), "doc_id", F.lit("").alias("text"), F.lit(-1).cast("bigint").alias("tie"), F.lit(0).cast("bigint").alias("copies"), "near_class"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // 4))
    laid = laid.repartition(tasks, "run", "part").sortWithinPartitions("run", "part", "ahead", F.desc_nulls_last("doc_id"), "tie", "text")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, whose next one is still to come
        note: tuple[int, int] | None = None
        for batch in batches:
            batch, note = _noted(batch, note)
            for begin, end in _text.row_slices(batch.column(4)):
                part = batch.slice(begin, end - begin)
                table = pa.concat_batches([held, part]) if held is not None else part
                yield from _edited(table)
                held = table.slice(len(table) - 1)

    kind = "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_class bigint"
    edits = laid.mapInArrow(edit, kind)
    return edits.withColumn("near_class", F.coalesce("near_class", "doc_id")) if near is not None else edits.drop("near_class")


def _noted(batch: pa.RecordBatch, note: tuple[int, int] | None) -> tuple[pa.RecordBatch, tuple[int, int] | None]:
    """The batch without notes, each given to the rows of its document that follow it, and the last note."""
    is_note = batch.column(6).to_numpy() == 0
    if note is None and not is_note.any():
        return batch, None
    valid, ids = batch.column(3).is_valid().to_numpy(zero_copy_only=False), batch.column(3).fill_null(0).to_numpy()
    last = np.maximum.accumulate(np.where(is_note, np.arange(len(batch)), -1))
    near = batch.column(7).to_pylist()
    given: list[int | None] = []
    for i in np.flatnonzero(~is_note):
        m = last[i]
        own = (ids[m], near[m]) if m >= 0 else note
        given.append(own[1] if own and valid[i] and own[0] == ids[i] else None)
    if last[-1] >= 0:
        note = (ids[last[-1]], near[last[-1]])
    rows = batch.filter(pa.array(~is_note))
    return pa.RecordBatch.from_arrays([*rows.columns[:7], pa.array(given, pa.int64())], names=batch.schema.names), note


def _edited(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows but the last one, each with the row that follows it; a unit's copy of the next one's head is no row.

    A row that stands for several gives all but one of them with itself as the next.
    """
    texts, ahead, copies = table.column(4).to_pylist(), table.column(2).to_numpy(), table.column(6).to_numpy()
    own = signatures(table.column(4))
    rows = np.flatnonzero(ahead[:-1] == 0)
    yield _pairs_of(table, texts, own, rows, rows + 1)
    # The last row of the table comes again as the first of the next one, and is counted there.
    for i in np.flatnonzero((ahead[:-1] == 0) & (copies[:-1] > 1)):
        step = max(1, min(1024, (1 << 22) // max(1, len(texts[i]))))
        for left in range(int(copies[i]) - 1, 0, -step):
            again = np.full(min(step, left), i)
            yield _pairs_of(table, texts, own, again, again)


def _pairs_of(table: pa.RecordBatch, texts: list[str], own: np.ndarray, rows: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    edits = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for i, j in zip(rows, after, strict=True)]
    column = pa.array(edits, pa.string())
    new = signatures(column)
    return pa.RecordBatch.from_arrays(
        [
            table.column(3).take(pa.array(rows)),
            pa.array([len(texts[i]) for i in rows], pa.int64()),
            column,
            pa.array(hexes(own[rows]), pa.string()),
            pa.array(hexes(new), pa.string()),
            pa.array(likeness(own[rows], new), pa.float64()),
            pa.array(likeness(own[rows], own[after]), pa.float64()),
            table.column(7).take(pa.array(rows)),
        ],
        names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_class"],
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint beside its edited text's and the next one's, and its class: the smallest document that
    links between texts of similarity 0.8 or more lead to. Null and empty texts are linked with none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sketches = signed(docs)
    near = written(linked(docs, sketches), "near")
    edits = with_edits(docs, sketches, near)
    return edits.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_class")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLES: dict[str, str] = {}
