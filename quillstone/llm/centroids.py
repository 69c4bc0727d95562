"""Exact centroid clustering over a VA-file: one-byte cells, distance intervals from lookup tables, few full vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from quillstone.llm._store import column, new_path, small_batches, written

WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Bits of a cell: one byte a dimension. Cells are as wide as one another within so many standard deviations of the mean.
BITS, DEVIATIONS = 8, 4
#: Bytes of vectors in a bucket of the stored table, and rows that a task works on at a time.
BUCKET_BYTES, SLICE = 128 << 20, 4096
#: Integer components beyond which squared distances may leave 64 bits.
LARGEST = 1 << 27


@dataclass
class Cells:
    """Each dimension's cells: 2^bits - 2 between ``low`` and ``low + wide``, the outer two reach to its least and greatest value."""

    least: np.ndarray
    most: np.ndarray
    low: np.ndarray
    wide: np.ndarray
    bits: int = BITS

    @classmethod
    def of(cls, n: int, total: np.ndarray, squares: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int = BITS) -> Cells:
        mean = total / n
        reach = DEVIATIONS * np.sqrt(np.maximum(0, squares / n - mean * mean))
        low = np.maximum(least, np.floor(mean - reach).astype(np.int64))
        return cls(least, most, low, np.maximum(1, np.minimum(most, np.ceil(mean + reach).astype(np.int64)) - low + 1), bits)

    def of_vectors(self, v: np.ndarray) -> np.ndarray:
        return np.clip(((v - self.low) << self.bits) // self.wide, 0, (1 << self.bits) - 1).astype(np.uint8)

    @cached_property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest integer of each dimension's cells: no vector has a component in a cell without any."""
        marks = -((-np.arange((1 << self.bits) + 1)[:, None] * self.wide) >> self.bits) + self.low
        first, last = marks[:-1].copy(), marks[1:] - 1
        first[0], last[-1] = self.least, self.most
        return first.T.copy(), np.maximum(first, last).T.copy()


class Tables:
    """For one set of centroids, what each cell of each dimension adds to the squared distance at least and at most."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.centroids, (first, last) = centroids, cells.ends
        below, above = first[:, :, None] - centroids.T[:, None, :], centroids.T[:, None, :] - last[:, :, None]
        near, far = np.maximum(0, np.maximum(below, above)), np.maximum(np.abs(below), np.abs(above))
        self.near, self.far = near * near, far * far
        self.middle, self.half = (first + last) / 2, (last - first) / 2
        self.squares = (centroids * centroids).sum(1)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Of each row of cells the centroids that may be the nearest: no other can be, whatever the vector.

        First those whose interval begins before another's end. Where several remain, each is held against the one that is
        nearest to the cells' middle: the difference of two distances is linear in the vector, so its interval is narrower.
        """
        least, most = np.zeros((len(cells), len(self.centroids)), np.int64), np.zeros((len(cells), len(self.centroids)), np.int64)
        for i in range(cells.shape[1]):
            least += self.near[i][cells[:, i]]
            most += self.far[i][cells[:, i]]
        found = least <= most.min(1)[:, None]
        (several,) = np.nonzero(found.sum(1) > 1)
        if len(several):
            at = np.arange(cells.shape[1])
            middle, half = self.middle[at, cells[several]], self.half[at, cells[several]]
            c = self.centroids.astype(float)
            best = (self.squares - 2 * middle @ c.T).argmin(1)
            for b in np.unique(best):
                (rows,) = np.nonzero(best == b)
                apart = c - c[b]
                low = self.squares - self.squares[b] - 2 * middle[rows] @ apart.T - 2 * half[rows] @ np.abs(apart).T
                found[several[rows]] &= low <= 0
        return found

    def nearest(self, v: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """The nearest centroid of each vector, of equal ones the first, among the candidates if given; exact."""
        if int(np.abs(v).max(initial=0)) ** 2 * v.shape[1] < 1 << 50:
            away = self.squares - 2 * v.astype(float) @ self.centroids.T.astype(float)
        else:
            away = np.stack([((v - c) ** 2).sum(1) for c in self.centroids], 1)
        return (away if among is None else np.where(among, away, away.max() + 1)).argmin(1)

    def decided(self, cells: np.ndarray) -> np.ndarray:
        """The nearest centroid where cells alone tell, else -1."""
        found = self.candidates(cells)
        return np.where(found.sum(1) == 1, found.argmax(1), -1)

    def assigned(self, cells: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Decided by cells; by full vectors where intervals overlap."""
        found = self.candidates(cells)
        out = found.argmax(1)
        (several,) = np.nonzero(found.sum(1) > 1)
        if len(several):
            out[several] = self.nearest(v[several], found[several])
        return out


def _ints(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _bytes(cells: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(-1, width)


def integers(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``id, v``: floor(scale * x) of each component, as double, of vectors with ``width`` finite components; others are dropped."""
    rows = df.select(column(id_col).alias("id"), column(vector_col).alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    kept = rows.where(F.col("v").isNotNull() & (F.size("v") == width)).where(finite)
    return kept.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("v"))


def _sums(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> dict[int, int]:
    """Sums over all rows of the integers that ``part`` makes of some: a task adds its own up, Spark those of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for begin in range(0, len(batch), SLICE):
                own = part(batch.slice(begin, SLICE))
                total = own if total is None else total + own
        if total is not None:
            (cell,) = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "value"])

    return dict(map(tuple, rows.mapInArrow(run, "cell int, value bigint").groupBy("cell").agg(F.sum("value")).collect()))


def _measured(rows: DataFrame, width: int) -> list[tuple]:
    """Of each dimension its number of vectors, sum, sum of squares, least and greatest component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v = _ints(batch.column(0), width)
                columns = [np.arange(width, dtype=np.int32), np.full(width, len(v)), v.sum(0).astype(float), (v.astype(float) ** 2).sum(0), v.min(0), v.max(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "n", "total", "squares", "least", "most"])

    each = rows.select("v").mapInArrow(run, "i int, n bigint, total double, squares double, least bigint, most bigint")
    found = each.groupBy("i").agg(F.sum("n"), F.sum("total"), F.sum("squares"), F.min("least"), F.max("most")).orderBy("i")
    return [tuple(r)[1:] for r in found.collect()]


def _stored(rows: DataFrame, cells: Cells, n: int) -> tuple[DataFrame, str]:
    """``key, id, v, cells`` in buckets by key, so that fetching vectors by key shuffles none of them; the table's name too."""
    spark, width = rows.sparkSession, len(cells.low)
    schema = StructType([*rows.schema.fields]).add("cells", "binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = cells.of_vectors(_ints(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in found], pa.binary())], names=schema.names)

    keyed = rows.mapInArrow(add, schema).select(F.monotonically_increasing_id().alias("key"), "id", F.transform("v", lambda c: c.cast("int")).alias("v"), "cells")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * 8 * width // BUCKET_BYTES))
    path = new_path(spark, "vafile")
    name = path.rpartition("/")[2].replace("-", "_")
    keyed.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
    return spark.table(name), name


def clustered(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector with ``width`` finite components.

    Integer k-means as of ``op13_centroids``: the ``k`` vectors of smallest sha256 of ``seed:id`` (null ids hash as ``seed:``,
    equal hashes follow their vectors) are the first centroids; each of ``rounds`` rounds assigns all vectors and takes
    floored means. The stored table has each vector's cells beside it. The first round and the last assignment read both.
    A round between reads cells alone, under the old centroids and the new: a vector that both place by cells, in the same
    cluster, changes no sum; the others' full vectors are fetched by key, and what moves is added to the sums and taken
    from them. Integers make that exact.

    Of what comes to the driver, all is bounded by k * width. Repeated rows count as often as they occur; other columns
    are dropped; fewer vectors than k are so many centroids; an empty table gives no rows. Components must stay within
    2^27 as integers, where squared distances fit 64 bits (ValueError).
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = integers(df, id_col=id_col, vector_col=vector_col, width=width, scale=scale)
    measured = _measured(rows, width)
    schema = StructType([rows.schema["id"]]).add("cluster", IntegerType()).add("distance", LongType())
    if not measured:
        return _digested(spark.createDataFrame([], schema), np.zeros((0, width), np.int64), id_col)
    n, total, squares, least, most = (np.array(c) for c in zip(*measured, strict=True))
    if max(-least.min(), most.max()) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} as integers")
    cells = Cells.of(int(n[0]), total, squares, least, most, bits)
    table, name = _stored(rows, cells, int(n[0]))
    try:
        first = table.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "v").limit(k)
        centroids = np.array([r["v"] for r in first.select("v").collect()], np.int64)
        before, sums = None, np.zeros((len(centroids), width + 1), np.int64)
        for _ in range(rounds):
            for cell, value in _moved(table, cells, before, centroids).items():
                sums[cell // (width + 1), cell % (width + 1)] += value
            before, full = centroids, sums[:, 0] > 0
            centroids = centroids.copy()
            centroids[full] = sums[full, 1:] // sums[full, :1]
        found = written(_placed(table, cells, centroids, schema), "clusters")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return _digested(found, centroids, id_col)


def _moved(table: DataFrame, cells: Cells, before: np.ndarray | None, now: np.ndarray) -> dict[int, int]:
    """What a round adds to each centroid's count (cell 0 of its width + 1) and component sums."""
    k, width = now.shape
    tables: dict[int, Tables] = {}  # in the worker: one for each set of centroids

    def of(which: int, centroids: np.ndarray) -> Tables:
        if which not in tables:
            tables[which] = Tables(cells, centroids)
        return tables[which]

    def tally(cluster: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros((k, width + 1), np.int64)
        np.add.at(out, cluster, np.column_stack([np.ones(len(v), np.int64), v]))
        return out.ravel()

    if before is None:

        def all_of(batch: pa.RecordBatch) -> np.ndarray:
            v = _ints(batch.column(1), width)
            return tally(of(0, now).assigned(_bytes(batch.column(0), width), v), v)

        return _sums(table.select("cells", "v"), all_of)

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), SLICE):
                part = batch.slice(begin, SLICE)
                own = _bytes(part.column(1), width)
                old, new = of(0, before).decided(own), of(1, now).decided(own)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array((old != new) | (new < 0)))], names=["key"])

    def changed(batch: pa.RecordBatch) -> np.ndarray:
        v = _ints(batch.column(0), width)
        old, new = of(0, before).nearest(v), of(1, now).nearest(v)
        moved = old != new
        return tally(new[moved], v[moved]) - tally(old[moved], v[moved])

    keys = table.select("key", "cells").mapInArrow(open_, "key bigint")
    return _sums(keys.join(table.select("key", "v"), "key").select("v"), changed)


def _placed(table: DataFrame, cells: Cells, centroids: np.ndarray, schema: StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(cells, centroids)
        for batch in batches:
            for begin in range(0, len(batch), SLICE):
                part = batch.slice(begin, SLICE)
                v = _ints(part.column(2), centroids.shape[1])
                cluster = tables.assigned(_bytes(part.column(1), centroids.shape[1]), v)
                away = v - centroids[cluster]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster.astype(np.int32)), pa.array((away * away).sum(1))], names=schema.names)

    return table.select("id", "cells", "v").mapInArrow(run, schema)


def _digested(found: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    spark = found.sparkSession
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, inertia.get(c), d) for c, d in enumerate(digest)], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    total: Column = F.lit(sum(inertia.values())).cast("bigint")
    # A row for each centroid: k is a parameter.
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 finite components in 40 clusters after five rounds, with exact distances and inertia."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    step = """
a{r} AS MATERIALIZED (
  SELECT n, vec_id, v, c, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY n ORDER BY distance, c) AS place FROM (
      SELECT kept.n, vec_id, kept.v, c{r}.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(kept.v, c{r}.v)])::BIGINT AS distance FROM kept CROSS JOIN c{r}
    )
  ) WHERE place = 1
)"""
    mean = """,
c{s} AS MATERIALIZED (
  SELECT c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT c, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY c, i
    ) GROUP BY c
  ) AS m USING (c)
),"""
    body = "".join(step.format(r=r) + (mean.format(r=r, s=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {WIDTH}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {k})
),{body}
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


QUERIES = {"op13_centroids": op13_centroids}
ORACLES = {"op13_centroids": _sql()}
