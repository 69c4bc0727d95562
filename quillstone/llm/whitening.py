"""Whitening of embeddings: an incremental eigendecomposition by rank-one updates, refined by Rayleigh-Ritz."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from quillstone.llm._store import column, small_batches, written

COMPONENTS = 8
#: Spectra that one task combines.
FAN = 16
#: Steps of the secular equation's solver; it takes about six, and halves a bracket where a step would leave it.
STEPS = 80
#: What the equation may be off by, against the sum of its terms: the refinement that follows mends what adds up.
CLOSE = 1e-13
_EPS = np.finfo(float).eps


@cache
def _left(m: int) -> np.ndarray:
    return np.tri(m)


def secular(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - x)) = 0 for ascending, distinct d, and the distances d_j - root_i.

    Root i lies between poles i and i + 1, the last one beyond all. Each is found as a distance from the nearer pole, so
    that differences of close numbers stay exact; a step puts a rational function with the two poles on either side.
    """
    m, w = len(d), rho * z2
    rows = np.arange(m)
    width = np.append(np.diff(d), w.sum())
    middle = 1 + (w / (d - d[:, None] - width[:, None] / 2)).sum(1)
    right = (middle < 0) & (rows < m - 1)
    origin = rows + right
    apart = d - d[origin][:, None]
    low = np.where(right, -width / 2, np.where(middle < 0, width / 2, 0.0))
    high = np.where(right, 0.0, np.where(middle < 0, width, width / 2))
    x = np.where((w > low) & (w < high), w, (low + high) / 2)  # to first order a root moves by its own weight
    left = _left(m)
    next_pole = np.append(apart[rows[:-1], rows[1:]], np.inf)
    own_pole = apart[rows, rows]
    done = np.zeros(m, bool)
    for _ in range(STEPS):
        gap = 1 / (apart - x[:, None])
        term = w * gap
        below, all_ = np.einsum("ij,ij->i", term, left), term.sum(1)
        f = 1 + all_
        done |= np.abs(f) <= CLOSE * (1 + all_ - 2 * below)
        done |= high - low <= 2 * _EPS * np.abs(x)
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        term *= gap
        psi = np.einsum("ij,ij->i", term, left)
        phi = term.sum(1) - psi
        a, b = own_pole - x, next_pole - x
        with np.errstate(all="ignore"):
            c = f - a * psi - np.where(phi > 0, b * phi, 0.0)
            p, q = (a + b) * f - a * b * (psi + phi), a * b * f
            root = np.sqrt(np.abs(p * p - 4 * q * c))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step[-1] = a[-1] + a[-1] * a[-1] * psi[-1] / c[-1]
            new = x + step
        inside = (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return d[origin] + x, apart - x[:, None]


@dataclass
class Spectrum:
    """Count and mean of the vectors seen, and the eigenvalues (ascending) and eigenvectors of their centred scatter."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.zeros(width), np.eye(width))

    def update(self, v: np.ndarray, rho: float) -> None:
        """Add rho * v v^T to the scatter, rho not negative."""
        z = v @ self.vectors
        norm2 = float(z @ z)
        rho *= norm2
        if not rho > 0:
            return
        z = z / np.sqrt(norm2)
        d, vectors = self.values, self.vectors
        small = 8 * _EPS * max(abs(d[-1]), abs(d[0]), rho)
        # Deflation: a direction that the vector hardly has keeps its pair; of two close values one is turned away.
        (live,) = np.nonzero(rho * np.abs(z) > small)
        if len(live) > 1:
            one, two = z[live[:-1]], z[live[1:]]
            if np.any(np.diff(d[live]) * np.abs(one * two) <= small * (one * one + two * two)):
                live = self._turn(live, z, small)
        roots, apart = secular(d[live], z[live] ** 2, rho)
        m = len(live)
        # The vector for which these roots are exact: its eigenvectors are orthogonal however close the roots are.
        poles = d[live]
        ratio = -apart.T
        below = np.tri(m, k=-1, dtype=bool)[:, :-1]
        ratio[:, :-1] /= np.where(below, poles[:-1] - poles[:, None], poles[1:] - poles[:, None])
        exact = np.copysign(np.sqrt(np.abs(ratio.prod(1) / rho)), z[live])
        turned = exact[:, None] / apart.T
        turned /= np.sqrt((turned * turned).sum(0))
        d[live] = roots
        vectors[:, live] = vectors[:, live] @ turned
        order = np.argsort(d, kind="stable")
        if np.any(order[1:] < order[:-1]):
            self.values, self.vectors = d[order], vectors[:, order]

    def _turn(self, live: np.ndarray, z: np.ndarray, small: float) -> np.ndarray:
        d, vectors, kept = self.values, self.vectors, []
        last = live[0]
        for j in live[1:]:
            tau = np.hypot(z[last], z[j])
            c, s = z[j] / tau, -z[last] / tau
            if abs((d[j] - d[last]) * c * s) <= small:
                z[j], z[last] = tau, 0.0
                vectors[:, [last, j]] = vectors[:, [last, j]] @ np.array([[c, -s], [s, c]])
                d[last], d[j] = d[last] * c * c + d[j] * s * s, d[last] * s * s + d[j] * c * c
            else:
                kept.append(last)
            last = j
        return np.array([*kept, last])

    def add(self, x: np.ndarray) -> None:
        """See one more vector."""
        away = x - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        self.update(away, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        """See another's vectors: its eigenpairs are so many rank-one updates, and the means' difference one more."""
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(vector, float(value))
        n, away = self.n + other.n, other.mean - self.mean
        self.update(away, self.n * other.n / n)
        self.n, self.mean = n, self.mean + away * (other.n / n)


@dataclass
class Whitening:
    """Integer sums of ``n`` vectors, and the leading components of their covariance as columns."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * x - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ (self.components / np.sqrt(self.variances))


def integers(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``id, x``: floor(scale * c) + shift of each entry c, as double, of the vectors whose entries are all finite numbers.

    Null vectors, and those with a null, infinite or undefined entry, are dropped; so are empty ones and, as sums need one
    width, those of another length than most vectors have (of two as frequent, the longer). Entries must stay below 2^31
    as integers. Other columns are dropped.
    """
    rows = df.select(column(id_col).alias("id"), column(vector_col).alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    most = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.where(F.size("v") == (most["width"] if most else 0)).select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("bigint") + shift).alias("x"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows of what ``part`` makes of some of them: a task adds up its own, Spark those of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                own = part(_matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    cells = rows.select("x").mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(cells), np.int64 if kind == "bigint" else float)
    for cell, value in cells:
        out[cell] = value
    return out


_SPECTRUM = "n bigint, mean array<double>, `values` array<double>, vectors array<double>"


def _row(s: Spectrum) -> pa.RecordBatch:
    columns = [pa.array([s.n], pa.int64()), *(pa.array([a.ravel().tolist()], pa.list_(pa.float64())) for a in (s.mean, s.values, s.vectors))]
    return pa.RecordBatch.from_arrays(columns, names=["n", "mean", "values", "vectors"])


def _spectrum(n: int, mean: list[float], values: list[float], vectors: list[float]) -> Spectrum:
    return Spectrum(n, np.array(mean), np.array(values), np.array(vectors).reshape(len(values), len(values)))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = None
    for batch in batches:
        for x in _matrix(batch.column(0)).astype(float) if len(batch) else ():
            seen = seen or Spectrum.empty(len(x))
            seen.add(x)
    if seen:
        yield _row(seen)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seen:
                seen.merge(_spectrum(*row))
            else:
                seen = _spectrum(*row)
    if seen:
        yield _row(seen)


def spectrum(rows: DataFrame) -> Spectrum | None:
    """The spectrum of all vectors ``x``: one for each task, combined sixteen at a time; None without vectors."""
    found = written(rows.select("x").mapInArrow(_each, _SPECTRUM), "spectra")
    while (n := found.count()) > 1:
        found = written(found.repartition(-(-n // FAN)).mapInArrow(_merged, _SPECTRUM), "spectra")
    row = found.first()
    return _spectrum(*row) if row else None


def fit(rows: DataFrame, *, components: int = COMPONENTS) -> Whitening | None:
    """The ``components`` directions of largest variance of integer vectors ``x`` (as ``integers`` gives); None without any.

    The incremental spectrum gives a basis; the covariance in that basis, from vectors centred exactly before they are
    multiplied, is nearly diagonal, and its eigenvectors turn the basis into components to double precision. All passes
    are distributed, what comes to the driver is of the size of a covariance. Directions without variance have no
    component.
    """
    small_batches(rows.sparkSession)
    rough = spectrum(rows)
    if rough is None:
        return None
    n, *sums = _summed(rows, lambda x: np.concatenate([[len(x)], x.sum(0)]), "bigint").tolist()
    n, sums = int(n), np.array(sums, np.int64)
    basis = np.linalg.qr(rough.vectors[:, ::-1])[0]
    upper = np.triu_indices(len(sums))

    def squares(x: np.ndarray) -> np.ndarray:
        y = ((n * x - sums) / n) @ basis
        return (y.T @ y)[upper]

    square = np.zeros((len(sums), len(sums)))
    square[upper] = _summed(rows, squares, "double") / n
    square = np.triu(square) + np.triu(square, 1).T
    values, turned = np.linalg.eigh(square)
    values, turned = values[::-1], turned[:, ::-1]
    trace = float(np.trace(square))
    kept = min(components, int((values > len(sums) * _EPS * trace).sum()))
    return Whitening(n, sums, basis @ turned[:, :kept], values[:kept].copy(), trace)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, by its absolute value, of the whitened vectors' covariance minus the identity."""
    k = len(model.variances)

    def squares(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([model.whitened(x), np.ones(len(x))])
        return (w.T @ w).ravel()

    total = _summed(rows, squares, "double").reshape(k + 1, k + 1) / model.n
    return float(np.abs(total[:k, :k] - np.outer(total[:k, k], total[:k, k]) - np.eye(k)).max(initial=0.0))


def whitened(rows: DataFrame, model: Whitening, error: float, *, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector of ``rows`` (``id, x``) and component, numbered from 1 by falling variance.

    ``n`` vectors were fitted; ``deviation`` is the sum of (n * x - S)^2, exact, and null beyond 64 bits; ``whitened`` the
    centred vector's part along the component over the square root of its variance; ``explained`` the component's share of
    all variance; ``identity_error`` as given.
    """
    k, shares = len(model.variances), model.variances / model.trace if model.trace else model.variances
    schema = StructType([rows.schema["id"]]).add("component", IntegerType()).add("n", LongType()).add("deviation", LongType())
    for name in ("whitened", "explained", "identity_error"):
        schema = schema.add(name, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch) if k else 0, 4096):
                part = batch.slice(begin, 4096)
                x = _matrix(part.column(1))
                away = model.centred(x)
                if int(np.abs(away).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
                    deviation = pa.array((away * away).sum(1))
                else:
                    exact = [sum(int(a) ** 2 for a in row) for row in away]
                    deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
                row = pa.array(np.repeat(np.arange(len(part)), k))
                number = np.tile(np.arange(k), len(part))
                columns = [part.column(0).take(row), pa.array(number + 1, pa.int32()), pa.array(np.full(len(row), model.n)), deviation.take(row), pa.array(model.whitened(x).ravel()), pa.array(shares[number]), pa.array(np.full(len(row), error))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Fit on all vectors of a table and whiten them; rows as of ``whitened``.

    What ``integers`` drops has no rows. Repeated rows count as often as they occur, each with rows of its own; null ids
    are ids. An empty table, one vector or equal vectors only have no variance, hence no rows.
    """
    small_batches(df.sparkSession)
    rows = integers(df, id_col=id_col, vector_col=vector_col, scale=scale, shift=shift)
    model = fit(rows, components=components)
    if model is None:
        model = Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    return whitened(rows, model, identity_error(rows, model) if len(model.variances) else 0.0, id_col=id_col)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along their eight leading components, whitened; vectors without a finite number throughout are dropped."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
