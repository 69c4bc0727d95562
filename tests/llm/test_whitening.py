import math

import numpy as np
import pytest

from quillstone.llm import whitening
from quillstone.llm.whitening import Spectrum


def shapes():
    rng = np.random.default_rng(12)
    d = 24
    plain = rng.normal(size=(300, d)) * rng.uniform(0.1, 100, d) + 1e5
    yield "plain", plain
    yield "copies", np.repeat(plain[:3], 100, 0)
    yield "flat", np.where(np.arange(d) < 10, plain, 7.0)
    yield "one direction", rng.normal(size=(300, 1)) * np.ones((1, d))
    yield "fewer than dimensions", plain[:10]
    yield "equal values", np.vstack([np.eye(d), -np.eye(d)] * 3)
    yield "two clusters", np.where(rng.random((300, 1)) < 0.3, 1e4, 0.0) + np.floor(plain / 50)
    yield "one", plain[:1]


@pytest.mark.parametrize("name, x", list(shapes()), ids=[n for n, _ in shapes()])
def test_updates_and_merges_give_the_scatter(name, x):
    parts = []
    for part in np.array_split(x, 3):
        parts.append(Spectrum.empty(x.shape[1]))
        for row in part:
            parts[-1].add(row)
    seen = parts[0]
    for other in parts[1:]:
        if other.n:
            seen.merge(other)
    away = x - x.mean(0)
    scatter = away.T @ away
    size = max(1.0, np.abs(scatter).max())
    assert seen.n == len(x) and np.allclose(seen.mean, x.mean(0), rtol=1e-12)
    assert np.abs(seen.values - np.linalg.eigvalsh(scatter)).max() < 1e-10 * size
    assert np.abs((seen.vectors * seen.values) @ seen.vectors.T - scatter).max() < 1e-10 * size
    assert np.abs(seen.vectors.T @ seen.vectors - np.eye(x.shape[1])).max() < 1e-11


def test_roots_of_the_secular_equation():
    rng = np.random.default_rng(5)
    for m in (1, 2, 5, 40):
        for spread in (1.0, 1e-7):
            d = np.sort(np.concatenate([rng.uniform(0, 1, m - m // 2), 0.5 + spread * rng.uniform(0, 1, m // 2)]))
            z2 = rng.uniform(0.01, 1, m)
            roots, apart = whitening.secular(d, z2, 0.3)
            want = np.linalg.eigvalsh(np.diag(d) + 0.3 * np.outer(np.sqrt(z2), np.sqrt(z2)))
            assert np.allclose(roots, want, atol=1e-13)
            assert np.allclose(apart, d - roots[:, None], atol=1e-13)
            assert (np.sign(apart) == np.where(np.tri(m) > 0, -1, 1)).all()


def brute(rows):
    """The contract by plain numpy and exact integers: kept ids, n, deviations, covariance and centred vectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(0)
    away = n * x - sums
    centred = (away / n).astype(float)
    return [i for i, _ in kept], n, [int((a * a).sum()) for a in away], centred.T @ centred / n, centred


def hold(found, rows, components=8):
    ids, n, deviation, covariance, centred = brute(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert len(found) == len(by) == len(ids) * components
    ours = np.array([[by[i, k + 1]["whitened"] for k in range(components)] for i in ids])
    theirs = centred @ vectors / np.sqrt(values)
    ours *= np.sign((ours * theirs).sum(0))
    assert np.abs(ours - theirs).max() < 1e-9
    for i, want in zip(ids, deviation, strict=True):
        for k in range(components):
            r = by[i, k + 1]
            assert (r["n"], r["deviation"]) == (n, want)
            assert r["explained"] == pytest.approx(values[k] / np.trace(covariance), rel=1e-10)
    (error,) = {r["identity_error"] for r in found}
    assert error < 1e-9


def test_the_query_against_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    hold(whitening.op12_whitening(spark, "/root/testdata/sf0.001").collect(), rows)


def test_many_tasks_and_dropped_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13)).tolist()) for i in range(400)]
    rows[5] = (5, None)
    rows[6] = (6, [*rows[6][1][:-1], None])
    rows[7] = (7, [*rows[7][1][:-1], float("nan")])
    rows[8] = (8, [float("-inf"), *rows[8][1][1:]])
    rows[9] = (9, [])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, x string, component int").repartition(40)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    hold(out.collect(), [r for r in rows if r[1] != []])


def test_odd_tables(spark):
    schema = "`a.b` string, v array<float>"
    frame = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema), id_col="a.b", vector_col="v").collect()
    assert frame([]) == [] and frame([("a", None)]) == [] and frame([("a", [1.0, 2.0])]) == []
    assert frame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])]) == []
    # Repeated rows and ids each have rows of their own; a vector of another length is dropped; one direction has one component.
    out = frame([("a", [1.0, 2.0]), ("a", [1.0, 2.0]), (None, [3.0, 4.0]), (None, [5.0, 6.0]), ("c", [9.0])])
    assert sorted((r["a.b"] or "", r["component"], r["n"]) for r in out) == [("", 1, 4), ("", 1, 4), ("a", 1, 4), ("a", 1, 4)]
    assert all(r["explained"] == pytest.approx(1) for r in out)
    assert sum(r["whitened"] ** 2 for r in out) == pytest.approx(4)


def test_a_deviation_beyond_64_bits_is_null(spark):
    n = 3
    rows = whitening.integers(spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "vec_id int, embedding array<double>"), scale=1 << 29, shift=0)
    model = whitening.fit(rows)
    out = {r["vec_id"]: r["deviation"] for r in whitening.whitened(rows, model, 0.0).collect()}
    want = {i: (n * c - 6) ** 2 << 58 for i, c in ((1, 0), (2, 1), (3, 5))}
    assert out == {i: w if w < 1 << 63 else None for i, w in want.items()} and None in out.values()
