import hashlib
import math

import duckdb
import numpy as np
import pytest

from quillstone.llm import centroids
from quillstone.llm.centroids import Cells, Tables


def brute(rows, k=40, rounds=5, width=64, scale=256, seed=2):
    """The contract in plain integers: id, cluster, distance, inertia of the cluster and of all, digest of the centroid."""
    kept = [(i, tuple(math.floor(scale * float(c)) for c in v)) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in kept[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda: [min(range(len(centres)), key=lambda c: (away(v, centres[c]), c)) for _, v in kept]
    for _ in range(rounds):
        own = place()
        for c in range(len(centres)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == c]:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = place()
    each = [away(v, centres[c]) for (_, v), c in zip(kept, own, strict=True)]
    inertia = [sum(d for d, o in zip(each, own, strict=True) if o == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(each), digest[c]) for (i, _), c, d in zip(kept, own, each, strict=True)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def vectors(kind, n, width, rng):
    if kind == "clusters":
        return rng.normal(size=(9, width))[rng.integers(0, 9, n)] + 0.1 * rng.normal(size=(n, width))
    if kind == "outlier":
        return np.where(np.arange(n)[:, None] == 3, 5000.0, rng.normal(size=(n, width)))
    if kind == "few values":
        return rng.integers(-1, 2, (n, width)) / 2.0
    return rng.normal(size=(n, width))


@pytest.mark.parametrize("kind", ["plain", "clusters", "outlier", "few values"])
@pytest.mark.parametrize("bits", [2, 4, 8])
def test_cells_never_exclude_the_nearest(kind, bits):
    rng = np.random.default_rng(bits)
    v = np.floor(40 * vectors(kind, 600, 10, rng)).astype(np.int64)
    cells = Cells.of(len(v), v.sum(0), (v * v).sum(0), v.min(0), v.max(0), bits)
    own, (first, last) = cells.of_vectors(v), cells.ends
    at = np.arange(10)
    assert (first[at, own] <= v).all() and (v <= last[at, own]).all()
    for centres in (v[:7], np.vstack([v[:3], v[:3], v[5:9] + 1])):
        tables = Tables(cells, centres)
        away = ((v[:, None] - centres) ** 2).sum(2)
        nearest = away.argmin(1)
        assert tables.candidates(own)[np.arange(len(v)), nearest].all()
        decided = tables.decided(own)
        assert (decided[decided >= 0] == nearest[decided >= 0]).all()
        assert (tables.assigned(own, v) == nearest).all() and (tables.nearest(v) == nearest).all()
    if bits == 8 and kind == "clusters":
        assert (Tables(cells, v[:7]).decided(own) >= 0).mean() > 0.8


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    v = rng.integers(-centroids.LARGEST, centroids.LARGEST, (50, 64))
    cells = Cells.of(len(v), v.sum(0), (v.astype(float) ** 2).sum(0), v.min(0), v.max(0))
    want = [min(range(9), key=lambda c: (sum((int(a) - int(b)) ** 2 for a, b in zip(x, v[c], strict=True)), c)) for x in v]
    assert Tables(cells, v[:9]).assigned(cells.of_vectors(v), v).tolist() == want


@pytest.mark.parametrize("kind", ["plain", "clusters", "few values"])
def test_clusters_are_the_contract_s(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(vectors(kind, 500, 8, rng).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(9)
    assert got(centroids.clustered(df, width=8, k=12)) == brute(rows, k=12, width=8)


def test_the_query_against_integers_and_sql(spark):
    table = "/root/testdata/sf0.001/embeddings.parquet"
    out = got(centroids.op13_centroids(spark, "/root/testdata/sf0.001"))
    assert out == brute([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(table).collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{table}'")
    assert out == sorted(con.execute(centroids.ORACLES["op13_centroids"]).fetchall(), key=str)


def test_odd_rows(spark):
    schema = "`vec.id` string, v array<float>, cluster int, id string"
    run = lambda rows, **o: got(centroids.clustered(spark.createDataFrame(rows, schema), id_col="vec.id", vector_col="v", width=2, **o))
    bad = [("n", None), ("s", [1.0]), ("l", [1.0, 2.0, 3.0]), ("x", [1.0, None]), ("y", [float("nan"), 1.0]), ("z", [1.0, float("inf")])]
    assert run([(*r, 7, "q") for r in bad]) == [] and run([]) == []
    # Copies, equal ids, a null id, ties and fewer vectors than centroids.
    good = [("a", [1.0, 1.0]), ("a", [1.0, 1.0]), ("a", [1.0, 1.5]), (None, [-1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0])]
    for k in (2, 3, 40):
        assert run([(*r, 7, "q") for r in good + bad], k=k) == brute(good, k=k, width=2)
    with pytest.raises(ValueError, match="beyond"):
        run([("a", [1e9, 0.0], 7, "q")])


def test_one_vector_may_be_most_of_the_table(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [0.25] * 8 if i % 3 else v) for i, v in enumerate(vectors("plain", 300, 8, rng).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    assert got(centroids.clustered(df, width=8, k=10)) == brute(rows, k=10, width=8)


def test_fetching_shuffles_no_vectors_and_tables_go(spark):
    plans = []
    original = centroids._sums

    def spy(rows, part):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return original(rows, part)

    centroids._sums = spy
    try:
        centroids.clustered(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    finally:
        centroids._sums = original
    assert len(plans) == centroids.ROUNDS
    for plan in plans[1:]:
        assert "Exchange hashpartitioning" not in plan.split("Join")[-1].split("FileScan")[-1]
        assert plan.count("Exchange hashpartitioning(key") <= 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("vafile")]
