import random
import re

import numpy as np
import pytest

from quillstone.llm import near_dedup
from quillstone.llm.components import components


def brute(rows, k, percent=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if None not in (i, j) and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=str)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("k", "block", "group"), [(2, 1024, 8192), (5, 4, 10)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, k, block, group):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "GROUP", group)
    rng = random.Random(k)
    rows, n = [], 0
    for family in range(6):
        base = [f"f{family}x{rng.randrange(60)}" for _ in range(rng.choice([12, 60, 120]))]
        for _ in range(25):
            rows.append((n, edited(rng, base, rng.randrange(0, max(2, len(base) // (5 * k))))))
            n += rng.randrange(1, 4)
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "Solo"), (904, "solo"), (905, "solo"), (905, "solo"), (None, "solo"), (906, "long " * 9000), (907, "LONG " * 9000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, component_id string, n int")
    got = near_dedup.near_duplicates(df, k=k).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == brute(rows, k)


def test_rows_of_a_large_key_meet_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "GROUP", 64)
    # Key 1: one component of 1,500 rows and three outliers; key 2: 200 rows of two components; key 3: a small one.
    rows = [(1, i, 0 if i < 1500 else i) for i in range(1503)] + [(2, i, i % 2) for i in range(200)] + [(3, i, i) for i in range(9)]
    df = spark.createDataFrame([(*r, 5, bytes(384)) for r in rows], "key bigint, class bigint, component bigint, n bigint, sketch binary")
    met = near_dedup.meetings(df).select("task", "meeting", "first", "second", "class", "component").collect()
    sizes = np.bincount([r["task"] for r in met])
    assert len(met) < 2 * 1503 + 200 * 14 + 9 and sizes.max() < 6 * 64
    halls = {}
    for r in met:
        halls.setdefault(r["meeting"], []).append(r)
    together = {(a["class"], b["class"]) for h in halls.values() for a in h if a["first"] for b in h if b["second"]}
    for _, i, c in rows:
        for _, j, d in [r for r in rows if r[0] == 1 and r[1] >= 1500] if i >= 200 else []:
            assert c == d or (i, j) in together or (j, i) in together
    assert all((i, j) in together or (j, i) in together for i in range(0, 200, 2) for j in range(1, 200, 2))


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dedup.near_duplicates(df).count() == 0
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(df, percent=60)


def test_no_possible_pair_is_passed_over():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[rng.choice(400, rng.integers(0, 90), replace=False)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        sets.append(np.unique(own))
    places = np.cumsum([0, *map(len, sets)])
    values = np.concatenate(sets)
    minima = near_dedup._text.MinHash(near_dedup.BANDS * near_dedup.ROWS, 1).signatures(values, places)
    sketch = np.concatenate([near_dedup.odd_sketches(minima), near_dedup.set_parities(values, places)], axis=1).view(np.uint64)
    n, ids = np.diff(places), np.arange(len(sets))
    got = {(int(a), int(b)) for left, right in near_dedup.possible_pairs(ids, n, sketch, ids, ids, 80) for a, b in zip(left, right, strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 80 * (n[i] + n[j] - shared):
                assert (j, i) in got


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, i) for i in range(201, 240)] + [(300, 300), (None, 4), (500, 400), (450, 400), (450, 451)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[i] for i in range(200, 240)} == {200}
    assert {got[i] for i in (400, 450, 451, 500)} == {400} and 300 not in got
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
