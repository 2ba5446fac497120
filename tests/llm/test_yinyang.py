"""Yinyang clustering against plain k-means over integers, and what the bounds save."""

import hashlib

import numpy as np
import pytest

from threadwell.llm import yinyang

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=8, rounds=10, dims=64, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)))
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1].astype("<i4").tobytes()))[:k]]
    for _ in range(rounds):
        of = [min(range(len(c)), key=lambda j: (int(((v - c[j]) ** 2).sum()), j)) for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if mine:
                c[j] = np.array([int(s) // len(mine) for s in np.sum(mine, axis=0)])
    return sorted((i, *min((int(((v - c[j]) ** 2).sum()), j) for j in range(len(c)))[::-1]) for i, v in kept if i is not None), c


@pytest.mark.parametrize(("n", "spread", "groups"), [(300, 0.05, None), (300, 0.5, 1), (200, 0.02, 4), (5, 0.1, None)])
def test_same_as_plain(spark, n, spread, groups):
    rng = np.random.default_rng(n)
    middles = rng.normal(size=(6, 64))
    rows = [(i, [float(x) for x in (middles[i % 6] + spread * rng.normal(size=64)).astype(np.float32)]) for i in range(n)]
    rows += [rows[0], (n, rows[1][1]), (None, rows[2][1])]  # repeated row, repeated vector, no id
    odd = [(n + 1, None), (n + 2, []), (n + 3, [0.5] * 63), (n + 4, [0.5] * 63 + [None]), (n + 5, [float("nan")] * 64), (n + 6, [float("inf")] * 64), (n + 7, [1e30] * 64)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], SCHEMA).repartition(5)
    got, model = yinyang.cluster(df, groups=groups)
    want, centroids = plain(rows)
    found = got.collect()
    assert sorted(tuple(r) for r in found if r.vec_id is not None) == want
    assert model.centroids.tolist() == [c.tolist() for c in centroids] and len(found) == len(rows)
    assert sum(model.counts) == len(rows) and sum(model.inertias) == sum(r.distance for r in found)
    if n == 300 and spread < 0.1:  # bounds settle at once
        assert sum(s for s, _ in model.scans[2:]) < 0.5 * sum(f for _, f in model.scans[2:])


def test_ties_go_to_the_smaller_number(spark):
    """All vectors equal: every centroid is the same, and all rows belong to the first."""
    df = spark.createDataFrame([(i, [0.25] * 64, 0) for i in range(40)], SCHEMA)
    rows = yinyang.clusters(df).collect()
    assert {(r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in rows} == {(0, 0, 0, 0)} and len(rows) == 40


def test_nothing_to_cluster(spark):
    df = spark.createDataFrame([(1, None, 0)], SCHEMA)
    assert yinyang.clusters(df).count() == 0 == yinyang.clusters(df.limit(0)).count()
    assert yinyang.clusters(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold(spark):
    """After every pass bounds are bounds: upper over the exact distance, lower under those of each group."""
    rng = np.random.default_rng(4)
    x = rng.integers(-2000, 2000, (400, 64))
    c = x[:9].copy()
    groups = yinyang.centroid_groups(c, 3)
    best, exact, lower, _ = yinyang._first(x, c, groups, groups.max() + 1)
    upper = np.sqrt(exact.astype(float))
    for _ in range(12):
        moved = np.stack([x[best == j].sum(0) // max((best == j).sum(), 1) if (best == j).any() else c[j] for j in range(9)])
        drift = np.sqrt(((moved - c).astype(float) ** 2).sum(1)) * (1 + 1e-12)
        c = moved
        best, exact, upper, lower, _ = yinyang._again(x, best, upper, lower, c, groups, drift)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (best == d.argmin(1)).all() and (upper >= np.sqrt(d.min(1)) - 1e-6).all()
        root = np.sqrt(d.astype(float))
        root[np.arange(len(x)), best] = np.inf
        assert all((lower[:, g] <= root[:, groups == g].min(1) + 1e-6).all() for g in range(groups.max() + 1))
