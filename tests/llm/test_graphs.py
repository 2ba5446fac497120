"""Embedding near-duplicates and connected components against brute force."""

import collections

import numpy as np
import pytest

from threadwell.llm import common, lattice
from threadwell.llm.components import Filter, connected_components, merged_components


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_connected_components(spark, shape):
    rng = np.random.default_rng(0)
    edges = {"path": [(i, i + 1) for i in range(40)], "star": [(99, i) for i in range(30)], "random": [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(60)], "none": []}[shape]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if a != b and x != y:
            parent[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    rows = connected_components(df).collect()
    assert {r.node: r.component for r in rows} == {n: find(n) for n in linked} and len(rows) == len(linked)


def test_components_of_more_edges(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        old, new = ([tuple(map(int, rng.integers(0, 60, 2))) for _ in range(n)] for n in (25, 12))
        df = lambda e: spark.createDataFrame(e, "a long, b long")
        whole = {r.node: r.component for r in connected_components(df(old + new)).collect()}
        label = common.saved(connected_components(df(old)), "test")
        got = merged_components(label, common.saved(df(new), "test")).collect()
        assert {r.node: r.component for r in got} == whole and len(got) == len(whole)
    assert merged_components(label, df([])).count() == label.count()


def test_filter_has_no_false_negatives(spark):
    ids = spark.range(0, 1000, 7).toDF("k")
    some = Filter.of(ids, "k")
    kept = {r.k for r in some.keep(spark.range(2000).toDF("k"), "k").collect()}
    rest = {r.k for r in some.keep(spark.range(2000).toDF("k"), "k", among=False).collect()}
    assert set(range(0, 1000, 7)) <= kept and len(kept) < 200 and kept | rest == set(range(2000)) and not kept & rest


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.nearest_e8(x)
    twice = np.rint(2 * p).astype(int)
    assert np.allclose(2 * p, twice)
    assert ((twice % 2 == 0).all(1) | (twice % 2 == 1).all(1)).all() and (p.sum(1) % 2 == 0).all()
    d = ((x - p) ** 2).sum(1)
    near = ((x[:, None, :] - (p[:, None, :] + lattice.ROOTS)) ** 2).sum(2).min(1)
    assert (d <= near + 1e-12).all() and len(lattice.ROOTS) == 240


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v)
    base = [unit(rng.normal(size=64)) for _ in range(60)]
    vectors = list(base)
    for v in base[:30]:
        for c in (0.931, 0.96, 0.99):
            z = rng.normal(size=64)
            z = unit(z - (z @ v) * v)
            vectors.append(c * v + np.sqrt(1 - c * c) * z)
    rows = [(i, [float(x) for x in np.float32(v)], i % 3 if i < 60 else (i - 60) // 3 % 3, "x", "y") for i, v in enumerate(vectors)]
    rows += [(1000, rows[0][1], 0, "x", "y"), (1001, rows[0][1], None, "x", "y"), (1002, None, 0, "x", "y"), (1003, [0.0] * 64, 0, "x", "y"), (1004, [float("nan")] * 64, 0, "x", "y"), (1005, [None] * 64, 0, "x", "y"), (1006, [], 0, "x", "y"), (1007, [1.0, 2.0], 0, "x", "y"), (1008, [2.0, 4.0], 0, "x", "y")]
    schema = "vec_id long, embedding array<float>, label int, node string, key string"
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    good = [(i, unit(np.array(v, float)), lab) for i, v, lab, *_ in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = collections.defaultdict(set)
    for i, u, a in good:
        for j, v, b in good:
            if i != j and a == b and len(u) == len(v) and u @ v >= 0.93:
                links[i].add(j)
    found = sum(r.n_links for r in got.values())
    want = sum(len(x) for x in links.values())
    assert found >= 0.9 * want and all(got[i].n_links <= len(links[i]) for i in got)
    assert got[1000].component_id == 0 and got[1008].component_id == 1007 and not got[1008].kept
    for i in range(1001, 1007):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert lattice.near_duplicates(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("part", [3, 2000])
def test_links_are_counted_once(spark, monkeypatch, part):
    """Dense groups, where pairs meet in many tables and cells: numbers of links are those of the pairs that meet."""
    monkeypatch.setattr(lattice, "HELD", part)
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v)
    rows = []
    for _ in range(4):
        base = unit(rng.normal(size=64))
        for _ in range(25):
            rows.append([float(x) for x in np.float32(unit(base + rng.normal(size=64) * float(rng.uniform(0.005, 0.035))))])
    rows += rows[:7]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int").repartition(5)).collect()}
    u = np.stack([unit(np.array(v)) for v in rows])
    look = lattice.Tables(64).cells(u)[1]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            meet = any(look[j, t, 0] in look[i, t] or look[i, t, 0] in look[j, t] for t in range(lattice.TABLES))
            if rows[i] == rows[j] or meet and u[i] @ u[j] >= 0.93:
                links[i].add(j)
                links[j].add(i)
    assert {i: len(x) for i, x in links.items()} == {i: r.n_links for i, r in got.items()}
    for i, x in links.items():
        assert all(got[i].component_id == got[j].component_id for j in x) and got[i].component_id <= i
