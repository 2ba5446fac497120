"""Clustered vectors: the rows of a full comparison, and how much of the table is passed over."""

import numpy as np
import pytest

from threadwell.operators.retrieval import vector_topk
from threadwell.operators.vector_index import VectorIndex

SCHEMA = "chunk_id long, embedding array<float>"


@pytest.mark.parametrize(("metric", "unit"), [("cosine", True), ("cosine", False), ("l2", True), ("l2", False)])
def test_same_rows_as_comparing_all(spark, tmp_path, metric, unit):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(12, 24))
    x = middles[rng.integers(0, 12, 1500)] + 0.15 * rng.normal(size=(1500, 24))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.uniform(0.5, 2, (1500, 1))
    x = np.concatenate([x, x[:30]]).astype(np.float32)  # ties
    good = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], SCHEMA)
    odd = spark.createDataFrame([(9001, None), (9002, [1.0]), (9003, [float("nan")] * 24), (9004, [None] * 24)], SCHEMA)
    index = VectorIndex(spark, str(tmp_path / "v")).build(good.unionByName(odd))
    near = rng.integers(0, 1500, 2)
    for q in [*(x[i] for i in near), rng.normal(size=24).astype(np.float32)]:
        query = spark.createDataFrame([([float(a) for a in q],)], "q array<float>")
        for limit in (1, 40):
            got = [(r.chunk_id, round(r.distance, 9)) for r in index.search(query, limit, metric).collect()]
            assert got == [(r.chunk_id, round(r.distance, 9)) for r in vector_topk(good, query, limit, "chunk_id", metric).collect()]
    opened, clusters, compared, there = VectorIndex(spark, index.root).opened(spark.createDataFrame([([float(a) for a in x[near[0]]],)], "q array<float>"), 10, metric)
    assert clusters >= 12 and there == 1530
    if unit:
        assert opened < clusters and compared < there / 3
    assert index.search(query, 2000, metric).count() == 1530


def test_built_again_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], SCHEMA)
    query = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    index = VectorIndex(spark, str(tmp_path / "v"))
    assert index.search(query).count() == 0
    index.build(df.limit(0))
    assert index.search(query).count() == 0
    assert [r.chunk_id for r in index.build(df).search(query).collect()] == [1, 2]
    assert [r.chunk_id for r in index.build(df.filter("chunk_id = 2")).search(query).collect()] == [2]
