"""Sharding along the curve: a true Hilbert curve, rows in its order, copies side by side."""

import numpy as np
import pytest

from threadwell.llm import sharding


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3)])
def test_curve_visits_every_cell_by_single_steps(axes, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    index = sharding.hilbert_index([points[:, a] for a in range(axes)], bits)
    assert sorted(index) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_shards_follow_the_curve_and_keep_copies_together(spark):
    rng = np.random.default_rng(3)
    texts = ["x" * int(n) for n in rng.integers(0, 3000, 60)] + [None, ""]
    rows = [(i, texts[int(rng.integers(0, len(texts)))], ["en", "de", None, "fr"][i % 4], f"src{i % 9}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(sharding.hilbert_shards(docs, 7).collect(), key=lambda r: (r.shard, r.slot))
    curve = sharding.hilbert_index([np.array([r[a] for r in got]) for a in ("lang_q", "source_q", "size_q")], 8)
    assert curve.tolist() == [r.curve for r in got] == sorted(r.curve for r in got)
    sizes = [sum(r.shard == s for r in got) for s in range(7)]
    assert sum(sizes) == 700 and max(sizes) - min(sizes) <= 1
    text_of = dict((r[0], r[1] or "") for r in rows)
    order = [text_of[r.doc_id] for r in got]
    assert sum(a != b for a, b in zip(order, order[1:])) == len(set(order)) - 1  # each text is one run
    axes = {}
    for r in got:  # all copies have the axes of their first
        assert axes.setdefault(text_of[r.doc_id], (r.lang_q, r.source_q, r.size_q)) == (r.lang_q, r.source_q, r.size_q)
