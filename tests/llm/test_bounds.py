"""Bounds and settings of shared helpers: exact top counts, hubs, sessions left as they are, null ids."""

import pytest

from threadwell.llm import common, components, jaccard
from threadwell.llm.components import connected_components


@pytest.mark.parametrize("levels", [[(101, 7)], [(3, 9), (500, 2), (40, 1)], [(50, 5), (50, 4)], [(10, 3)]])
def test_most_counted_takes_the_limit(spark, levels):
    """(words, count) of each level; 100 are wanted, however wide a level is."""
    rows, i = [], 0
    for words, n in levels:
        rows += [(i + j, n) for j in range(words)]
        i += words
    counts = common.saved(spark.createDataFrame(rows, "word long, n long"), "test")
    got = sorted((r.n for r in common.most_counted(counts, 100, "word").collect()), reverse=True)
    assert got == sorted((n for _, n in rows), reverse=True)[:100]
    assert common.most_counted(counts.limit(0), 100, "word").count() == 0


def test_hubs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 10)
    edges = [(0, i) for i in range(1, 200)] + [(1000, i) for i in range(150, 400)] + [(2000, 2001)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    rows = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {n: 2000 if n >= 2000 else 0 for e in edges for n in e}
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_keep_first_keeps_null_ids(spark):
    text, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(-2, text, "x"), (-1, text, "y"), (None, other, "z"), (None, text, "u")], "doc_id long, text string, id string")
    assert sorted(r.id for r in jaccard.keep_first(docs).collect()) == ["u", "x", "z"]
