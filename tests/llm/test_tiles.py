"""Greedy string tiling and decontamination against brute force."""

import time

import numpy as np
import pytest

from threadwell.llm import decontamination


def plain_tiles(p, t, least):
    """The definition: mark the longest unmarked match, the first of equals, until none is long enough."""
    p_free, t_free, out = [True] * len(p), [True] * len(t), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and p_free[i + n] and t_free[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        p_free[i : i + n] = t_free[j : j + n] = [False] * n
        out.append((i, j, n))


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_tiles_match_the_definition(least):
    rng = np.random.default_rng(least)
    for trial in range(120):
        letters = int(rng.choice([1, 2, 3, 8]))
        p, t = (rng.integers(0, letters, int(rng.integers(0, 25))).tolist() for _ in "pt")
        if trial % 3 == 0:
            t = p[5:12] + t + p[:6]
        assert decontamination.greedy_tiles(p, t, least) == plain_tiles(p, t, least)


def test_repeated_words_are_no_worse():
    began = time.perf_counter()
    assert decontamination.greedy_tiles([1] * 1500, [1] * 5000, 5) == [(0, 0, 1500)]
    tiles = decontamination.greedy_tiles([1, 2] * 350, [1, 2, 2] * 700 + [1, 2] * 100, 2)
    assert tiles[0][2] >= 200
    assert time.perf_counter() - began < 60


def test_two_words_over_and_over():
    rng = np.random.default_rng(8)
    p, t = rng.integers(0, 2, 8000), rng.integers(0, 2, 32000)
    began = time.perf_counter()
    tiles = decontamination.greedy_tiles(p, t, 5)
    assert time.perf_counter() - began < 20  # 8,000 times 32,000 places; listing the matches took minutes
    assert [n for *_, n in tiles] == sorted((n for *_, n in tiles), reverse=True)
    assert all((p[i : i + n] == t[j : j + n]).all() for i, j, n in tiles)
    left = []
    for side, own in ((p, [(i, n) for i, _, n in tiles]), (t, [(j, n) for _, j, n in tiles])):
        times = np.bincount(np.concatenate([np.arange(a, a + n) for a, n in own]), minlength=len(side))
        assert times.max() == 1
        left.append({tuple(side[a : a + 5]) for a in range(len(side) - 4) if not times[a : a + 5].any()})
    assert not left[0] & left[1]  # nothing that could be marked is left


def test_words_whose_hashes_agree(monkeypatch):
    """Hashes only propose: with one hash for all windows the tiles are the same."""
    rng = np.random.default_rng(9)
    cases = [(rng.integers(0, 3, 20).tolist(), rng.integers(0, 3, 24).tolist()) for _ in range(40)]
    monkeypatch.setattr(decontamination, "mix", lambda h: h * np.uint64(0))
    for p, t in cases:
        assert decontamination.greedy_tiles(p, t, 2) == plain_tiles(p, t, 2)


def test_documents_against_brute_force(spark):
    rng = np.random.default_rng(31)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 60, int(n))) for n in [1, 3, 4, 5, 6, 9, 20, 40, 40]] + ["same same same same same same same", "", None, "W1 w2 w3 w4 w5"]
    texts = [None, "", "same " * 50, "same " * 6]
    for _ in range(150):
        words = []
        for _ in range(int(rng.integers(1, 5))):
            words += [f"w{x}" for x in rng.integers(0, 60, int(rng.integers(0, 9)))]
            pick = (items[int(rng.integers(0, 9))] or "").split()
            cut = int(rng.integers(0, len(pick)))
            words += pick[cut:] + (pick[:cut] if rng.random() < 0.5 else [])
        texts.append(" ".join(words))
    texts += texts[10:14]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[20], 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body long, word string").repartition(4)
    bench = spark.createDataFrame([*enumerate(items), (77, items[6])], "item_id long, text string")
    want, bad = set(), set()
    for i, t, *_ in rows:
        w = (t or "").split()
        for j, item in [*enumerate(items), (77, items[6])]:
            p = (item or "").lower().split()
            tiles = plain_tiles(p, w, min(5, len(p))) if p else []
            covered = sum(x[2] for x in tiles)
            if p and covered >= 0.8 * len(p) - 1e-9:
                want.add((i, j, len(tiles), covered, len(p)))
                bad.add(t)
    got = [tuple(r)[:5] for r in decontamination.contaminated(docs, bench).collect()]
    assert set(got) == want and len(got) == len(want)
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns
    key = lambda r: (str(r[0]), str(r[1]), *r[2:])
    assert sorted(map(tuple, left.collect()), key=key) == sorted((r for r in rows if r[1] not in bad), key=key)
