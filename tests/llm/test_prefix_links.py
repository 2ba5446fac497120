"""Links whose shared prefix shingle lies above the other group's reach."""

import numpy as np
import pyarrow as pa

from threadwell.llm import common, jaccard


def ordered_words(n):
    """n words, ascending by the order key of their one-word shingles."""
    words = [f"w{i}" for i in range(n)]
    _, _, data, offsets = next(common.text_chunks(pa.array(words)))
    h, owner, _, _ = common.words(data, offsets)
    h, owner = common.shingles(h, owner, n, 1)
    key = jaccard.keys(h, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return [words[owner[i]] for i in np.argsort(key)]


def test_groups_of_short_reach_are_joined(spark):
    place = (5, 10, 12, 15, 20, 30, 40, 50, 60, 70)
    word = dict(zip(place, ordered_words(len(place)), strict=True))
    q = [20, 30, 40, 50, 60, 70]
    sets = {"r": [15, *q], "x": [10, *q], "y": [5, 10, *q], "q": q, "s": [12, 15, *q]}
    rows = [(i, " ".join(word[p] for p in own)) for i, own in enumerate(sets.values())]
    # one row a partition, so that no shingle counts as common and the order is that of the hashes
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 1, 85, 100).collect()} == dict.fromkeys(range(5), 0)


def brute_components(rows, k, num, den=100):
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_five_windows_of_one_passage(spark):
    w, u, v = ([f"{c}{i}" for i in range(n)] for c, n in (("w", 23), ("u", 4), ("v", 4)))
    texts = [w[:23] + v[:3], w[1:23] + v[:4], w[:23], u[1:4] + w[:23], u[:4] + w[:22]]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == brute_components(rows, 4, 85) == dict.fromkeys(range(1, 6), 1)


def test_windows_of_shared_passages(spark):
    """Sliding excerpts with edits, many of them just above or below the threshold, each trial in an id range of its own."""
    rng = np.random.default_rng(21)
    rows, want = [], {}
    for trial in range(30):
        words = [f"t{trial}x{i}" for i in range(70)]
        own = []
        for _ in range(25):
            a = int(rng.integers(0, 12))
            text = words[a : a + int(rng.integers(30, 55))]
            for _ in range(int(rng.integers(0, 3))):
                text[int(rng.integers(0, len(text)))] = f"e{rng.integers(0, 40)}"
            own.append((trial * 100 + len(own), " ".join(text)))
        rows += own
        want |= brute_components(own, 4, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == want and len(set(want.values())) > 60


def test_columns_that_clash_are_kept(spark):
    rows = [(1, "a b c d e f g", 77, 7), (2, "a b c d e f g", 78, 8), (3, "other words are in this text", 79, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, word long")
    assert sorted(map(tuple, jaccard.keep_first(docs).collect())) == [rows[0], rows[2]]
