"""The hidden Markov model against plain implementations: counts, rounds over all rows, and scores."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadwell.llm import common, hmm


def small_model(rng, k, s):
    return hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T)


def plain_counts(model, seqs):
    """Forward and backward, text by text and unscaled."""
    k, s = len(model.start), len(model.emit)
    emit, start, move, total = np.zeros((s, k)), np.zeros(k), np.zeros((k, k)), 0.0
    for x in seqs:
        a = [model.start * model.emit[x[0]]]
        for y in x[1:]:
            a.append(a[-1] @ model.move * model.emit[y])
        b = [np.ones(k)]
        for y in x[:0:-1]:
            b.append(model.move @ (model.emit[y] * b[-1]))
        b, z = b[::-1], a[-1].sum()
        total += math.log10(z)
        start += a[0] * b[0] / z
        for t, y in enumerate(x):
            emit[y] += a[t] * b[t] / z
            if t:
                move += model.move * np.outer(a[t - 1], model.emit[y] * b[t]) / z
    return emit, start, move, total


@pytest.mark.parametrize("segment", [1, 2, 3, 100])
def test_counts_are_those_of_whole_texts(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    rng = np.random.default_rng(4)
    for k in (1, 2, 4):
        model = small_model(rng, k, 5)
        seqs = [rng.integers(0, 5, n).tolist() for n in (3, 1, 4, 7, 2, 12, 6)]
        first = np.r_[0, np.cumsum([len(x) for x in seqs])]
        sym, got = np.concatenate(seqs).astype(np.int32), np.zeros((k, 5))
        start, move, total = hmm.expected_counts(model, sym, first, got)
        want = plain_counts(model, seqs)
        for x, y in zip((got.T, start, move, total), want, strict=True):
            assert np.allclose(x, y, rtol=1e-4, atol=1e-5)
        assert np.allclose(hmm.forward(model, sym, first), [plain_counts(model, [x])[3] for x in seqs])


def test_a_long_text_does_not_underflow():
    rng = np.random.default_rng(5)
    model, sym = small_model(rng, 3, 6), rng.integers(0, 6, 20_000).astype(np.int32)
    emit = np.zeros((3, 6))
    start, move, total = hmm.expected_counts(model, sym, np.array([0, 20_000]), emit)
    assert np.allclose([start.sum(), move.sum(), emit.sum()], [1, 19_999, 20_000], rtol=1e-4)
    assert np.allclose(emit.sum(0), np.bincount(sym, minlength=6), rtol=1e-4) and math.isfinite(total)


def test_rounds_match_a_plain_implementation(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 5)
    monkeypatch.setattr(hmm, "CHUNK", 40)
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "dd", "e"][:: 1 if i % 2 else -1], int(n), p=[0.4, 0.3, 0.1, 0.1, 0.1])) for i, n in enumerate(rng.integers(0, 30, 60))]
    train = spark.createDataFrame([(None if i % 7 == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    alpha = hmm.alphabet(hmm.word_counts(train))
    table = hmm.symbol_table(train, F.lit(True), alpha)
    seqs = [r.sym for r in table.collect()]
    assert collections.Counter(len(x) for x in seqs) == collections.Counter(len(t.split()) + 1 for t in texts)
    model = hmm.first_model(alpha, 3)
    prior, last = hmm.PRIOR * alpha.unigram()[:, None], -math.inf
    for _ in range(5):
        emit, start, move, total = plain_counts(model, seqs)
        now, seen = hmm.baum_welch(table, alpha, model)
        assert math.isclose(seen, total, rel_tol=1e-6)
        # what a round raises: the likelihood and the priors' part
        goal = total + (prior * np.log10(model.emit)).sum() + np.log10(model.move).sum() + np.log10(model.start).sum()
        assert goal >= last - 1e-4
        last = goal
        assert np.allclose(now.emit, (emit + prior) / (emit + prior).sum(0), rtol=1e-4)
        assert np.allclose(now.move, (move + 1) / (move + 1).sum(1, keepdims=True), rtol=1e-4) and np.allclose(now.start, (start + 1) / (start + 1).sum(), rtol=1e-4)
        model = now


def test_scores_match_a_plain_implementation(spark, monkeypatch):
    """Rare words through their classes: the probability of a class times that of the word in it."""
    monkeypatch.setattr(hmm, "SYMBOLS", 6)
    rng = np.random.default_rng(9)
    pool = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(pool[: 8 if i % 3 else 40], int(n))) for i, n in enumerate(rng.integers(0, 25, 50))] + ["never seen before", "W1 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learn = F.col("doc_id") < 40
    alpha = hmm.alphabet(common.saved(hmm.word_counts(docs.filter(learn)), "test"))
    model = hmm.fit(hmm.symbol_table(docs, learn, alpha), alpha)
    count = collections.Counter(w for t in texts[:40] for w in t.lower().split())
    by_hash, classes = {}, {}
    for w in {w for t in texts for w in t.lower().split()}:
        data = np.frombuffer(w.encode(), np.uint8)
        h, _, s, e = common.words(data, np.array([0, len(data)]))
        by_hash[w], classes[w] = h[0], int(hmm.suffix_class(data, s, e)[0])
    kept = {w for w in by_hash if by_hash[w] in set(alpha.hashes.tolist())}
    rare = collections.defaultdict(list)
    for w in count:
        if w not in kept:
            rare[classes[w]].append(count[w])
    got = {r.doc_id: r for r in hmm.score(docs, learn).collect()}
    for i, t in enumerate(texts):
        w = t.lower().split()
        seq = [int(alpha.symbols(np.array([by_hash[x]]), np.array([classes[x]]))[0]) for x in w] + [alpha.end]
        want = plain_counts(model, [seq])[3]
        want += sum(math.log10((count[x] + 1) / (sum(rare[classes[x]]) + len(rare[classes[x]]) + 1)) for x in w if x not in kept)
        assert math.isclose(got[i].score, want, rel_tol=1e-9)
        assert got[i].n_known == sum(x in count for x in w) + 1


def test_the_model_beats_the_unigram_on_unseen_texts(spark):
    rng = np.random.default_rng(11)
    worlds = [[f"{c}{i}" for i in range(50)] for c in "xyz"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(worlds[i % 3], 60))) for i in range(240)], "doc_id long, text string")
    out = hmm.score_held_out(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out.s > out.b * 0.9
