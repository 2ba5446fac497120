"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The terms of the vectors are those that tell the classes of the examples apart by a likelihood-ratio test; how sure
the test must be is chosen on examples set aside. Words that say nothing about toxicity would only add noise to the
cosines of long texts. All terms that pass are indexed, however many, and the cosines over them are exact.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwell.llm.common import fold, saved, text_batches

#: Bound on the labelled examples of each class that are fitted.
MAX_EXAMPLES = 4096
#: Levels of the likelihood-ratio statistic that a term may need (the best on the examples set aside is taken), and the
#: least ratio of the classes' shares.
LEVELS, MIN_RATIO = (8.0, 12.0, 16.0, 20.0, 26.0, 34.0), 3.0
NEIGHBOURS, BLOCK = 15, 64
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, and stems of 4 and 5 letters of the longer ones (marked by a hyphen)."""
    words = _WORD.findall(text.lower()) if text else []
    return words + [w[:4] + "-" for w in words if len(w) > 4] + [w[:5] + "-" for w in words if len(w) > 5]


class BlockMaxIndex:
    """Inverted index of unit vectors in blocks of neighbouring ids, with each term's largest weight in each block."""

    def __init__(self, vectors: list[dict[int, float]], block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.n_blocks = -(-self.n // block)
        by_term: dict[int, list[tuple[int, float]]] = {}
        for i, v in enumerate(vectors):
            for t, w in v.items():
                by_term.setdefault(t, []).append((i, w))
        self.postings = {}
        for t, rows in by_term.items():
            ids, weights = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            blocks, first = np.unique(ids // block, return_index=True)
            self.postings[t] = ids % block, weights, blocks, np.append(first, len(ids)), np.maximum.reduceat(weights, first)

    def top(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k most similar vectors with a similarity above 0, ties by lower id: (cosine, id), best first.

        Blocks are opened in the order of their bounds, until the next bound is below the k-th similarity.
        """
        bound = np.zeros(self.n_blocks)
        terms = [(w, self.postings[t]) for t, w in sorted(query.items()) if t in self.postings]
        for w, p in terms:
            bound[p[2]] += w * p[4]
        best: list[tuple[float, int]] = []
        for b in np.lexsort((np.arange(self.n_blocks), -bound)):
            if bound[b] <= 0 or len(best) >= k and bound[b] + 1e-9 < best[k - 1][0]:
                break
            scores = np.zeros(self.block)
            for w, (slot, weight, blocks, first, _) in terms:
                at = np.searchsorted(blocks, b)
                if at < len(blocks) and blocks[at] == b:
                    part = slice(first[at], first[at + 1])
                    scores[slot[part]] += w * weight[part]
            hit = np.flatnonzero(scores > 0)
            best = sorted([*best, *((float(s), int(b) * self.block + int(i)) for s, i in zip(scores[hit], hit, strict=True))], key=lambda x: (-round(x[0], 12), x[1]))[:k]
        return best


@dataclass
class Model:
    """Bounded by the examples: at most MAX_EXAMPLES vectors of each class, over terms of theirs."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: list[int] = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    index: BlockMaxIndex | None = None
    prior: float = 0.0
    class_weight: tuple[float, float] = (1.0, 1.0)
    theta: tuple[float, float, float] = (1.0, 0.0, 0.0)  # of the vote's log odds, of the log number of terms, offset

    def vector(self, counts: Counter) -> dict[int, float]:
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    def counts(self, text: str | None) -> Counter:
        known = self.vocabulary
        return Counter([known[w] for w in tokens(text) if w in known])

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic votes, each weighing 1 / (distance + 0.05); the prior has the weight of a far neighbour."""
        yes, total = self.prior, 1.0
        for cosine, i in near:
            w = self.class_weight[int(self.toxic[i])] / (1.05 - min(cosine, 1.0))
            yes, total = yes + w * self.toxic[i], total + w
        return yes / total

    def evidence(self, near: list[tuple[float, int]], n_terms: int) -> tuple[float, float, float]:
        p = min(max(self.vote(near), 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p)), math.log1p(n_terms), 1.0

    def score(self, near: list[tuple[float, int]], n_terms: int) -> float:
        z = sum(a * b for a, b in zip(self.theta, self.evidence(near, n_terms), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def calibrate(self, design: np.ndarray, toxic: np.ndarray) -> float:
        """Logistic calibration of votes on examples outside of the index (rows of `evidence`).

        Targets are smoothed as in Platt's scaling, classes weigh as they occur. Returns the mean log loss after it.
        """
        y = toxic.astype(float)
        n1, n0 = y.sum(), len(y) - y.sum()
        weight = np.where(y > 0, self.class_weight[1], self.class_weight[0])
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        pull = np.array([1.0, 0.0, 0.0])
        theta = pull.copy()
        for _ in range(50):  # Newton steps, with a weak pull to the bare vote
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            grad = design.T @ (weight * (p - target)) + 0.2 * (theta - pull)
            hess = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 0.2 * np.eye(3)
            step = np.clip(np.linalg.solve(hess, grad), -2, 2)
            theta = theta - step
            if abs(step).max() < 1e-9:
                break
        self.theta = tuple(float(x) for x in theta)
        p = np.clip(1 / (1 + np.exp(-np.clip(design @ theta, -30, 30))), 1e-6, 1 - 1e-6)
        return float(-(weight * np.where(y > 0, np.log(p), np.log(1 - p))).sum() / max(weight.sum(), 1e-9))

    def indexed(self, rows: list[tuple[int, bool, Counter]]) -> Model:
        """This model over an index of the given examples."""
        # neighbours in the index share their strongest term, which keeps the blocks' bounds tight
        full = sorted(((i, t, self.vector(c)) for i, t, c in rows), key=lambda r: (max(r[2], key=lambda t: (r[2][t], -t), default=-1), r[0]))
        return replace(self, ids=[r[0] for r in full], toxic=np.array([r[1] for r in full], bool), index=BlockMaxIndex([r[2] for r in full]))


def held_out() -> F.Column:
    """Rows that labels are not learned from."""
    return F.coalesce(fold("doc_id", 5) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows outside of the held-out fold.

    Of each class the MAX_EXAMPLES ids with the lowest hash are the examples, each with one text (the first in order,
    if rows repeat the id). Terms are words and stems that
    tell the classes of four fifths of the examples apart, at the level that does best on the other fifth; their
    document frequencies are counted over all of docs.
    """
    spark = docs.sparkSession
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {bool(r[0]): r[1] for r in rows.groupBy(F.col("toxic") == 1).count().collect()}
    picked = None
    for kind in (True, False):
        part = rows.filter((F.col("toxic") == 1) == F.lit(kind)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * MAX_EXAMPLES ids
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), (F.first("toxic") == 1).alias("toxic"))
    examples = saved(once, "toxicity-examples")

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                count.update((w, toxic.as_py()) for w in set(tokens(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in count], pa.string()), pa.array([t for _, t in count], pa.bool_()), pa.array(list(count.values()), pa.int64())], names=["term", "toxic", "n"])

    size = {bool(r[0]): r[1] for r in examples.groupBy("toxic").count().collect()}
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(5)) == 0  # a fifth to choose the level and to calibrate
    chosen = examples.filter(~apart).select("text", "toxic")
    by_class = {bool(r[0]): r[1] for r in chosen.groupBy("toxic").count().collect()}
    n1, n0 = by_class.get(True, 0), by_class.get(False, 0)
    if not n1 or not n0:
        return Model({}, np.zeros(0), prior=share.get(True, 0) / max(sum(share.values()), 1))
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n1 + n0)
    # the same statistic for a presence in either class against the class sizes: 2 * sum of observed * log(observed / expected)
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g2 = 2 * (cell(a, (a + b) * n1 / n) + cell(b, (a + b) * n0 / n) + cell(n1 - a, (n - a - b) * n1 / n) + cell(n0 - b, (n - a - b) * n0 / n))
    ratio = F.abs(F.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))))
    counted = chosen.mapInArrow(terms_of, "term string, toxic boolean, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("b"))
    best = counted.filter((a + b < n) & (a + b >= 2)).withColumn("g2", g2).filter((F.col("g2") >= LEVELS[0]) & (ratio >= math.log(MIN_RATIO))).orderBy(F.desc("g2"), "term").select("term", "g2").collect()
    vocabulary, strength = {r[0]: i for i, r in enumerate(best)}, np.array([r[1] for r in best])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, df = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            n_docs += batch.num_rows
            for text in batch.column(0):
                df[[vocabulary[w] for w in vocabulary.keys() & set(tokens(text.as_py()))]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n_docs), pa.int64())], names=["term", "n"])

    found = {r[0]: r[1] for r in docs.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n")).collect()}
    total = found.pop(-1, 0)
    idf = np.array([math.log((1 + total) / (1 + found.get(t, 0))) + 1 for t in range(len(vocabulary))])
    model = Model(vocabulary, idf, prior=share[True] / sum(share.values()))
    model.class_weight = tuple((share[k] / sum(share.values())) / (size[k] / sum(size.values())) for k in (False, True))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [model.counts(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([list(c) for c in counts], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], names=["doc_id", "toxic", "apart", "terms", "counts"])

    got = examples.select("doc_id", "text", "toxic", apart.alias("apart")).mapInArrow(vectors, "doc_id long, toxic boolean, apart boolean, terms array<int>, counts array<int>").collect()
    rows = [(r[0], r[1], dict(zip(r[3], r[4], strict=True)), r[2]) for r in got]
    best_loss, out = math.inf, None
    for level in LEVELS:
        n_terms = int((strength >= level).sum())  # terms are numbered from the strongest
        cut = [(i, t, Counter({k: c for k, c in counts.items() if k < n_terms}), apart) for i, t, counts, apart in rows]
        trial = model.indexed([r[:3] for r in cut if not r[3]])
        votes = [trial.evidence(trial.index.top(trial.vector(r[2]), NEIGHBOURS), len(r[2])) for r in cut if r[3]]
        loss = trial.calibrate(np.array(votes).reshape(-1, 3), np.array([r[1] for r in cut if r[3]], bool))
        if loss < best_loss - 1e-12:
            best_loss = loss
            out = replace(model.indexed([r[:3] for r in cut]), vocabulary={w: i for w, i in vocabulary.items() if i < n_terms}, theta=trial.theta)
    return out


def _scored(model: Model, column: pa.Array, memo: dict) -> list[tuple[float, list]]:
    """Score and evidence of each text; texts with the same term counts are looked up once."""
    out = []
    for text in column:
        counts = model.counts(text.as_py())
        key = hashlib.blake2b(np.array(sorted(counts.items()), np.int64).tobytes(), digest_size=16).digest()
        if key not in memo:
            if len(memo) > 20_000:
                memo.clear()
            near = model.index.top(model.vector(counts), NEIGHBOURS) if model.index and counts else []
            memo[key] = model.score(near, len(counts)), near[:3]
        out.append(memo[key])
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the three nearest examples (neighbours, cosines) of every document.

    The score is a probability: the calibrated, distance-weighted vote of the NEIGHBOURS nearest examples. A null or
    empty text, or one without a term of the model, has the score of no neighbours. Repeated rows score alike; an
    empty table gives none. One pass over the texts, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            rows = _scored(model, batch.column(1), memo)
            value = np.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32)), pa.array([[model.ids[i] for _, i in r[1]] for r in rows], pa.list_(pa.int64())), pa.array([[c for c, _ in r[1]] for r in rows], pa.list_(pa.float64()))], names=["doc_id", "score", "predicted", "neighbours", "cosines"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, neighbours array<long>, cosines array<double>")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""
    text_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            yield batch.filter(pa.array([r[0] < 0.5 for r in _scored(model, batch.column(at), memo)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
