"""Hidden Markov language model over words: Baum-Welch counts summed over partitions, exact scaled forward scores.

The alphabet is bounded: the SYMBOLS commonest words of the training rows, CLASSES classes that all other words fall
into by their last bytes, and the end of a text. Within a class a word has the probability (c + 1) / (N + V + 1) of
its count c among the class's N tokens and V words, one place being left for words never seen. So the model is a
proper distribution over texts, and what a text needs from the unbounded table of word counts is a sum over its rare
words, which a shuffle join brings; nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwell.llm.common import fold, most_counted, saved, text_chunks, words

SYMBOLS, CLASSES, STATES = 1 << 16, 1 << 11, 8
#: Precision of the expected counts; scores are in double precision.
COUNTED = np.float32
#: Rounds of Baum-Welch, each over all training rows; tokens of a stretch that is run side by side with others; tokens
#: that are handled at once; weight of the unigram in each state's emissions.
ROUNDS, SEGMENT, CHUNK, PRIOR = 4, 1024, 800_000, 100.0


@dataclass
class Alphabet:
    """Symbols of words; bounded by SYMBOLS and CLASSES."""

    hashes: np.ndarray  # of the common words, ascending
    counts: np.ndarray  # of the common words
    class_tokens: np.ndarray
    class_words: np.ndarray
    train_docs: int
    train_tokens: int
    distinct: int

    @property
    def end(self) -> int:
        return len(self.hashes) + CLASSES

    def symbols(self, h: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return suffix.astype(np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, len(self.hashes) + suffix).astype(np.int32)

    def unigram(self) -> np.ndarray:
        raw = np.concatenate([self.counts, self.class_tokens + 1, [self.train_docs + 1]]).astype(float)
        return raw / raw.sum()


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state


def suffix_class(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of each word by its last three bytes, A-Z lowered."""
    out = np.zeros(len(starts), np.int64)
    for back in (1, 2, 3):
        at = np.maximum(ends - back, 0)
        byte = data[at].astype(np.int64)
        byte += 32 * ((byte >= 65) & (byte <= 90))
        out = out * 257 + np.where(ends - back >= starts, byte + 1, 0)
    return (out * 2654435761 % (1 << 32)) * CLASSES >> 32


def held_out() -> F.Column:
    return F.coalesce(fold("doc_id", 7) == 2, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """word (64-bit hash), class and count of every training word, and the number of rows under class -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = 0
        for batch in batches:
            n_docs += batch.num_rows
            for _, _, data, offsets in text_chunks(batch.column(0)):
                h, _, starts, ends = words(data, offsets)
                if len(h):
                    unique, first, count = np.unique(h, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(suffix_class(data, starts[first], ends[first]).astype(np.int32)), pa.array(count.astype(np.int64))], names=["word", "class", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([-1], pa.int32()), pa.array([n_docs], pa.int64())], names=["word", "class", "n"])

    return train.select("text").mapInArrow(run, "word long, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


def alphabet(counts: DataFrame) -> Alphabet:
    """The alphabet from a table of word counts; what comes to the driver is bounded by SYMBOLS and CLASSES."""
    own = counts.filter("class >= 0")
    top = sorted((r[0] & ((1 << 64) - 1), r[1], r[2]) for r in most_counted(own, SYMBOLS, "word").select("word", "n", "class").collect())
    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for c, n, v in own.groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        tokens[c], distinct[c] = n, v
    docs = (counts.filter("class < 0").agg(F.sum("n")).first()[0]) or 0
    n, v = int(tokens.sum()) + docs, int(distinct.sum()) + (docs > 0)
    for _, count, c in top:
        tokens[c] -= count
        distinct[c] -= 1
    return Alphabet(np.array([t[0] for t in top], np.uint64), np.array([t[1] for t in top], np.int64), tokens, distinct, docs, n, v)


def _sequences(alpha: Alphabet, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, symbols with an end after each text, start of each text in them, hashes, owners) by chunk."""
    for lo, hi, data, offsets in text_chunks(column):
        h, owner, starts, ends = words(data, offsets)
        n = hi - lo
        first = np.searchsorted(owner, np.arange(n + 1)) + np.arange(n + 1)
        out = np.full(first[-1], alpha.end, np.int32)
        out[np.arange(len(h)) + owner] = alpha.symbols(h, suffix_class(data, starts, ends))
        yield lo, out, first, h, owner


def _normed(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


class Stretches:
    """Texts cut into stretches of SEGMENT tokens, which run side by side, longest first, states in rows.

    Cuts lose nothing. A text of several stretches is first run through each of them from every state, which gives the
    stretch's transfer matrix; the matrices, taken one after the other, tell with which state probabilities a stretch
    is entered and what the rest of the text says about the state at its end.
    """

    def __init__(self, model: Hmm, sym: np.ndarray, first: np.ndarray, both_ways: bool, kind: type = np.float64):
        size = np.diff(first)
        pieces = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[text] + SEGMENT * nth
        length = np.minimum(SEGMENT, first[text + 1] - begin)
        order = np.argsort(-length, kind="stable")
        self.start, self.move, self.sym, self.n_texts = model.start.astype(kind), model.move.astype(kind), sym, len(size)
        self.emit = np.ascontiguousarray(model.emit.T, kind)
        self.text, self.nth, self.begin, self.length = text[order], nth[order], begin[order], length[order]
        self.live = self._live(self.length)
        n, k = len(text), len(model.start)
        self.enter, self.before, self.leave = np.repeat(self.start[:, None], n, 1), np.zeros((k, n), kind), np.ones((k, n), kind)
        many = np.flatnonzero(pieces[self.text] > 1)
        if len(many):
            self._messages(many, both_ways)

    @staticmethod
    def _live(length: np.ndarray) -> np.ndarray:
        """How many stretches are longer than t, for each t."""
        return np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")

    def _messages(self, many: np.ndarray, both_ways: bool) -> None:
        k = len(self.start)
        begin, text, nth = self.begin[many], self.text[many], self.nth[many]
        # state now x state before x stretch
        through = np.where((nth == 0)[None, None, :], self.start[:, None, None], self.move.T[:, :, None])
        forth = np.ascontiguousarray(self.move.T)
        for t, n in enumerate(self._live(self.length[many])):
            now = through[:, :, :n] if t == 0 else (forth @ through[:, :, :n].reshape(k, k * n)).reshape(k, k, n)
            now = now * self.emit[:, None, self.sym[begin[:n] + t]]
            now /= now.sum((0, 1))
            through[:, :, :n] = now
        through = through.transpose(2, 1, 0)  # stretch x state before x state now
        by = np.argsort(nth, kind="stable")
        cut = np.searchsorted(nth[by], np.arange(nth.max() + 2))
        carried = np.full((self.n_texts, k), 1 / k, through.dtype)
        for i in range(len(cut) - 1):
            at = by[cut[i] : cut[i + 1]]
            own = carried[text[at]]
            if i:
                self.before[:, many[at]], self.enter[:, many[at]] = own.T, (own @ self.move).T
            carried[text[at]] = _normed(np.einsum("ni,nij->nj", own, through[at]))
        if both_ways:
            carried = np.ones((self.n_texts, k), through.dtype)
            for i in range(len(cut) - 2, -1, -1):
                at = by[cut[i] : cut[i + 1]]
                own = carried[text[at]]
                self.leave[:, many[at]] = own.T
                carried[text[at]] = _normed(np.einsum("nij,nj->ni", through[at], own))

    def forward(self, keep: bool) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """The scales of each step, and (keep) the scaled forward probabilities and the symbols' probabilities."""
        a, forth = self.enter, np.ascontiguousarray(self.move.T)
        scales, alphas, likely = [], [], []
        for t, n in enumerate(self.live):
            e = self.emit[:, self.sym[self.begin[:n] + t]]
            a = (a if t == 0 else forth @ a[:, :n]) * e
            s = a.sum(0)
            a /= s
            scales.append(s)
            if keep:
                alphas.append(a)
                likely.append(e)
        return scales, alphas, likely

    def log10_likelihood(self, scales: list[np.ndarray]) -> np.ndarray:
        """Of each text."""
        out = np.zeros(len(self.text))
        for s in scales:
            out[: len(s)] += np.log10(s, dtype=np.float64)
        return np.bincount(self.text, weights=out, minlength=self.n_texts)


def expected_counts(model: Hmm, sym: np.ndarray, first: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Baum-Welch E-step of whole texts, sym[first[i]:first[i + 1]] each: adds to emit (state x symbol); returns start
    and move counts and the log10 likelihood."""
    run = Stretches(model, sym, first, True, COUNTED)
    scales, alphas, likely = run.forward(True)
    k = len(model.start)
    start, move, ahead, later = np.zeros(k), np.zeros((k, k)), np.zeros((k, 0), COUNTED), 0
    for t in range(len(run.live) - 1, -1, -1):
        n, a = run.live[t], alphas[t]
        beta = np.empty((k, n), COUNTED)
        beta[:, :later] = run.move @ ahead
        if later < n:
            ends = run.leave[:, later:n]
            beta[:, later:] = ends / (a[:, later:] * ends).sum(0)
        ahead, later = likely[t], n
        ahead *= beta
        ahead /= scales[t]
        if t:
            move += alphas[t - 1][:, :n] @ ahead.T
        else:
            move += run.before @ ahead.T  # over the cuts; nothing stands before a first stretch
        a *= beta
        likely[t] = None
    if len(run.live):
        start = alphas[0][:, run.nth == 0].sum(1)
        flat, gamma = np.concatenate([sym[run.begin[:n] + t] for t, n in enumerate(run.live)]), np.concatenate(alphas, axis=1)
        for j in range(k):
            emit[j] += np.bincount(flat, weights=gamma[j], minlength=emit.shape[1])
    return start, model.move * move, float(run.log10_likelihood(scales).sum())


def _chunks(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK tokens; a longer text is a run of its own."""
    lo, n = 0, len(first) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(first, first[lo] + CHUNK, "right")) - 1), n)
        yield lo, hi
        lo = hi


def symbol_table(docs: DataFrame, learn: Column, alpha: Alphabet) -> DataFrame:
    """row, doc_id, learn, sym (the symbols of the text with the end), and the text's rare words with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(alpha)
    schema = "doc_id long, learn boolean, sym array<int>, rare array<long>, times array<int>"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = len(shared.value.hashes)
        for batch in batches:
            for lo, sym, first, h, owner in _sequences(shared.value, batch.column(2)):
                n = len(first) - 1
                at = np.flatnonzero(sym[np.arange(len(h)) + owner] >= common)
                order = at[np.lexsort((h[at], owner[at]))]
                rh, ro = h[order], owner[order]
                new = np.flatnonzero(np.r_[True, (rh[1:] != rh[:-1]) | (ro[1:] != ro[:-1])]) if len(rh) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rh))).astype(np.int32)
                ends = pa.array(np.searchsorted(ro[new], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sym)), pa.ListArray.from_arrays(ends, pa.array(rh[new].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), *lists], names=names)

    return saved(docs.select("doc_id", learn.alias("learn"), "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "hmm-symbols")


def baum_welch(symbols: DataFrame, alpha: Alphabet, model: Hmm) -> tuple[Hmm, float]:
    """One round over all rows of `symbol_table` to learn from: expected counts of each partition's texts, summed by Spark.

    Returns the next model and the log10 likelihood under this one. What comes to the driver is a row for each symbol.
    """
    spark, k, n_symbols = symbols.sparkSession, len(model.start), alpha.end + 1
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emit, start, move, total = np.zeros((k, n_symbols)), np.zeros(k), np.zeros((k, k)), 0.0
        for batch in batches:
            column = batch.column(0)
            first, flat = column.offsets.to_numpy(), column.values.to_numpy()
            for lo, hi in _chunks(first):
                s, m, score = expected_counts(model, flat[first[lo] : first[hi]], first[lo : hi + 1] - first[lo], emit)
                start, move, total = start + s, move + m, total + score
        some = np.flatnonzero(emit.any(0))
        rows = np.concatenate([emit[:, some].T, move, start[None, :], np.full((1, k), total)])
        ids = np.concatenate([some, -1 - np.arange(k + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(rows[:, j]) for j in range(k))], names=["symbol", *(f"s{j}" for j in range(k))])

    columns = [f"s{j}" for j in range(k)]
    sums = symbols.filter("learn").select("sym").mapInArrow(run, "symbol int, " + ", ".join(f"{c} double" for c in columns)).groupBy("symbol").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    shared.unpersist()
    counts = np.zeros((n_symbols + k + 2, k))
    counts[sums["symbol"].to_numpy()] = sums[columns].to_numpy()  # ids below 0 count from the end
    emit, move, start = counts[:n_symbols] + PRIOR * alpha.unigram()[:, None], counts[[-1 - i for i in range(k)]] + 1, counts[-1 - k] + 1
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), float(counts[-2 - k, 0])


def first_model(alpha: Alphabet, states: int = STATES) -> Hmm:
    """A fixed random model of states that tend to stay and that each prefer some of the words."""
    rng = np.random.default_rng(7)
    emit = alpha.unigram()[:, None] * rng.gamma(2.0, size=(alpha.end + 1, states))
    return Hmm(np.full(states, 1 / states), np.full((states, states), 0.05 / states) + 0.95 * np.eye(states), emit / emit.sum(0))


def fit(symbols: DataFrame, alpha: Alphabet, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch from a fixed random start; each round takes all training rows, whole."""
    model = first_model(alpha, states)
    for _ in range(rounds):
        model, _ = baum_welch(symbols, alpha, model)
    return model


def forward(model: Hmm, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Exact log10 likelihood of each text's symbols by the scaled forward recursion."""
    run = Stretches(model, sym, first, False)
    return run.log10_likelihood(run.forward(False)[0])


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every document, from the rows to learn from.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered, then one end. score is the model's log10 probability of the
    text; base_score that of the add-one unigram of the training rows. Null texts count as empty: the end alone.
    Repeated rows score alike, each with its row; other columns go. Without training rows every word is unseen. A null
    learn counts as false.
    """
    spark, learn = docs.sparkSession, F.coalesce(learn, F.lit(False))
    counts = saved(word_counts(docs.filter(learn).select(F.coalesce("text", F.lit("")).alias("text"))), "hmm-counts")
    alpha = alphabet(counts)
    table = symbol_table(docs, learn, alpha)
    shared = spark.sparkContext.broadcast((alpha, fit(table, alpha)))
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, own double"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alpha, model = shared.value
        common = len(alpha.hashes)
        log_count = np.concatenate([np.log10(alpha.counts + 1.0), np.zeros(CLASSES), [np.log10(alpha.train_docs + 1.0)]])
        known = np.concatenate([np.ones(common, bool), np.zeros(CLASSES, bool), [alpha.train_docs > 0]])
        within = np.concatenate([np.zeros(common), -np.log10(alpha.class_tokens + alpha.class_words + 1.0), [0.0]])
        floor = np.log10(alpha.train_tokens + alpha.distinct + 1.0)
        for batch in batches:
            offsets, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            for lo, hi in _chunks(offsets):
                first, sym = offsets[lo : hi + 1] - offsets[lo], flat[offsets[lo] : offsets[hi]]
                size = np.diff(first)
                base = np.add.reduceat(log_count[sym], first[:-1]) - size * floor
                own = forward(model, sym, first) + np.add.reduceat(within[sym], first[:-1])
                sure = np.add.reduceat(known[sym].astype(np.int64), first[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(sure), pa.array(base), pa.array(own)], names=names)

    parts = table.select("row", "doc_id", "sym").mapInArrow(run, schema)
    rare = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    seen = counts.filter("class >= 0").select("word", "n")
    sums = rare.join(seen.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("seen"))
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return parts.join(sums, "row", "left").select("doc_id", "n_tokens", (F.col("n_known") + found).alias("n_known"), F.lit(alpha.train_tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("own") + more).alias("score"))


def score_held_out(docs: DataFrame) -> DataFrame:
    """`score` of all documents, learned from the rows outside of the held-out fold, with held_out."""
    return score(docs, ~held_out()).withColumn("held_out", held_out())
