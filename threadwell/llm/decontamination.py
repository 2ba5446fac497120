"""Benchmark decontamination by greedy string tiling over words.

1. Seeds: the hash of min_match words from each place of each distinct item, a table (gram, item, spot).
2. Shared seeds: a bitmap of the seeds, of bounded size, goes to the tasks that read documents; what may be a seed
   there becomes a row (text, gram), and a join with the seeds tells which items share how many places with a text.
3. Bound: tiles of k words or more that cover c words hold c / k seeds at least.
4. Tiles: the two texts of each pair left come together, and the longest matches of unmarked words, found by running
   Karp-Rabin hashes of lengths that go down by halving, are marked again and again. Matches are never listed.

Texts and items go by the digest of their words' text, so copies are handled once. Neither the benchmark nor the
documents pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwell.llm.common import _WEIGHTS, mix, powers, saved, text_chunks, unused, words
from threadwell.llm.components import Filter

#: Bits of the bitmap: 64 for each seed, between these powers of two; beyond that more places pass it, and none is lost.
LEAST_BITS, MOST_BITS = 16, 27
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def ngrams(h: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each place, and the places where they lie in one text."""
    n = max(len(h) - k + 1, 0)
    total = np.full(n, k, np.uint64) * _WEIGHTS[15]
    for j in range(k):
        total += h[j : j + n] * _WEIGHTS[j]
    at = np.flatnonzero(owner[:n] == owner[k - 1 : k - 1 + n])
    return mix(total[at]), at


def rolling(seq: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each window of `size` words, from running sums."""
    total = np.zeros(len(seq) + 1, np.uint64)
    np.cumsum(seq * powers(_BASE, len(seq)), out=total[1:])
    n = max(len(seq) - size + 1, 0)
    return mix((total[size : size + n] - total[:n]) * powers(_INVERSE, n))


class Windows:
    """A text's words with its windows of `size` words in the order of their hashes."""

    def __init__(self, seq: np.ndarray, size: int):
        self.seq, self.size = seq, size
        h = rolling(seq, size)
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]


class _Side:
    """The words of one side of a tiling, the marked ones, and running sums from which any window is hashed."""

    def __init__(self, seq: np.ndarray, marked: np.ndarray):
        self.seq, self.mark = seq, bytearray(marked.astype(np.uint8).tobytes())
        self.sums = np.zeros(len(seq) + 1, np.uint64)
        np.cumsum(seq * powers(_BASE, len(seq)), out=self.sums[1:])
        self.inverse = powers(_INVERSE, len(seq))
        self.refresh()

    def refresh(self) -> None:
        """How many unmarked words begin at each place."""
        at = np.arange(len(self.seq))
        stop = np.where(np.frombuffer(self.mark, np.uint8) > 0, at, len(at))
        self.free = np.minimum.accumulate(stop[::-1])[::-1] - at
        self.longest = int(self.free.max(initial=0))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the unmarked windows of a size, and their Karp-Rabin hashes."""
        at = np.flatnonzero(self.free >= size)
        return at, mix((self.sums[at + size] - self.sums[at]) * self.inverse[at])

    def is_free(self, at: int, size: int) -> bool:
        return self.mark.find(1, at, at + size) < 0


def _shared(pattern: np.ndarray, text: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The words of the text that lie in a window that the pattern seems to have, with a marked word after each
    stretch of them, and their places in the text."""
    h = np.unique(rolling(pattern, text.size))
    first, last = np.searchsorted(text.hashes, h, "left"), np.searchsorted(text.hashes, h, "right")
    n = last - first
    at = np.sort(text.order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + text.size])
    start, stop = at[new], at[np.r_[new[1:] - 1, len(at) - 1]] + text.size
    size = stop - start + 1
    place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    gap = np.zeros(len(place), bool)
    gap[np.cumsum(size) - 1] = True
    return place, gap


def _longest(p: _Side, t: _Side, least: int, most: int) -> int:
    """A length that no unmarked match exceeds, found by halving; less than `least` if there is none. Hashes alone
    decide, so chance may make it too long, never too short."""

    def common(size: int) -> bool:
        return bool(np.isin(p.windows(size)[1], t.windows(size)[1]).any())

    most, step = min(most, p.longest, t.longest), 1
    if most < least or common(most):
        return most
    while most - step >= least and not common(most - step):  # most has none
        most, step = most - step, 2 * step
    low = max(most - step, least - 1)  # has one, or is too short
    while most - low > 1:
        middle = (low + most) // 2
        low, most = (middle, most) if common(middle) else (low, middle)
    return low


def _mark_all(p: _Side, t: _Side, size: int) -> list[tuple[int, int]]:
    """Mark the matches of the longest length, in the order of their places, each in the first free place of the text."""
    starts, h = t.windows(size)
    order = np.argsort(h, kind="stable")
    starts, h = starts[order].tolist(), h[order]
    at, own = p.windows(size)
    first, last = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
    some = np.flatnonzero(first < last)
    taken, tiles = {}, []
    for i, lo, hi in zip(at[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
        if not p.is_free(i, size):
            continue
        slot = taken.get(lo, lo)
        while slot < hi and not t.is_free(starts[slot], size):  # what is marked stays so
            slot += 1
        taken[lo] = slot
        for j in starts[slot:hi]:
            if t.is_free(j, size) and np.array_equal(p.seq[i : i + size], t.seq[j : j + size]):
                p.mark[i : i + size] = t.mark[j : j + size] = b"\1" * size
                tiles.append((i, j))
                break
    return tiles


def greedy_tiles(pattern: np.ndarray, text: np.ndarray | Windows, min_match: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (pattern start, text start, length), each the longest match left when it was marked.

    Of equal lengths the one with the first pattern start goes first, then with the first text start. Lengths go down:
    halving finds the next that unmarked windows of both sides share, and one pass marks all its matches. Matches are
    never listed, so memory is that of the two texts, and time that of their words for each length that tiles have
    (fewer than the root of twice the pattern's words) and step of halving, however often words repeat.
    """
    if not isinstance(text, Windows):
        text = Windows(np.asarray(text, np.uint64), min_match)
    pattern = np.asarray(pattern, np.uint64)
    place, gap = _shared(pattern, text)
    if not len(place):
        return []
    p, t, tiles = _Side(pattern, np.zeros(len(pattern), bool)), _Side(text.seq[np.where(gap, 0, place)], gap), []
    size = _longest(p, t, min_match, len(pattern))
    while size >= min_match:
        tiles += [(i, int(place[j]), size) for i, j in _mark_all(p, t, size)]
        p.refresh()
        t.refresh()
        size = _longest(p, t, min_match, size - 1)
    return tiles


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _seeds(items: DataFrame, min_match: int) -> DataFrame:
    """gram, k, item, n and spot of every place of the items; an item of fewer words has one gram, all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                h, owner, _, _ = words(data, offsets)
                n = np.bincount(owner, minlength=hi - lo)
                start = np.cumsum(n) - n
                for k in range(1, min_match + 1):
                    g, at = ngrams(h, owner, k)
                    use = n[owner[at]] >= k if k == min_match else n[owner[at]] == k
                    g, at = g[use], at[use]
                    own = owner[at]
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), k, np.int32)), batch.column(0).slice(lo, hi - lo).take(pa.array(own)), pa.array(n[own].astype(np.int32)), pa.array((at - start[own]).astype(np.int32))], names=["gram", "k", "item", "n", "spot"])

    return items.mapInArrow(run, "gram long, k int, item binary, n int, spot int")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Which low bits of a gram occur among the seeds: 2**MOST_BITS bits at most, 16 MB."""
    log_bits = min(max((64 * seeds.count()).bit_length(), LEAST_BITS), MOST_BITS)
    at = F.col("gram").bitwiseAND(F.lit((1 << log_bits) - 1))
    rows = seeds.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    out = np.zeros(1 << (log_bits - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _found(docs: DataFrame, benchmark: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """body and item (digests), n_tiles, covered and item_words of each pair of texts that reaches the threshold."""
    spark = docs.sparkSession
    items = saved(benchmark.select(_digest().alias("item"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["item"]), "bench-items")
    seeds = saved(_seeds(items, min_match), "bench-seeds")
    sizes = sorted(r[0] for r in seeds.select("k").distinct().collect())  # min_match values at most
    shared = spark.sparkContext.broadcast(_bitmap(seeds))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        low = np.uint64(64 * len(bits) - 1)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                h, owner, _, _ = words(data, offsets)
                grams, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for k in sizes:
                    g, at = ngrams(h, owner, k)
                    may = np.flatnonzero((bits[((g & low) >> np.uint64(6)).astype(np.int64)] >> (g & np.uint64(63))) & np.uint64(1))
                    grams.append(g[may])
                    own.append(owner[at[may]])
                pairs = np.unique(np.stack([np.concatenate(own), np.concatenate(grams).view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(pairs[:, 0])), pa.array(pairs[:, 1])], names=["body", "gram"])

    texts = docs.select(_digest().alias("body"), "text")
    hits = texts.mapInArrow(find, "body binary, gram long").distinct()
    common = hits.join(seeds, "gram").groupBy("body", "item", "n", "k").agg(F.count("*").alias("places"))
    pairs = saved(common.filter(F.col("places") * F.col("k") >= F.ceil(F.col("n") * threshold - 1e-9)).drop("places"), "bench-pairs")
    wanted = pairs.select("body").distinct()
    own = Filter.of(wanted, "body", pairs.count()).keep(texts, "body").join(wanted, "body", "left_semi").dropDuplicates(["body"])
    both = pairs.join(own, "body").join(items.withColumnRenamed("text", "wording"), "item").select("body", "item", "k", "text", "wording")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        held: Windows | None = None
        for batch in batches:
            rows = []
            for body, item, k, text, wording in zip(*(c for c in batch.columns), strict=True):
                seq = [words(d, o)[0] for _, _, d, o in text_chunks(pa.array([wording.as_py()], pa.large_string()))][0]
                if last != (body.as_py(), k.as_py()):
                    last = body.as_py(), k.as_py()
                    held = Windows([words(d, o)[0] for _, _, d, o in text_chunks(pa.array([text.as_py()], pa.large_string()))][0], last[1])
                tiles = greedy_tiles(seq, held, last[1])
                covered = sum(x[2] for x in tiles)
                if covered >= threshold * len(seq) - 1e-9:
                    rows.append((last[0], item.as_py(), len(tiles), covered, len(seq)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["body", "item", "n_tiles", "covered", "item_words"])

    return saved(both.mapInArrow(tile, "body binary, item binary, n_tiles int, covered int, item_words int"), "bench-found")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_tiles, covered, item_words, coverage of each document that holds a benchmark item.

    A document holds an item if tiles of `min_match` words or more cover `threshold` of the item's words, in any
    order; an item of fewer words must be there whole. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered. Null and
    empty texts on either side match nothing; repeated rows report again, each with its id, null ids too; an empty
    table on either side gives none; other columns go. Documents are read twice, and only texts that share enough
    seeds with an item are shuffled.
    """
    found = _found(docs, benchmark, min_match, threshold)
    rows = docs.select("doc_id", _digest().alias("body"))
    held = Filter.of(found.select("body"), "body").keep(rows, "body").join(found, "body")
    named = held.join(benchmark.select("item_id", _digest().alias("item")), "item")
    return named.select("doc_id", "item_id", "n_tiles", "covered", "item_words", (F.col("covered") / F.col("item_words")).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item in the sense of `contaminated`."""
    bad = saved(_found(docs, benchmark, min_match, threshold).select("body").distinct(), "bench-bodies")
    body, some = unused(docs, "body"), Filter.of(bad, "body")
    keyed = docs.withColumn(body, _digest())
    left = some.keep(keyed, body).join(bad.withColumnRenamed("body", body), body, "left_anti")
    return some.keep(keyed, body, among=False).unionByName(left).select(*(F.col(f"`{c}`") for c in docs.columns))
