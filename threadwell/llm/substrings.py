"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Every stretch of LENGTH bytes has an anchor: the place with the smallest hash of GRAM bytes among its first REACH
places, so equal stretches have it at the same distance. A stretch can only repeat if the HEAD bytes from its anchor
do; those are counted over all documents, and only suffixes at anchors with a repeated head are sorted:

1. Each task sorts its suffixes (with the bytes before them that their stretches need), merges equal ones, and sends
   each bucket a front-coded run: the common prefix with the entry before, and the rest.
2. A bucket, which holds all suffixes with the same head, merges its runs by a loser tree whose nodes know how many
   bytes a loser shares with the last winner: known prefixes are never compared again. A head at more than HOT places
   is split: its stretches go by bands of BAND distances from the anchor, and by the bytes that all equal stretches of
   a band have in common, so that near copies of a passage part wherever they differ.
3. The merged common prefixes say which suffixes agree on the rest of a stretch; together with a running hash of the
   bytes before the anchor they tell which stretches repeat.

Equal suffixes are merged where they arise and a table of members, keyed by their digest, brings the answer back, so
a stretch copied into a third of all documents is sorted about once for each task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwell.llm.common import partitions, prefix_hash, range_hash, saved, text_chunks
from threadwell.llm.components import Filter

LENGTH = 400
GRAM = 24
HOT, BAND = 1000, 25
#: Places of a run of texts. Hashes give way to them by as many bits in every run, or equal stretches in runs of different
#: sizes would part where two hashes agree in what is left.
_PLACE_BITS = np.uint64(31)
_RAW = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NO_ID = (1 << 63) - 1


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, least and greatest distance of the stretches' starts before it, hash of its head) of each anchor."""
    reach = length // 2
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    if not len(long):
        e = np.zeros(0, np.int64)
        return e, e, e, e, np.zeros(0, np.uint64)
    prefix = prefix_hash(data, _RAW)
    at = np.arange(len(data) - min(GRAM, reach) + 1)
    best = (range_hash(prefix, at, at + min(GRAM, reach)) >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
    have = 1
    while have < reach:
        more = min(have, reach - have)
        best = np.minimum(best[:-more], best[more:])
        have += more
    starts = np.concatenate([np.arange(offsets[i], offsets[i + 1] - length + 1) for i in long])
    chosen = (best[starts] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:] - 1, len(chosen) - 1]
    place = chosen[first]
    return np.searchsorted(offsets, place, "right") - 1, place, place - starts[last], place - starts[first], range_hash(prefix, place, place + length - reach + 1)


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, of which `at` bytes are known."""
    most = min(len(a), len(b))
    while at < most and a[at : at + 32] == b[at : at + 32]:
        at += 32
    while at < most and a[at] == b[at]:
        at += 1
    return min(at, most)


def front_code(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of (suffix, bytes before, least, greatest, times): each suffix by what it shares with the last."""
    out, last = [], b""
    for suffix, before, least, greatest, times in entries:
        shared = common_prefix(last, suffix, 0)
        out.append(struct.pack("<HHHHHI", shared, len(suffix) - shared, len(before), least, greatest, times))
        out += [suffix[shared:], before]
        last = suffix
    return b"".join(out)


def decoded(block: bytes) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """(common prefix with the entry before, suffix, bytes before, least, greatest, times) of a run's entries."""
    at, last = 0, b""
    while at < len(block):
        shared, n, m, least, greatest, times = struct.unpack_from("<HHHHHI", block, at)
        at += 14
        last = last[:shared] + block[at : at + n]
        yield shared, last, block[at + n : at + n + m], least, greatest, times
        at += n + m


def merge_runs(blocks: list[bytes]) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """All entries of the runs in order, each with its common prefix with the one before.

    A loser tree. A candidate's first field is what it shares with the last winner. Both candidates of a match are not
    before that winner, so the one that shares more comes first, unseen; only on a tie are bytes compared, from there
    on, and the loser then knows what it shares with the new winner.
    """
    runs = [decoded(b) for b in blocks]
    n = 1
    while n < len(runs):
        n *= 2
    head: list = [next(r, None) for r in runs] + [None] * (n - len(runs))
    known = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        s, t = x[1], y[1]
        shared = common_prefix(s, t, known[a])
        if shared == len(s) or shared < len(t) and s[shared] < t[shared]:
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    loser = [0] * n
    up = list(range(n))
    level = n
    while level > 1:
        level //= 2
        nxt = []
        for i in range(level):
            won, lost = play(up[2 * i], up[2 * i + 1])
            loser[level + i] = lost
            nxt.append(won)
        up = nxt
    best = up[0]
    while head[best] is not None:
        entry = head[best]
        yield known[best], *entry[1:]
        head[best] = next(runs[best], None)
        known[best] = head[best][0] if head[best] is not None else 0
        at = (best + n) // 2
        while at:
            best, loser[at] = play(best, loser[at])
            at //= 2


def repeated(entries: list[tuple[int, bytes, bytes, int, int, int]], length: int) -> np.ndarray:
    """For each merged entry and each distance of a stretch's start before the anchor: whether that stretch repeats."""
    reach, n = length // 2, len(entries)
    shared = np.array([e[0] for e in entries])
    size, before, least, greatest, times = (np.array([f(e) for e in entries]) for f in (lambda e: len(e[1]), lambda e: len(e[2]), lambda e: e[3], lambda e: e[4], lambda e: e[5]))
    left = np.zeros((n, reach), np.uint8)  # the byte at distance d before the anchor in column d - 1
    for i, e in enumerate(entries):
        if e[2]:
            left[i, : len(e[2])] = np.frombuffer(e[2], np.uint8)[::-1]
    out, h = np.zeros((n, reach), bool), np.zeros(n, np.uint64)
    power, base = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for d in range(reach):
            if d:
                power = power * base
                h = h + _RAW[left[:, d - 1]] * power
            at = np.flatnonzero((least <= d) & (d <= greatest) & (before >= d) & (size >= length - d))
            if len(at) == 0:
                continue
            same = np.cumsum(shared < length - d)[at]
            order = np.lexsort((h[at], same))
            a, b = same[order], h[at][order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            total = np.add.reduceat(times[at][order], first)
            out[at[order], d] = np.repeat(total > 1, np.diff(np.r_[first, len(order)]))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, tag and text: documents by id, and by a 64-bit hash of the text for ids that repeat or are null."""
    return docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "doc_id", "text")


def _suffix_runs(flagged: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Front-coded runs (bucket, block) and members (ctx, doc, tag, place) of the flagged anchors' suffixes."""
    schema = "bucket int, block binary, ctx binary, doc long, tag long, place int"
    names, band = [x.split(" ")[0] for x in schema.split(", ")], min(BAND, max(length // 8, 1))
    types = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple, int]] = {}
        weight = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, entries in sorted(held.items()):
                block = front_code([(*k, n) for k, n in sorted(entries.items())])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((bucket, block, None, None, None, None), types, strict=True)], names=names)
            held.clear()

        for batch in batches:
            wanted = batch.column(3)
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                raw = data.tobytes()
                text, place, least, greatest, h = anchors(data, offsets, length)
                cut = np.searchsorted(text, np.arange(hi - lo + 1))
                members = []
                for i in range(hi - lo):
                    marks = wanted[lo + i].values.to_numpy()  # twice the place, and one more where the head is hot
                    local = place[cut[i] : cut[i + 1]] - offsets[i]
                    own = np.flatnonzero(np.isin(local, marks >> 1)) + cut[i]
                    hot = set(marks[marks & 1 == 1] >> 1)
                    doc, tag = batch.column(0)[lo + i].as_py(), batch.column(1)[lo + i].as_py()
                    for j in own:
                        p, least_j, greatest_j, at = int(place[j]), int(least[j]), int(greatest[j]), int(place[j] - offsets[i])
                        if at in hot:
                            bands = [(d, d + band - 1) for d in range(least_j // band * band, greatest_j + 1, band)]
                        else:
                            bands = [(0, length)]
                        for near, far in bands:
                            a, b = max(least_j, near), min(greatest_j, far)
                            suffix, before = raw[p : p + length - a], raw[p - b : p]
                            bucket = zlib.crc32(raw[p - near : p + length - far]) if at in hot else int(h[j])
                            entries = held.setdefault(bucket % n_buckets, {})
                            key = (suffix, before, a, b)
                            if key not in entries:
                                weight += len(suffix) + len(before)
                            entries[key] = entries.get(key, 0) + 1
                            members.append((_context(suffix, before, a, b), doc, tag, at))
                if members:
                    ctx, doc, tag, at = zip(*members, strict=True)
                    none = [None] * len(members)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((none, none, ctx, doc, tag, at), types, strict=True)], names=names)
                if weight > 48 << 20:
                    yield from flush()
                    weight = 0
        yield from flush()

    return flagged.select("doc", "tag", "text", "places").mapInArrow(run, schema)


def _context(suffix: bytes, before: bytes, least: int, greatest: int) -> bytes:
    return hashlib.blake2b(struct.pack("<HHH", least, greatest, len(before)) + before + suffix, digest_size=16).digest()


def _answers(runs: DataFrame, length: int) -> DataFrame:
    """ctx and the bits of its repeated stretches, for the suffixes that have any."""
    spark = runs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def buckets() -> Iterator[list[bytes]]:
            now, blocks = None, []
            for batch in batches:
                for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if bucket != now and blocks:
                        yield blocks
                        blocks = []
                    now = bucket
                    blocks.append(block)
            if blocks:
                yield blocks

        for blocks in buckets():
            for entries in _classes(merge_runs(blocks), length):
                hit = repeated(entries, length)
                some = np.flatnonzero(hit.any(1))
                if len(some):
                    ctx = [_context(*entries[i][1:5]) for i in some]
                    yield pa.RecordBatch.from_arrays([pa.array(ctx, pa.binary()), pa.array([x.tobytes() for x in np.packbits(hit[some], axis=1)], pa.binary())], names=["ctx", "bits"])

    by_bucket = runs.filter("block is not null").select("bucket", "block").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(run, "ctx binary, bits binary").dropDuplicates(["ctx"])


def _classes(merged: Iterator[tuple], length: int, batch: int = 4096) -> Iterator[list[tuple]]:
    """Merged entries in lists of about `batch` that part only where fewer bytes than a head are shared."""
    out: list[tuple] = []
    for e in merged:
        if len(out) >= batch and e[0] < length - length // 2 + 1:
            yield out
            out = []
        out.append(e)
    if out:
        yield out


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with_text) spans and text of every document.

    Texts are UTF-8 bytes. Each byte of a stretch of `length` bytes that also starts anywhere else, in this document
    or another, overlapping or not, is removed, judged on the texts as they came. spans are the maximal removed runs
    (start, end); text is what is left, with bytes of broken characters dropped (kept_sha256 has them). Null texts
    count as empty. A row that repeats another is another document, so both lose what is long enough. Other columns
    go. An empty table gives no rows. The texts of documents without a repeated head are not shuffled.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                text, place, _, _, h = anchors(data, offsets, length)
                doc, tag = (batch.column(i).slice(lo, hi - lo).to_numpy(zero_copy_only=False)[text] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array((place - offsets[text]).astype(np.int32)), pa.array(h.view(np.int64))], names=["doc", "tag", "place", "head"])

    heads = keyed.select("doc", "tag", "text").mapInArrow(find, "doc long, tag long, place int, head long")
    many = saved(heads.groupBy("head").agg(F.count("*").alias("m")).filter("m > 1").select("head", (F.col("m") > HOT).cast("int").alias("hot")), "substring-heads")
    marks = F.collect_set(2 * F.col("place") + F.col("hot"))
    places = saved(heads.join(many, "head").groupBy("doc", "tag").agg(marks.alias("places")), "substring-places")
    key = F.xxhash64("doc", "tag")
    some = Filter.of(places.select(key.alias("key")), "key")
    texts = some.keep(keyed.withColumn("key", key), "key").join(places, ["doc", "tag"])
    runs = saved(_suffix_runs(texts, length, 8 * partitions(spark)), "substring-runs")
    members = runs.filter("ctx is not null").select("ctx", "doc", "tag", "place")
    answers = saved(_answers(runs, length), "substring-answers")  # written, so that a suffix of very many members can be split in the join
    spans = members.join(answers, "ctx").select("doc", "tag", F.struct("place", "bits").alias("hit")).distinct()
    spans = saved(spans.groupBy("doc", "tag").agg(F.collect_list("hit").alias("hits")), "substring-spans")

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start: bigint, end: bigint>>, text string" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pair), pa.string()][: 7 if with_text else 5]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"][: len(types)]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for me, text, hits in zip(*(batch.column(i).slice(at, 1000) for i in range(3)), strict=True):
                    raw = text.as_py() or b""
                    found = _spans(hits.as_py() or [], len(raw), length)
                    kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in found)], [*(s for s, _ in found), len(raw)], strict=True))
                    row = (me.as_py(), len(raw), len(raw) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in found], kept.decode("utf-8", "ignore"))
                    rows.append(row[: len(types)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    all_keyed = keyed.withColumn("key", key)
    raw_text = F.col("text").cast("binary").alias("text")  # broken UTF-8 stays as it is
    touched = Filter.of(spans.select(key.alias("key")), "key")
    changed = touched.keep(all_keyed, "key").join(spans, ["doc", "tag"], "left").select("doc_id", raw_text, "hits")
    same = touched.keep(all_keyed, "key", among=False).select("doc_id", raw_text, F.lit(None).cast(spans.schema["hits"].dataType).alias("hits"))
    return changed.mapInArrow(cut, schema).unionByName(same.mapInArrow(cut, schema))


def _spans(hits: list[dict], size: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs from anchors and their repeated distances."""
    if not hits:
        return []
    edge = np.zeros(size + 1, np.int64)
    for hit in hits:
        far = np.flatnonzero(np.unpackbits(np.frombuffer(hit["bits"], np.uint8)))
        start = hit["place"] - far
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
    inside = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b)) for a, b in zip(change[::2], change[1::2], strict=True)]
