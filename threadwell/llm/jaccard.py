"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles. Equal sets are one node, named by its smallest doc_id. Shingles have a global
order, common ones last and else by hash, and a set's prefix is its first n - ceil(t n) + 1 shingles: two sets that
reach the threshold t share a shingle of their prefixes. The steps:

1. Partition: in the rarest and the commonest prefix shingles that a set shares, it is tied to the least edited set
   there, its centre, if an exact comparison links them. What hangs together is a group; most are single documents.
2. Matrix: the union of the prefixes of each group, as rows (shingle, group).
3. Bound, in the join of queries and matrix itself, so that only groups which may qualify become rows: shingles of a
   prefix that no other prefix has, before a shared one, are in neither common part; the parity sketches of q and of
   the group's head differ in d bits and those of the head and its members in r at most, so q and any member differ
   in d - r shingles at least. After it, q has at most c + |q| - a shingles in common with a member, where a of its
   shingles lie before the end of the group's shortest-reaching prefix and c of those are in the group's union. Only
   groups where that and the sizes allow the threshold are opened.
4. Open: first the group's head is compared with q; only where that does not join the two, its members are.

So a family of n near copies costs about n comparisons, while every pair of different texts at or over the threshold
that would join two components is found. In a family of n texts that are all just below the threshold, pairs that
share a prefix shingle are still judged one by one, but by numbers in the join, without rows or texts. Comparisons are
exact, on 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadwell.llm.common import distinct_by_text, mix, most_counted, partitions, saved, shingles, text_chunks, words
from threadwell.llm.components import Filter, connected_components, merged_components

#: Common shingles that the order knows of; a task counts them in stretches of so many shingles, and one must occur so
#: often in a stretch to be counted.
COMMON, STRETCH, LOCAL = 1 << 17, 1 << 21, 3
#: Expected sets of one shingle (or partners of one centre) that one task handles together.
SALT_ROWS = 200
#: Prefix shingles by which a set seeks a centre: so many of the rarest that it shares, and of the commonest.
SEEDS = 3
#: 64-bit words of a set's sketch.
SKETCH = 8


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The COMMON shingles most counted, over all documents, and log2 of their counts. Only the order depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            unique, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            found.clear()
            many = count >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(unique[many].view(np.int64)), pa.array(count[many])], names=["shingle", "n"])

        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(0)):
                h, owner, _, _ = words(data, offsets)
                found.append(distinct_by_text(*shingles(h, owner, hi - lo, k))[0])
                if sum(map(len, found)) >= STRETCH:
                    yield counted()
        yield counted()

    rows = most_counted(saved(docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "jaccard-common"), COMMON, "shingle").toPandas()
    h = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.minimum(np.log2(np.maximum(rows["n"].to_numpy(np.int64), 1)).astype(np.int64) + 1, 31)[order]


def keys(h: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Order keys of shingles: 5 bits of commonness over 58 bits of hash."""
    out = (h >> np.uint64(6)).astype(np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        out |= np.where(common[0][at] == h, common[1][at], 0) << 58
    return out


def sketches(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """SKETCH words for each set h[cut[i]:cut[i + 1]]: bit j is the parity of the shingles that hash to j.

    A shingle of only one of two sets flips one bit, so two sketches differ in at most as many bits as the sets do
    in shingles: an exact upper bound of what they have in common.
    """
    own = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    at = (mix(h) % np.uint64(64 * SKETCH)).astype(np.int64)
    odd = (np.bincount(own * 64 * SKETCH + at, minlength=(len(cut) - 1) * 64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def sketch_gap(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH)), F.lit(0))


def gap_fits(gap: Column, total: Column, num: int, den: int) -> Column:
    """Whether sets of `total` shingles together that differ in at least `gap` may reach the threshold t.

    |x & y| >= t / (1 + t) (|x| + |y|) says that |x ^ y| <= (1 - t) / (1 + t) (|x| + |y|).
    """
    return gap * (den + num) <= total * (den - num)


def prefixes(docs: DataFrame, k: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), sketch and ascending prefix keys of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                h, owner, _, _ = words(data, offsets)
                h, owner = distinct_by_text(*shingles(h, owner, hi - lo, k))
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                n = np.diff(cut)
                digest = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).hexdigest() if b > a else None for a, b in zip(cut, cut[1:], strict=False)]
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * SKETCH), pa.array(sketches(h, cut)))
                key = keys(h, shared.value)
                key = key[np.lexsort((key, owner))]
                take = np.arange(len(key)) - cut[owner] < (n - (num * n + den - 1) // den + 1)[owner]
                ends = np.searchsorted(owner[take], np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(digest, pa.string()), sketch, pa.ListArray.from_arrays(pa.array(ends), pa.array(key[take]))], names=["doc_id", "n_shingles", "digest", "sketch", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest string, sketch array<long>, prefix array<long>")


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of doc_ids whose sets reach the threshold num/den; again for rows that repeat a doc_id.

    Each set is made once and goes to each of its pairs' a (salted, so that a much wanted centre is spread over
    tasks); a task holds one centre's set and streams its partners by.
    """
    spark = docs.sparkSession
    pairs = saved(pairs, "jaccard-pairs")
    n = pairs.count()
    if not n:
        return pairs
    salted = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts")), "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int"))
    need = salted.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("role")).unionByName(salted.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0).alias("role")).distinct())
    some = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    texts = Filter.of(some, "doc_id", 2 * n).keep(docs.select("doc_id", "text"), "doc_id").join(some, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                h, owner, _, _ = words(data, offsets)
                h, owner = distinct_by_text(*shingles(h, owner, hi - lo, k))
                cut = np.searchsorted(owner, np.arange(hi - lo + 1)) * 8
                whole = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), whole.cast(pa.binary())], names=["doc_id", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre: tuple | None = None
        held: list[np.ndarray] = []
        for batch in batches:
            found = []
            for a, salt, role, b, own in zip(*(batch.column(i) for i in range(5)), strict=True):
                here = (a.as_py(), salt.as_py())
                value = np.frombuffer(own.as_buffer(), np.uint64)
                if role.as_py() == 0:
                    held = [*held, value] if here == centre else [value]
                    centre = here
                elif here == centre:
                    for other in held:
                        if num * len(value) > den * len(other) or num * len(other) > den * len(value):
                            continue
                        both = len(np.intersect1d(value, other, assume_unique=True))
                        if den * both >= num * (len(value) + len(other) - both):
                            found.append((here[0], b.as_py()))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return (
        need.join(texts.select("doc_id", "text").mapInArrow(sets, "doc_id long, own binary"), "doc_id")
        .select("a", "salt", "role", "doc_id", "own")
        .repartition(partitions(spark), "a", "salt")
        .sortWithinPartitions("a", "salt", "role")
        .mapInArrow(compare, "a long, b long")
    )


def plausible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that the prefixes of both sides allow: shingles outside of the shared stretch may all agree, no more."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").filter((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num))
    both = both.withColumn("cut", F.least(F.element_at("pa", -1), F.element_at("pb", -1)))
    rest = F.least(*(F.col(f"n{x}") - F.size(F.filter(f"p{x}", lambda y: y <= F.col("cut"))) for x in "ab"))
    share = F.size(F.array_intersect("pa", "pb"))
    return both.filter((share > 0) & ((share + rest) * (num + den) >= num * (F.col("na") + F.col("nb")))).select("a", "b")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and copies (documents with an equal set) of every document.

    Sets are the distinct k-word shingles of the lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+`; with fewer words, the
    whole sequence. Documents link when den * |intersection| >= num * |union|; component_id is the smallest doc_id
    that links reach. Null, empty and blank texts have no shingles and stand alone. A null doc_id keeps its row, and
    has the component of its equals, else null. Rows that repeat a doc_id are one document: it links if any of its
    texts does. An empty table gives no rows.
    """
    rows = saved(prefixes(docs, k, num, den, common_shingles(docs, k)), "jaccard-rows")
    some = rows.filter("digest is not null and doc_id is not null")
    first = some.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    nodes = rows.filter("digest is not null").join(first, "digest").filter("doc_id = node").select("node", F.col("n_shingles").alias("n"), "sketch", "prefix").dropDuplicates(["node", "n", "sketch", "prefix"])
    nodes = saved(nodes, "jaccard-nodes")

    # shingles in the prefix of two sets or more; room is what a set can share with another set that has the shingle:
    # all but the earlier shingles of its prefix that no other prefix has, since the other set would have them there
    held = nodes.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))
    shared = held.groupBy("shingle").agg(F.count("*").alias("m")).filter("m > 1")
    live = held.join(shared, "shingle")
    live = live.withColumn("seed", F.row_number().over(Window.partitionBy("node").orderBy("shingle"))).withColumn("room", F.col("n") - (F.col("at") - F.col("seed") + 1))
    live = live.withColumn("last", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shingle"))))
    live = saved(live.drop("at"), "jaccard-live")

    # 1. partition around centres: of all sets with a shingle, the one with the most room for its size, so that of a
    # family of edited copies it is the original, or the least edited; the salt only spreads the join
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / SALT_ROWS))
    seeds = live.filter((F.col("seed") <= SEEDS) | (F.col("last") <= SEEDS)).withColumn("salt", salt)
    best = live.groupBy("shingle").agg(F.min_by("node", F.struct(F.col("n") - F.col("room"), "node")).alias("a"))
    centres = seeds.select("shingle", "salt").distinct().join(best, "shingle")
    stars = seeds.join(centres, ["shingle", "salt"]).filter("a != node").select("a", F.col("node").alias("b")).distinct()
    links = saved(verified(plausible(stars, nodes, num, den), docs, k, num, den), "jaccard-links")
    label = saved(connected_components(links), "jaccard-labels")

    def grouped(df: DataFrame, labels: DataFrame, name: str = "node", to: str = "group") -> DataFrame:
        return df.join(labels.select(F.col("node").alias(name), F.col("component").alias(to)), name, "left").withColumn(to, F.coalesce(to, name))

    # 2. the matrix, of the shingles that two groups hold, and what the bound needs of each group
    members = saved(grouped(nodes.select("node", "n", "sketch", F.element_at("prefix", -1).alias("reach")), label), "jaccard-groups")
    heads = members.filter("node = group").select("group", F.col("sketch").alias("other_sketch"))
    spread = members.filter("node != group").join(heads, "group").groupBy("group").agg(F.max(sketch_gap("sketch", "other_sketch")).alias("radius"))
    groups = members.groupBy("group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("reach").alias("reach"))
    groups = groups.join(heads, "group").join(spread, "group", "left").withColumn("radius", F.coalesce("radius", F.lit(0)))
    tokens = live.select("shingle", "node", "n", "room").join(members.select("node", "group"), "node")
    several = tokens.groupBy("shingle").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("shingle")
    tokens = saved(tokens.join(several, "shingle"), "jaccard-tokens")
    matrix = tokens.groupBy("shingle", "group").agg(F.max("room").alias("other_room"), F.min("n").alias("other_n")).join(groups, "group")
    matrix = matrix.select("shingle", F.col("group").alias("other"), "other_room", "other_n", "least", "most", "reach", "other_sketch", "radius")

    # 3. bound; of two groups, the members of the first are the queries
    size_fits = (F.col("most") * den >= F.col("n") * num) & (F.col("least") * num <= F.col("n") * den)
    room_fits = F.least("room", "other_room") * (num + den) >= num * (F.col("n") + F.col("other_n"))
    near = gap_fits(sketch_gap("sketch", "other_sketch") - F.col("radius"), F.col("n") + F.col("most"), num, den)
    asked = tokens.join(members.select("node", "sketch"), "node")
    hits = asked.join(matrix, "shingle").filter((F.col("group") < F.col("other")) & size_fits & room_fits & near)
    # any shared prefix shingle makes a candidate, but only those up to the reach count as seen: the rest is open
    hits = hits.groupBy("node", "group", "other", "least", "most", "reach").agg(F.count_if(F.col("shingle") <= F.col("reach")).alias("c"))
    rest = F.col("n") - F.size(F.filter("prefix", lambda y: y <= F.col("reach")))
    opened = hits.join(nodes, "node").filter((F.col("c") + rest) * (num + den) >= num * (F.col("n") + F.col("least"))).select("node", "n", "sketch", "group", "other")
    opened = saved(opened, "jaccard-opened")

    # 4. open: the head first, members only where that leaves the two apart; of pairs of sets, first what the sketches
    # allow
    fits = gap_fits(sketch_gap("sketch", "other_sketch"), F.col("n") + F.col("other_n"), num, den)
    centre = members.filter("node = group").select(F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("sketch").alias("other_sketch"))
    to_centre = opened.join(centre, "other").filter(fits).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = saved(verified(to_centre, docs, k, num, den), "jaccard-links")
    label = merged_components(label, links)
    apart = grouped(grouped(opened, label, "node", "x"), label, "other", "y").filter("x != y")
    inner = members.select(F.col("group").alias("other"), F.col("node").alias("member"), F.col("n").alias("other_n"), F.col("sketch").alias("other_sketch")).filter("member != other")
    to_members = apart.join(inner, "other").filter(fits).select(F.least("node", "member").alias("a"), F.greatest("node", "member").alias("b")).distinct()
    links = saved(verified(to_members, docs, k, num, den), "jaccard-links")
    label = merged_components(label, links)

    named = grouped(first, label, "node", "component_id").select("digest", "component_id", "copies")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, without those of a larger doc_id than another of their component.

    Rows that repeat the doc_id that stays are one document and all stay. Documents without shingles and null doc_ids
    stand alone and stay. Only the ids that go are joined back; texts that surely stay are not
    shuffled.
    """
    classes = jaccard_components(docs, k, num, den)
    gone = saved(classes.filter("component_id < doc_id").select("doc_id").distinct(), "jaccard-gone")
    some = Filter.of(gone, "doc_id")
    left = some.keep(docs, "doc_id").join(gone, "doc_id", "left_anti")  # a null id equals none, so it stays
    return some.keep(docs, "doc_id", among=False).unionByName(left.select(*(F.col(f"`{c}`") for c in docs.columns)))
