"""Connected components and fixed-size membership filters, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threadwell.llm.common import discard, in_session, saved, unused


#: Edges of one node in a round's join that are one task's share; a node with more is dealt to several.
HUB = 1_000_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node of an undirected graph with long node ids.

    Alternating large-star and small-star rounds: each links a node's larger neighbours, then its smaller ones, to
    the smallest. Minima are aggregated before they are shuffled; the edges of a hub are joined, never collected, and
    dealt to tasks of HUB edges. Every round is written to the shared folder, by a session of its own (`_quiet`). Joins
    are told to merge: small rounds would else be sent through the driver, time and again. Loops, repeated edges and
    null ends are dropped.
    """
    spark = edges.sparkSession
    quiet = _quiet(spark)
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs, now = _counted(pairs, quiet)
    state = None
    while now != state and now[0]:
        state = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, now[0], own=True).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(large, now[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        before, (pairs, now) = pairs, _counted(small.unionByName(least).distinct(), quiet)
        discard(before)
    pairs = in_session(pairs, spark)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _with_least(edges: DataFrame, n: int, own: bool = False) -> DataFrame:
    """Edges (u, v) with m, the least v of each u (with own, u itself if it is less). n bounds the edges, up to two."""
    m = F.least("u", F.min("v")) if own else F.min("v")
    least = edges.groupBy("u").agg(m.alias("m"), F.count("*").alias("d"))
    if n <= HUB:
        return edges.join(least.drop("d").hint("merge"), "u")
    least = saved(least, "cc-least")
    hubs = F.broadcast(least.filter(F.col("d") > HUB).select("u", F.ceil(F.col("d") / HUB).alias("shares")))  # 2 n / HUB rows at most
    share = F.coalesce(F.pmod(F.xxhash64("v"), F.col("shares")), F.lit(0))
    dealt = edges.join(hubs, "u", "left").select("u", "v", share.alias("share"))
    shares = least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("d") > HUB, F.ceil(F.col("d") / HUB) - 1).otherwise(0))).alias("share"))
    return dealt.join(shares.hint("merge"), ["u", "share"]).select("u", "v", "m")


def _quiet(spark: SparkSession) -> SparkSession:
    """A session like this one, without adaptive planning: with it each exchange of the many small rounds holds a thread
    of the driver for a minute. The caller's session is left as it is."""
    quiet = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            quiet.conf.set(key, value)
    quiet.conf.set("spark.sql.adaptive.enabled", "false")
    return quiet


def _counted(pairs: DataFrame, session: SparkSession) -> tuple[DataFrame, tuple]:
    """The pairs, written, as a table of the given session, with their number and a checksum, observed as they are
    written."""
    seen = Observation()
    table = saved(pairs.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("sum")), "cc", session)
    return table, (seen.get["n"], seen.get["sum"])


def merged_components(label: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The components of a labelled graph (node, component) with more edges: only the components that these join are
    walked. edges is a written table."""
    if edges.isEmpty():
        return label
    for x in (a, b):
        named = label.select(F.col("node").alias(x), F.col("component").alias(f"{x}_of"))
        edges = edges.join(named.hint("merge"), x, "left").withColumn(x, F.coalesce(f"{x}_of", x)).drop(f"{x}_of")
    joined = saved(connected_components(edges, a, b).select(F.col("node").alias("component"), F.col("component").alias("to")), "cc-joined")
    moved = label.join(joined.hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = joined.select(F.col("component").alias("node"), F.col("to").alias("component")).join(label.select("node").hint("merge"), "node", "left_anti")
    return saved(moved.unionByName(new), "cc-merged")


#: Bits of a filter: 16 for each id, between these powers of two.
LEAST_BITS, MOST_BITS = 16, 27


class Filter:
    """A Bloom filter of one hash, sized by the number of its ids: false positives at worst, so it only saves work.

    The bits are a table of at most 2**MOST_BITS / 62 rows, which is what may be broadcast (some 35 MB). More ids than
    that has room for thin the filter out; then all rows go on to the exact join that follows each use.
    """

    def __init__(self, words: DataFrame, log_bits: int):
        self.words, self.log_bits = words, log_bits

    @classmethod
    def of(cls, ids: DataFrame, column: str, n: int | None = None) -> Filter:
        """The filter of a column of ids, of which there are n at most (else they are counted)."""
        n = ids.count() if n is None else n
        log_bits = min(max((16 * n).bit_length(), LEAST_BITS), MOST_BITS)
        at = F.pmod(F.xxhash64(column), F.lit(1 << log_bits))
        bits = ids.select(F.floor(at / 62).alias("word"), (at % 62).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        return cls(saved(bits, "filter"), log_bits)

    def keep(self, df: DataFrame, column: str, among: bool = True) -> DataFrame:
        """The rows whose id may be among the filter's; with among=False the others."""
        at = F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(1 << self.log_bits))
        word, bit, bits = (unused(df, x) for x in ("word", "bit", "bits"))
        placed = df.withColumns({word: F.floor(at / 62), bit: (at % 62).cast("int")})
        found = placed.join(F.broadcast(self.words.withColumnsRenamed({"word": word, "bits": bits})), word, "left")
        set_ = F.expr(f"(shiftright(coalesce(`{bits}`, 0L), `{bit}`) & 1L) = 1L")
        return found.filter(set_ if among else ~set_).select(*(F.col(f"`{c}`") for c in df.columns))
