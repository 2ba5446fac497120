"""Hilbert-curve sharding: documents sorted along a space-filling curve over their metadata, cut into even runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwell.llm.common import partitions, saved


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with `bits` bits for each axis (Skilling's transform, vectorised)."""
    x = [np.asarray(a).astype(np.int64).copy() for a in axes]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for a in x:
            high, swap = (a & q) != 0, (x[0] ^ a) & (q - 1)
            swap[high] = 0
            x[0] ^= np.where(high, q - 1, swap)
            if a is not x[0]:
                a ^= swap
        q >>= 1
    for before, a in zip(x, x[1:], strict=False):
        a ^= before
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for a in x:
            out = (out << 1) | (((a ^ flip) >> b) & 1)
    return out


def hilbert_shards(docs: DataFrame, n_shards: int = 40, bits: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, curve and the quantised axes (lang_q, source_q, size_q) of every document.

    Rows are ordered by the Hilbert index of (language, source, log size), then by text, then by doc_id, and that
    order is cut into `n_shards` runs whose row counts differ by one at most. Equal texts take the axes of their
    first copy, so that a group of copies is contiguous and is cut only by the row law.

    Only narrow rows are shuffled, never texts. The order is a range partitioning on the whole sort key, so one hot
    cell of the curve is split over many tasks. Null texts count as empty (16 bytes); null lang or source have the
    lowest cell. Repeated rows each get a slot of their own. An empty table gives no rows.
    """
    text, cells = F.coalesce("text", F.lit("")), 1 << bits
    cell = lambda c: F.coalesce(F.crc32(F.col(c).cast("binary")) % (cells - 1) + 1, F.lit(0))
    size = F.octet_length(text).cast("long") + 16
    rows = saved(
        docs.select(
            "doc_id",
            size.alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("digest"),
            cell("lang").cast("int").alias("lang_q"),
            cell("source").cast("int").alias("source_q"),
            F.least(F.floor(F.log2(size.cast("double")) * 8), F.lit(cells - 1)).cast("int").alias("size_q"),
        ),
        "shard-rows",
    )
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "lang_q", "source_q", "size_q")).alias("first"))

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], bits))

    axes = ["lang_q", "source_q", "size_q"]
    # written, so that the join can split a text of very many copies
    first = saved(first.select("digest", *(F.col(f"first.{a}").alias(a) for a in axes)).withColumn("curve", curve(*axes)), "shard-first")
    keyed = rows.drop(*axes).join(first, "digest")
    ordered = saved(
        keyed.repartitionByRange(partitions(docs.sparkSession), "curve", "digest", "doc_id")
        .sortWithinPartitions("curve", "digest", "doc_id")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
        .drop("at"),
        "shard-order",
    )
    before, start = {}, 0
    for part, n in sorted(ordered.groupBy("part").count().collect()):  # a row for each shuffle partition
        before[part], start = start, start + n
    spark, total = docs.sparkSession, start
    offsets = spark.createDataFrame(list(before.items()), "part long, start long")
    return (
        ordered.join(F.broadcast(offsets), "part")
        .withColumn("position", F.col("start") + F.col("row"))
        .withColumn("shard", F.expr(f"cast(position * {n_shards} div {max(total, 1)} as int)"))
        .withColumn("slot", F.expr(f"position - (shard * {total}L + {n_shards - 1}) div {n_shards}"))
        .select("doc_id", "size", "text_crc32", "shard", "slot", "curve", *axes)
    )


def shard_ranges(shards: DataFrame) -> DataFrame:
    """The range of each axis in each shard: what a reader needs to skip whole shards."""
    return shards.groupBy("shard").agg(
        F.count("*").alias("n_rows"),
        F.sum("size").alias("n_bytes"),
        *(f(a).alias(f"{f.__name__}_{a}") for a in ("lang_q", "source_q", "size_q") for f in (F.min, F.max)),
    )
