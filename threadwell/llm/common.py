"""Helpers shared by the training-data operators: tables, shared scratch tables, vectorised word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application that the driver and all executors share, below spark.checkpoint.dir.

    A temporary folder serves where that is unset and Spark is local; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "threadwell-checkpoints")
    return f"{base}/threadwell/{spark.sparkContext.applicationId}"


#: Rows of a batch that goes to a Python worker: texts are long, and JVM and workers hold whole batches.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to BATCH_ROWS, unless it has a number of its own."""
    if spark.conf.get(_BATCH) == "10000":  # Spark's default
        spark.conf.set(_BATCH, BATCH_ROWS)


def saved(df: DataFrame, label: str, session: SparkSession | None = None) -> DataFrame:
    """Write df to the shared folder and read it back (in another session, if given): cuts the lineage and survives lost
    executors."""
    spark = df.sparkSession
    text_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return (session or spark).read.schema(df.schema).parquet(path)


def in_session(df: DataFrame, session: SparkSession) -> DataFrame:
    """A `saved` table as one of another session."""
    paths = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    return session.read.schema(df.schema).parquet(*paths) if paths else session.createDataFrame([], df.schema)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a `saved` table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this application's operators have saved: to be called once their results are written."""
    _delete(spark, shared_dir(spark))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Parts of a level of equal counts, of which whole ones are taken before one is looked into.
LEVEL_PARTS = 4096


def most_counted(counts: DataFrame, limit: int, key: str) -> DataFrame:
    """The `limit` rows of the largest n, of equal ones those whose key has the smallest hash; all rows if there are no
    more. counts is a written table.

    The levels are found from a histogram of n, and the last level's share from a histogram of its hashes, so no task
    sends more than a small part of the rows that are wanted. Keys with one hash come together.
    """
    total, level = 0, None
    for n, m in counts.groupBy("n").count().orderBy(F.desc("n")).limit(limit + 1).collect():
        if total + m > limit:
            level = n
            break
        total += m
    if level is None:
        return counts
    hashed = F.xxhash64(key)
    part, room = F.pmod(hashed, F.lit(LEVEL_PARTS)), limit - total
    same = counts.filter(F.col("n") == level)
    whole = 0
    for at, m in sorted(same.groupBy(part.alias("part")).count().collect()):  # LEVEL_PARTS rows at most
        if m > room:
            break
        whole, room = at + 1, room - m
    last = same.filter(part == whole).select(hashed.alias("h")).orderBy("h").limit(room).agg(F.max("h")).first()[0] if room else None
    within = (part < whole) if last is None else (part < whole) | ((part == whole) & (hashed <= last))
    return counts.filter((F.col("n") > level) | ((F.col("n") == level) & within))


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- vectorised text -----------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, equal for both cases of A-Z.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WEIGHTS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (uint64 in and out)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_hash(data: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Running polynomial hash of bytes, of length len(data) + 1."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each byte range [start, end)."""
    inverse = powers(_BASE_INV, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about `limit` bytes; null texts are empty.

    A run holds whole texts, so one text longer than the limit makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    del data, buffer, column
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts, A-Z lowered: (hash, text index, start byte, end byte) of each."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    return range_hash(prefix_hash(data), starts, ends), owner, starts, ends


def shingles(h: np.ndarray, owner: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles in order, and the text of each. A text with 1 to k-1 words has one: all of its words."""
    total = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        total += h[j : j + len(total)] * _WEIGHTS[j]
    whole = owner[: len(total)] == owner[k - 1 :] if len(total) else np.zeros(0, bool)
    out, whose = mix(total[whole]), owner[: len(total)][whole]
    counts = np.bincount(owner, minlength=n_texts) if len(owner) else np.zeros(n_texts, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(owner, short)
        value = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            value[has] += h[first[has] + j] * _WEIGHTS[j]
        value = mix(value + counts[short].astype(np.uint64) * _WEIGHTS[k])
        out, whose = np.concatenate([out, value]), np.concatenate([whose, short])
        order = np.argsort(whose, kind="stable")
        out, whose = out[order], whose[order]
    return out, whose


def distinct_by_text(h: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, ascending, and the text of each."""
    order = np.lexsort((h, whose))
    h, whose = h[order], whose[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])
    return h[keep], whose[keep]


def fold(column: str, modulus: int) -> F.Column:
    """crc32 of a column's text, modulo `modulus`; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
