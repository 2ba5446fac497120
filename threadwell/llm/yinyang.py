"""Centroid clustering by Yinyang grouping: exact k-means over integers that skips most distances.

The centroids are clustered into groups once. A vector keeps an upper bound of the distance to its centroid and a lower
bound for each group of the others; as centroids move, bounds move by how far they went. A vector whose upper bound is
under all lower bounds keeps its centroid (global filter); of the others only groups whose lower bound is not over the
upper are opened (group filter), and of these only centroids that moved enough to come near are computed (local
filter). Bounds are doubles with room for rounding and only skip work; distances that decide are exact integers.

State lives in written tables, one for each round, of which only the last is kept. A task sends one row of sums, so the
driver sees k sums however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwell.llm.common import discard, saved

#: Components beyond this, scaled, could make a squared distance of 64 that fits no long.
MOST = (1 << 27) - 1
#: Room for rounding in a comparison of bounds.
ROOM = 1e-6


@dataclass
class Model:
    """Centroids (int64, k x dims), the group of each, and what the last round has of each: rows and squared distances."""

    centroids: np.ndarray
    groups: np.ndarray
    counts: list[int]
    inertias: list[int]
    #: Distances computed in each round, and what a full scan would have computed.
    scans: list[tuple[int, int]]


def integers(vectors: DataFrame, dims: int = 64, scale: float = 1024.0, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (int32, packed): floor(scale * x) of vectors with exactly `dims` components, none null or not finite.

    Vectors with a component beyond MOST, whose distances would fit no long, are left out like those. Ids may be null
    or repeated: each row is a vector of its own.
    """
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten()
            sizes = np.zeros(len(column), np.int64)
            have = np.asarray(column.is_valid())
            sizes[have] = np.asarray(column.value_lengths().drop_null())
            start = np.cumsum(sizes) - sizes
            right = np.flatnonzero(have & (sizes == dims))
            if not len(right):
                continue
            null = np.asarray(flat.is_null())
            x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
            at = start[right, None] + np.arange(dims)
            with np.errstate(invalid="ignore"):
                y = np.floor(x[at] * scale)
                good = (~null[at] & np.isfinite(x[at]) & (np.abs(y) <= MOST)).all(1)
            packed = y[good].astype("<i4").tobytes()
            width = 4 * dims
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right[good])), pa.array([packed[i : i + width] for i in range(0, len(packed), width)], pa.binary())], [key, "v"])

    return vectors.select(key, embedding).mapInArrow(run, f"{key} {kind}, v binary")


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows from one centroid."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Packed rows as a matrix of its own, which may be written to."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width).copy()


def _packed(m: np.ndarray) -> pa.Array:
    data, width = m.tobytes(), m.shape[1] * m.itemsize
    return pa.array([data[i : i + width] for i in range(0, len(data), width)], pa.binary())


def _first(x: np.ndarray, centroids: np.ndarray, groups: np.ndarray, n_groups: int) -> tuple:
    """The nearest centroid of each row (the smaller number of equals), its distance, lower bounds, distances computed."""
    d = np.stack([_distances(x, c) for c in centroids], 1)
    best = d.argmin(1)
    exact = d[np.arange(len(x)), best]
    rest = np.sqrt(d.astype(float))
    rest[np.arange(len(x)), best] = np.inf
    lower = np.stack([rest[:, groups == g].min(1) for g in range(n_groups)], 1)
    return best, exact, lower, d.size


def _again(x: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, groups: np.ndarray, drift: np.ndarray) -> tuple:
    """The same from the last round's bounds and how far each centroid went since. Rows that the global filter keeps
    have the distance -1: it was not computed."""
    n, k = len(x), len(centroids)
    n_groups = lower.shape[1]
    before = lower
    lower = before - np.array([drift[groups == g].max() for g in range(n_groups)])
    upper = upper + drift[best]
    exact = np.full(n, -1, np.int64)
    over = lambda up, low: low > up + ROOM * (1 + up)
    open_ = np.flatnonzero(~over(upper, lower.min(1)))
    scans = 0
    for c in range(k):  # tighten the upper bound
        rows = open_[best[open_] == c]
        exact[rows] = _distances(x[rows], centroids[c])
        scans += len(rows)
    upper[open_] = np.sqrt(exact[open_].astype(float))
    open_ = open_[~over(upper[open_], lower[open_].min(1))]
    if len(open_):
        had, own = best[open_].copy(), exact[open_].copy()
        limit = upper[open_]
        nearest, number = own.copy(), had.copy()
        found = np.full((len(open_), k), np.inf)  # distance of what was computed, a lower bound of what was passed over
        for c in range(k):
            g = groups[c]
            bound = before[open_, g] - drift[c]
            look = (had != c) & ~over(limit, lower[open_, g]) & ~over(limit, bound)
            rows = np.flatnonzero(look)
            d = _distances(x[open_[rows]], centroids[c])
            scans += len(rows)
            found[:, c] = np.where(had != c, bound, np.inf)
            found[rows, c] = np.sqrt(d.astype(float))
            better = (d < nearest[rows]) | ((d == nearest[rows]) & (c < number[rows]))
            nearest[rows[better]], number[rows[better]] = d[better], c
        at = np.arange(len(open_))
        found[at, had] = np.sqrt(own.astype(float))
        found[at, number] = np.inf
        for g in range(n_groups):
            shut = over(limit, lower[open_, g])
            low = found[:, groups == g].min(1)
            was = np.where((groups[had] == g) & (number != had), np.sqrt(own.astype(float)), np.inf)
            lower[open_, g] = np.where(shut, np.minimum(lower[open_, g], was), low)
        best[open_], exact[open_] = number, nearest
        upper[open_] = np.sqrt(nearest.astype(float))
    return best, exact, upper, lower, scans


def _round(state: DataFrame, key: str, centroids: np.ndarray, groups: np.ndarray, drift: np.ndarray | None, last: bool) -> DataFrame:
    """The state after one assignment (drift is None in the first), with one row of sums for each task."""
    kind = dict(state.dtypes)[key]
    k, dims = centroids.shape
    n_groups = int(groups.max()) + 1
    names = [key, "v", "best", "upper", "lower", "distance", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, inertias, scans, rows = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [0] * k, 0, 0
        type_ = None
        for batch in batches:
            type_ = batch.column(0).type
            if not len(batch):
                continue
            x = _matrix(batch.column(1), "<i4", dims).astype(np.int64)
            if drift is None:
                best, exact, lower, n = _first(x, centroids, groups, n_groups)
                upper = np.sqrt(exact.astype(float))
            else:
                best, exact, upper, lower, n = _again(x, np.array(batch.column(2)).astype(np.int64), np.array(batch.column(3)), _matrix(batch.column(4), "<f8", n_groups), centroids, groups, drift)
            if last:
                for c in range(k):
                    rest = np.flatnonzero((exact < 0) & (best == c))
                    exact[rest] = _distances(x[rest], centroids[c])
                    inertias[c] += int(exact[best == c].sum(dtype=object) or 0)
            for c in range(k):
                sums[c] += x[best == c].sum(0)
            counts += np.bincount(best, minlength=k)
            scans, rows = scans + n, rows + len(x)
            empty = pa.nulls(len(x), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), empty if last else batch.column(1), pa.array(best.astype(np.int32)), pa.array(upper), empty if last else _packed(lower), pa.array(exact), pa.nulls(len(x), pa.list_(pa.decimal128(38, 0)))], names)
        if rows:
            numbers = [*map(int, sums.ravel()), *map(int, counts), *inertias, int(scans), rows]
            one = pa.array([numbers], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, type_), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), one], names)

    rows = state if drift is None else state.filter("sums IS NULL").select(*names[:5])
    return rows.mapInArrow(run, f"{key} {kind}, v binary, best int, upper double, lower binary, distance long, sums array<decimal(38,0)>")


def _summed(state: DataFrame, n: int) -> list[int]:
    """The sums of all tasks: n numbers, of which only the rows of sums are read."""
    out = [0] * n
    for i, s in state.filter("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect():
        out[i] = int(s)
    return out


def centroid_groups(centroids: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Groups of like centroids, by a few rounds of plain k-means over the k centroids; none is empty."""
    x = centroids.astype(float)
    n = min(n, len(x))
    middle = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(rounds):
        of = ((x[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (of == g).any():
                middle[g] = x[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1].astype(np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: float = 1024.0, groups: int | None = None, key: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, Model | None]:
    """vec_id, cluster and distance (squared, exact) of every vector that `integers` keeps, and the model.

    Centroids start as the k vectors with the smallest sha256 of `seed:vec_id`, in that order (repeated ids by their
    components; null ids last); with fewer vectors there are fewer. Each round assigns every vector to the nearest
    centroid, the smaller number of equals, and moves every centroid that has vectors to the floor of their mean. Then
    they are assigned once more. Without vectors there are no rows and no model. Columns beside id and embedding go.
    """
    spark: SparkSession = vectors.sparkSession
    whole = saved(integers(vectors, dims, scale, key, embedding), "yinyang-vectors")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    start = [r.v for r in whole.select("v", named.alias("h")).orderBy(F.col("h").isNull(), "h", "v").limit(k).collect()]
    if not start:
        return whole.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), None
    centroids = np.stack([np.frombuffer(v, "<i4").astype(np.int64) for v in start])
    k = len(centroids)
    of = centroid_groups(centroids, groups or -(-k // 4))
    state, drift, model = whole, None, Model(centroids, of, [], [], [])
    for i in range(rounds + 1):
        before, state = state, saved(_round(state, key, centroids, of, drift, i == rounds), "yinyang")
        discard(before)
        numbers = _summed(state, k * dims + 2 * k + 2)
        sums, counts = np.array(numbers[: k * dims], object).reshape(k, dims), numbers[k * dims : k * dims + k]
        model.scans.append((numbers[-2], numbers[-1] * k))
        if i < rounds:
            moved = np.stack([np.array([s // counts[c] for s in sums[c]], np.int64) if counts[c] else centroids[c] for c in range(k)])
            drift = np.sqrt(((moved - centroids).astype(float) ** 2).sum(1)) * (1 + 1e-12)
            centroids = moved
    model.centroids, model.counts, model.inertias = centroids, counts, numbers[k * dims + k : k * dims + 2 * k]
    return state.filter("sums IS NULL").select(key, F.col("best").alias("cluster"), "distance"), model


def clusters(vectors: DataFrame, **kw) -> DataFrame:
    """`cluster`, with cluster_inertia, inertia and centroid_sha256 (of the components, joined by commas) in each row."""
    rows, model = cluster(vectors, **kw)
    about = [] if model is None else [(c, model.inertias[c], sum(model.inertias), ",".join(map(str, model.centroids[c]))) for c in range(len(model.centroids))]
    table = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, joined string").withColumn("centroid_sha256", F.sha2("joined", 256)).drop("joined")
    return rows.join(F.broadcast(table), "cluster").select(*[c for c in rows.columns if c not in ("cluster", "distance")], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds spelt out, each vector compared with each centroid; for tables without repeated ids."""
    near = "{a} AS MATERIALIZED (SELECT vec_id, c AS cluster, d AS distance FROM (SELECT v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d, row_number() OVER (PARTITION BY v.vec_id ORDER BY sum((v.x - m.x) * (v.x - m.x)), m.c) AS r FROM v JOIN {m} m USING (i) GROUP BY v.vec_id, m.c) WHERE r = 1)"
    steps = []
    for i in range(rounds):
        steps.append(near.format(a=f"a{i}", m=f"m{i}"))
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce(f.x, m.x) AS x FROM m{i} m LEFT JOIN (SELECT cluster AS c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (SELECT a.cluster, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{i} a JOIN v USING (vec_id) GROUP BY a.cluster, v.i)) f USING (c, i))")
    steps.append(near.format(a="z", m=f"m{rounds}"))
    return f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS x FROM e),
h AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM e),
m0 AS MATERIALIZED (SELECT h.c::INT AS c, v.i, v.x FROM h JOIN v USING (vec_id) WHERE h.c < {k}),
{', '.join(steps)}
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, s.sha AS centroid_sha256
FROM z JOIN (SELECT c AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM m{rounds} GROUP BY c) s USING (cluster)
"""
