"""Exact nearest vectors without comparing all: a table clustered around centres, passed over by the triangle inequality.

A vector is stored with its cluster, its distance r from that centre, and sorted by both. For a query at distance d from
a centre, a vector of the cluster is at least |d - r| away; so once a few near clusters have given k distances, of every
other cluster only rings of r are read that could hold a nearer vector, and of most clusters none. Centres only steer
what is read, never what is found: they are fitted to a bounded sample, while every vector is stored and looked for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwell.operators import storage

#: Vectors that the centres are fitted to, centres at most, and rounds of fitting.
SAMPLE, MOST_CENTRES, ROUNDS = 16_384, 1024, 5
#: Room for rounding in comparisons of bounds.
ROOM = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """An array column without nulls, all of one length, as doubles."""
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def fitted(x: np.ndarray, n: int) -> np.ndarray:
    """n centres of a sample, or as many as it has rows, by a few rounds of k-means from evenly spaced rows."""
    n = min(n, len(x))
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        of = nearest(x, centres)[0]
        for c in range(n):
            if (of == c).any():
                centres[c] = x[of == c].mean(0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, by matrix product, and its distance."""
    of = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
    return of, np.sqrt(((x - centres[of]) ** 2).sum(1))


@dataclass
class VectorIndex:
    """The clustered table at root. Vectors that are null, hold nulls or non-finite numbers, or have another length than
    most, are not in it."""

    spark: SparkSession
    root: str
    key: str = "chunk_id"
    embedding: str = "embedding"

    _about: dict | None = field(default=None, repr=False)

    def build(self, vectors: DataFrame, centres: int | None = None) -> VectorIndex:
        """Cluster all vectors anew; the table of before counts until this is done, and is deleted then."""
        sound = vectors.select(self.key, F.col(self.embedding).cast("array<float>").alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        sizes = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        name, total, dims = uuid.uuid4().hex, (sizes["count"] if sizes else 0), (sizes.d if sizes else 0)
        sound = sound.filter(F.size("v") == dims)
        sample = sound.orderBy(F.xxhash64("v"), self.key).limit(SAMPLE).select("v").toPandas()["v"] if total else []
        middle = fitted(np.array([np.asarray(v, float) for v in sample]), centres or min(MOST_CENTRES, int(total**0.5) + 1)) if total else np.zeros((0, 0))
        kind = dict(vectors.dtypes)[self.key]
        key = self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    x = matrix(b.column(1))
                    of, r = nearest(x, middle)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(of.astype(np.int32)), pa.array(r), pa.array(np.sqrt((x**2).sum(1)))], [key, "v", "cluster", "r", "norm"])

        at = f"{self.root}/{name}"
        placed = sound.mapInArrow(run, f"{key} {kind}, v array<float>, cluster int, r double, norm double")
        placed.repartitionByRange("cluster", "r").sortWithinPartitions("cluster", "r").write.parquet(at)
        rows = self.spark.read.parquet(at).groupBy("cluster").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("norm").alias("norm")).collect()  # a row for each centre
        about = {"name": name, "key_type": kind, "clusters": [{"cluster": r.cluster, "n": r.n, "lo": r.lo, "hi": r.hi, "norm": r.norm, "centre": middle[r.cluster].tolist()} for r in rows]}
        before = storage.names(self.spark, f"{self.root}/manifests")
        storage.put_text(self.spark, f"{self.root}/manifests/{len(before) + 1:012d}", json.dumps(about))
        for old in storage.names(self.spark, self.root):
            if old not in (name, "manifests"):
                storage.delete(self.spark, f"{self.root}/{old}")
        self._about = None
        return self

    def about(self) -> dict:
        """The name of the table and what is known of its clusters; read once."""
        if self._about is None:
            names = sorted(n for n in storage.names(self.spark, f"{self.root}/manifests") if n.isdigit())
            self._about = json.loads(storage.read_text(self.spark, f"{self.root}/manifests/{names[-1]}")) if names else {"clusters": [], "key_type": "bigint"}
        return self._about

    def table(self) -> DataFrame:
        """All vectors, as key and embedding."""
        return self.spark.read.parquet(f"{self.root}/{self.about()['name']}").select(self.key, F.col("v").alias(self.embedding))

    def _scored(self, wanted: dict[int, tuple[float, float]], q: np.ndarray, metric: str) -> DataFrame:
        """key and distance of the vectors whose r is in the ring that is wanted of their cluster."""
        rings = self.spark.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in wanted.items()], "cluster int, from double, to double")
        rows = self.spark.read.parquet(f"{self.root}/{self.about()['name']}").filter(F.col("cluster").isin(list(wanted)))
        rows = rows.join(F.broadcast(rings), "cluster").filter((F.col("r") >= F.col("from")) & (F.col("r") <= F.col("to"))).select(self.key, "v")
        key = self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    x = matrix(b.column(1))
                    d = np.sqrt(((x - q) ** 2).sum(1)) if metric == "l2" else 1 - x @ q
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d)], [key, "distance"])

        return rows.mapInArrow(run, f"{key} {self.about()['key_type']}, distance double")

    def plan(self, q: np.ndarray, limit: int, metric: str = "cosine") -> dict[int, tuple[float, float]]:
        """The clusters that have to be opened for the limit nearest vectors, and the ring of each."""
        known = self.about()["clusters"]
        away = np.array([np.sqrt(((q - np.array(c["centre"])) ** 2).sum()) for c in known])
        first, held = {}, 0
        for i in np.argsort(away, kind="stable"):
            first[known[i]["cluster"]] = (known[i]["lo"], known[i]["hi"])
            held += known[i]["n"]
            if held >= limit:
                break
        worst = self._scored(first, q, metric).orderBy("distance").limit(limit).agg(F.count("*").alias("n"), F.max("distance").alias("d")).first()
        out = {}
        for c, d in zip(known, away, strict=True):
            # how far a vector of the cluster may be from the query: for 1 - q.x, |q - x|^2 = |q|^2 + |x|^2 - 2 q.x
            far = np.inf if worst.n < limit else worst.d if metric == "l2" else np.sqrt(max((q**2).sum() + c["norm"] ** 2 - 2 * (1 - worst.d), 0.0))
            far += ROOM * (1 + far + d)
            lo, hi = max(c["lo"], d - far), min(c["hi"], d + far)
            if lo <= hi:
                out[c["cluster"]] = (lo, hi)
        return out

    def search(self, query: DataFrame, limit: int = 20, metric: str = "cosine") -> DataFrame:
        """key and distance of the nearest vectors to the one of `query` (column q): those of `vector_topk`."""
        row = query.select(F.col("q").cast("array<double>").alias("q")).first()
        if row is None or not self.about()["clusters"]:
            return self.spark.createDataFrame([], f"{self.key} {self.about()['key_type']}, distance double")
        q = np.array(row.q)
        return self._scored(self.plan(q, limit, metric), q, metric).orderBy("distance", self.key).limit(limit)

    def opened(self, query: DataFrame, limit: int = 20, metric: str = "cosine") -> tuple[int, int, int, int]:
        """Clusters that a search opens, of how many, and vectors that it compares, of how many."""
        q, known = np.array(query.select(F.col("q").cast("array<double>").alias("q")).first().q), self.about()["clusters"]
        wanted = self.plan(q, limit, metric)
        return len(wanted), len(known), self._scored(wanted, q, metric).count(), sum(c["n"] for c in known)
