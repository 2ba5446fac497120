"""Embedding near-duplicates by lattice hashing: projections decoded to E8 lattice points, in several tables.

A table projects unit vectors on BLOCKS random 8-dimensional subspaces, scales and shifts them, and decodes each block
to its nearest point of the E8 lattice; the points together are the vector's cell. Vectors are indexed under their
own cell and look into it and its nearest neighbours, reached by exchanging a block's point for one of the next
nearest. Every pair that meets is checked by its cosine in double precision.

Pairs never leave the task that checks them. A pair counts in the first table where the two meet, so that sums of
partial counts are numbers of links; and of what hangs together in a cell each vector reports one link, to the
smallest, which is enough for the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwell.llm.common import partitions, saved
from threadwell.llm.components import connected_components

TABLES, BLOCKS, SCALE, PROBES, SEED = 8, 3, 3.0, 8, 11
#: Indexed vectors of one cell that a task holds together.
HELD = 2000


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a, b in product((1.0, -1.0), repeat=2):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Tables:
    """The projections for vectors of one length; made from a seed, so that every task has the same."""

    def __init__(self, dim: int, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE):
        rng = np.random.default_rng([SEED, dim])
        self.blocks, wide = blocks, max(dim, 8 * blocks)
        self.maps = []
        for _ in range(tables):
            q, _ = np.linalg.qr(rng.normal(size=(wide, wide)))
            self.maps.append((q[:dim, : 8 * blocks] * scale * np.sqrt(max(dim, 1) / 64), rng.uniform(0, 1, 8 * blocks)))
        self.odd = rng.integers(1, 1 << 62, (blocks, 8), dtype=np.int64) * 2 + 1

    def cells(self, unit: np.ndarray, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
        """(own cell of each vector and table, cells to look into of each vector and table) as hashes."""
        own, look = [], []
        for t, (m, shift) in enumerate(self.maps):
            y = unit @ m + shift
            code = np.zeros((len(unit), self.blocks, 3), np.int64)
            cost = np.zeros((len(unit), self.blocks, 3))
            for b in range(self.blocks):
                x = y[:, 8 * b : 8 * b + 8]
                p = nearest_e8(x)
                gap = x - p
                further = 2.0 - 2 * gap @ ROOTS.T  # distance to p + root less that to p, squared
                second = np.argpartition(further, 1, axis=1)[:, :2]
                code[:, b, 0] = (np.rint(2 * p).astype(np.int64) * self.odd[b]).sum(1)
                for k in (0, 1):
                    code[:, b, k + 1] = (np.rint(2 * (p + ROOTS[second[:, k]])).astype(np.int64) * self.odd[b]).sum(1)
                    cost[:, b, k + 1] = further[np.arange(len(x)), second[:, k]]
            choices = list(product(range(3), repeat=self.blocks))
            total = np.stack([sum(cost[:, b, c[b]] for b in range(self.blocks)) for c in choices], 1)
            cell = np.stack([sum(code[:, b, c[b]] for b in range(self.blocks)) for c in choices], 1) * 31 + t
            best = np.argsort(total, axis=1, kind="stable")[:, : probes + 1]
            own.append(cell[:, 0])
            look.append(np.take_along_axis(cell, best, 1))
        return np.stack(own, 1), np.stack(look, 1)


def _vector(value: list | None) -> np.ndarray | None:
    """The unit vector, in double precision; none of what is null, empty, zero or not finite."""
    if not value or any(x is None for x in value):
        return None
    v = np.array(value, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / np.sqrt((v * v).sum())


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, digest and unit vector (packed doubles) of every row; digest is null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, packed = [], []
            for label, value in zip(batch.column(1), batch.column(2), strict=True):
                raw = value.as_py() if label.is_valid else None
                v = _vector(raw)
                packed.append(None if v is None else v.tobytes())
                digest.append(None if v is None else hashlib.blake2b(np.array(raw, np.float64).tobytes(), digest_size=16).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.string()), pa.array(packed, pa.binary())], names=["vec_id", "label", "digest", "unit"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").mapInArrow(run, "vec_id long, label string, digest string, unit binary")


def hashed(nodes: DataFrame) -> DataFrame:
    """Nodes with `look`: the cells that they look into, table by table, each table's own cell first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}
        for batch in batches:
            units = [np.frombuffer(x.as_buffer(), np.float64) for x in batch.column(2)]
            look = np.zeros((len(units), TABLES * (PROBES + 1)), np.int64)
            for dim in sorted({len(u) for u in units}):
                at = [i for i, u in enumerate(units) if len(u) == dim]
                look[at] = tables.setdefault(dim, Tables(dim)).cells(np.stack([units[i] for i in at]))[1].reshape(len(at), -1)
            ends = pa.array(np.arange(len(units) + 1, dtype=np.int32) * look.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(look.ravel()))], names=["node", "label", "unit", "copies", "look"])

    return nodes.select("node", "label", "unit", "copies").mapInArrow(run, "node long, label string, unit binary, copies long, look array<long>")


class _Cell:
    """The indexed vectors of one cell (or a part of it), with the links found to each and its smallest relative."""

    def __init__(self, table: int, rows: list[np.ndarray]):
        self.table = table
        self.node, self.copies, self.look, self.unit = rows
        self.root, self.n = self.node.copy(), np.zeros(len(self.node), np.int64)

    def asked(self, node: np.ndarray, copies: np.ndarray, look: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The smallest relative and the links to be counted here of each vector that looks in."""
        i, j = np.nonzero(unit @ self.unit.T >= threshold)
        other = node[i] != self.node[j]
        i, j = i[other], j[other]
        root = node.copy()
        while len(i):
            before = root.copy(), self.root.copy()
            np.minimum.at(root, i, self.root[j])
            np.minimum.at(self.root, j, root[i])
            if (root == before[0]).all() and (self.root == before[1]).all():
                break
        for t in range(self.table):  # met before?
            met = (look[i, t] == self.look[j, t, :1]).any(1) | (self.look[j, t] == look[i, t, :1]).any(1)
            i, j = i[~met], j[~met]
        both = (self.look[j, self.table] == look[i, self.table, :1]).any(1)  # then the other looks here, or there, too
        once = ~both | (node[i] < self.node[j])
        i, j = i[once], j[once]
        n = np.zeros(len(node), np.int64)
        np.add.at(n, i, self.copies[j])
        np.add.at(self.n, j, copies[i])
        return root, n


def links(nodes: DataFrame, threshold: float) -> DataFrame:
    """node, other and n of hashed nodes: partial numbers of vectors that they link to, and links (node, other) that
    tell what hangs together. Pairs link that meet in a cell and reach the threshold."""
    spark = nodes.sparkSession
    key = lambda cell: F.xxhash64("label", F.length("unit"), "table", cell)
    wide = PROBES + 1
    tables = F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda t: F.array_distinct(F.slice("look", t * wide + 1, wide)))
    looks = nodes.select("node", "label", "unit", F.posexplode(tables).alias("table", "cells"))
    index = looks.select("node", "table", key(F.get("cells", F.lit(0))).alias("key"))
    looks = looks.select("node", "label", "unit", "table", F.explode("cells").alias("cell")).select("node", "table", key("cell").alias("key"))
    size = index.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("least"))
    parts = F.ceil(F.col("m") / HELD).cast("int")
    looking = looks.join(size, "key").filter((F.col("m") > 1) | (F.col("least") != F.col("node"))).withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).select("key", "salt", "table", "node", F.lit(1).alias("role"))
    looking = saved(looking, "lattice-looks")
    wanted = looking.groupBy("key").agg(F.count("*").alias("looks")).join(size, "key").select("key", "m")
    held = index.join(wanted, "key").select("key", F.pmod(F.xxhash64("node"), parts).cast("int").alias("salt"), "table", "node", F.lit(0).alias("role"))
    rows = held.unionByName(looking).join(nodes.select("node", "copies", "look", "unit"), "node").select("key", "salt", "role", "table", "node", "copies", "look", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        cell: _Cell | None = None
        waiting: list[list[np.ndarray]] = []

        def told(node: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            some = (node != other) | (n > 0)
            return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (node, other, n)], names=["node", "other", "n"])

        for batch in batches:
            key, salt, role, table, node, copies = (batch.column(i).to_numpy() for i in range(6))
            look = batch.column(6).flatten().to_numpy().reshape(batch.num_rows, TABLES, -1)
            unit = [np.frombuffer(x.as_buffer(), np.float64) for x in batch.column(7)]
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]) if len(key) else []
            for lo, hi in zip(cut, [*cut[1:], len(key)], strict=True):
                if (key[lo], salt[lo]) != at:
                    if cell is not None:
                        yield told(cell.node, cell.root, cell.n)
                    at, cell, waiting = (key[lo], salt[lo]), None, []
                first = lo + int(np.searchsorted(role[lo:hi], 1))
                if first > lo:
                    waiting.append([node[lo:first], copies[lo:first], look[lo:first], np.stack(unit[lo:first])])
                if first < hi and cell is None and waiting:
                    cell = _Cell(int(table[lo]), [np.concatenate(x) for x in zip(*waiting, strict=True)])
                if cell is None:
                    continue
                for a in range(first, hi, 512):
                    b = min(hi, a + 512)
                    root, n = cell.asked(node[a:b], copies[a:b], look[a:b], np.stack(unit[a:b]), threshold)
                    yield told(node[a:b], root, n)
        if cell is not None:
            yield told(cell.node, cell.root, cell.n)

    return rows.repartition(partitions(spark), "key", "salt").sortWithinPartitions("key", "salt", "role").mapInArrow(run, "node long, other long, n long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors of equal label and length link if their cosine in double precision reaches the threshold and they meet in
    a table. n_links counts the other vectors linked directly, component_id is the smallest vec_id that links reach,
    kept says that this is the vector's own. Equal vectors are one node and link with each other. Vectors that are
    null, empty, zero or hold a null or a component that is not finite, and those without a label, link with nothing:
    they are their own component. A null vec_id keeps its row; rows that repeat a vec_id share their node's links. An
    empty table gives no rows.
    """
    rows = saved(vectors(embeddings), "lattice-rows")
    nodes = rows.filter("digest is not null and vec_id is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    nodes = saved(nodes, "lattice-nodes")
    found = saved(links(saved(hashed(nodes), "lattice-cells"), threshold), "lattice-links")
    label = connected_components(found.filter("node != other"), "node", "other")
    direct = found.groupBy("node").agg(F.sum("n").alias("direct"))
    known = (
        nodes.select("label", "digest", "node", "copies")
        .join(direct, "node", "left")
        .join(label, "node", "left")
        .select("label", "digest", (F.col("copies") - 1 + F.coalesce("direct", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    out = rows.select("vec_id", "label", "digest").join(known, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
