"""Tables that change together: a manifest names the files of each, and a reader keeps to the one that it began with.

A table is dealt to buckets by a hash of a key. A change writes the buckets that it touches to folders of new names and
then commits by renaming one small manifest into place: the folders of each bucket of each table, and marks, such as the
version of a text index. So several tables change at once or not at all; what a failed change has written is named by no
manifest, and `sweep` removes it. Of two changes that began with the same snapshot, the second to commit fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadwell.operators import storage

#: Folders of a bucket at most; one more append writes the bucket anew.
MOST_FOLDERS = 8


@dataclass(frozen=True)
class Snapshot:
    """The folders of each bucket of each table, and the marks, as one commit left them."""

    version: int = 0
    tables: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


@dataclass
class Tables:
    """The tables below a root, with the schemas that they are stored in."""

    spark: SparkSession
    root: str
    schemas: dict[str, StructType]
    buckets: int = 256

    # --- reading

    def _versions(self) -> list[str]:
        return sorted(n for n in storage.names(self.spark, f"{self.root}/manifests") if n.isdigit())

    def _load(self, version: str) -> Snapshot:
        return Snapshot(**json.loads(storage.read_text(self.spark, f"{self.root}/manifests/{version}")))

    def latest(self) -> Snapshot:
        """The last commit; without tables before the first."""
        versions = self._versions()
        return self._load(versions[-1]) if versions else Snapshot()

    def read(self, name: str, snapshot: Snapshot, only: Iterable[int] | None = None) -> DataFrame:
        """A table (or some of its buckets) in a snapshot; columns that older files lack are null, no footers are read."""
        parts = snapshot.tables.get(name, {})
        wanted = parts if only is None else [str(b) for b in only if str(b) in parts]
        paths = [f"{self.root}/{name}/{folder}/bucket={b}" for b in wanted for folder in parts[b]]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    # --- writing

    def change(self) -> Change:
        """A change of the latest snapshot."""
        return Change(self, self.latest())

    def sweep(self, keep: int = 4) -> list[Snapshot]:
        """Delete all but the last `keep` manifests and what only others name; returns those left. Not while another
        process writes; who still reads an older snapshot must take a new one."""
        versions = self._versions()
        old, kept = [self._load(v) for v in versions[:-keep]], [self._load(v) for v in versions[-keep:]]
        for v in versions[:-keep]:
            storage.delete(self.spark, f"{self.root}/manifests/{v}")
        live = {at for s in kept for at in _places(s)}
        folders = {(name, folder) for name, folder, _ in live}
        for name, folder, b in {at for s in old for at in _places(s)} - live:
            if (name, folder) in folders:  # others of its buckets count
                storage.delete(self.spark, f"{self.root}/{name}/{folder}/bucket={b}")
        for name in self.schemas:
            for folder in storage.names(self.spark, f"{self.root}/{name}"):
                if (name, folder) not in folders:
                    storage.delete(self.spark, f"{self.root}/{name}/{folder}")
        return kept


def _places(s: Snapshot) -> set[tuple[str, str, str]]:
    return {(name, folder, b) for name, parts in s.tables.items() for b, folders in parts.items() for folder in folders}


class Change:
    """What is to become the next snapshot. Nobody sees any of it before `commit`."""

    def __init__(self, tables: Tables, base: Snapshot):
        self.of, self.base = tables, base
        self.now = Snapshot(base.version + 1, {n: {b: list(f) for b, f in p.items()} for n, p in base.tables.items()}, dict(base.marks))

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.of.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, key: str) -> tuple[str, list[str]]:
        """Write rows to a new folder, a bucket at a time; a bucket of very many rows is shared by several tasks."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.of.schemas[name]]
        folder = uuid.uuid4().hex
        path = f"{self.of.root}/{name}/{folder}"
        rows.select(*columns).withColumn("bucket", self._bucket(key)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        return folder, [n.split("=")[1] for n in storage.names(self.of.spark, path) if n.startswith("bucket=")]

    def replace(self, name: str, rows: DataFrame | None, changed: DataFrame, key: str = "session_id") -> None:
        """Replace all rows of the changed keys (a column of that name, null like any other) by rows, of such keys alone;
        only their buckets are written. None for rows deletes."""
        parts = self.now.tables.setdefault(name, {})
        gone = changed.select(F.col(key).cast(self.of.schemas[name][key].dataType).alias("_gone")).distinct()
        touched = [r[0] for r in gone.select(self._bucket("_gone")).distinct().collect()]  # at most `buckets`
        kept = self.of.read(name, self.now, touched).join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
        folder, written = self._write(name, kept if rows is None else kept.unionByName(rows, allowMissingColumns=True), key)
        for b in map(str, touched):
            parts.pop(b, None)
        for b in written:
            parts[b] = [folder]

    def append(self, name: str, rows: DataFrame, key: str = "session_id") -> None:
        """Add rows. Buckets that lie in MOST_FOLDERS folders are written anew with them."""
        parts = self.now.tables.setdefault(name, {})
        full = [b for b, folders in parts.items() if len(folders) >= MOST_FOLDERS]
        if full:
            rows = rows.unionByName(self.of.read(name, self.now, map(int, full)), allowMissingColumns=True)
            for b in full:
                del parts[b]
        folder, written = self._write(name, rows, key)
        for b in written:
            parts.setdefault(b, []).append(folder)

    def clear(self, *names: str) -> None:
        for name in names:
            self.now.tables[name] = {}

    def mark(self, name: str, version: int) -> None:
        self.now.marks[name] = version

    def commit(self) -> Snapshot:
        """Make it the latest snapshot; FileExistsError if another change came first."""
        put = {"version": self.now.version, "tables": self.now.tables, "marks": self.now.marks}
        storage.put_text(self.of.spark, f"{self.of.root}/manifests/{self.now.version:012d}", json.dumps(put))
        return self.now
