"""A written inverted index with positions, kept up to date a session at a time and merged as it grows.

Below a root lie `segments`, each written once, and `manifests`, the commit log. A segment has docs (key, owner, length
and words of each document, dealt by owner), postings (dealt by term), and what it replaces in segments before it: dead
documents (target, block, place) and, for each term, how many documents it lost there. A manifest names the segments
that count. A writer writes a whole segment under a new name and then commits by renaming one manifest into place, so a
crash leaves nothing but an orphan, which `sweep` removes; a reader keeps to the manifest that it began with. There is
one writer at a time.

Documents are numbered in blocks of BLOCK, of like length. A posting is a row for a term and a block: places, keys,
counts, lengths and positions in arrays, and the largest count and least length, which bound the block's scores. Texts
are shuffled once, to their blocks; postings are put together where a block lies and written from there, and merges
filter and sort them where they are read, so that neither words nor postings are shuffled. A top-k search opens only blocks whose bounds reach the score of the k-th best document of the most promising blocks.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwell.functions.text import contains_like, query_terms, terms
from threadwell.operators import storage
from threadwell.operators.retrieval import bm25_of_hits, idf, weight

BUCKETS = 64
#: Documents of a block; a search opens all blocks at once where there are not this many for each wanted hit.
BLOCK, FEW_BLOCKS = 128, 4
#: Blocks that a filter names one by one.
MOST_NAMED = 1000
#: What a task that writes an index takes at most, and rows of a batch that goes to Python: postings, which such a task
#: sorts, are some ten times the size of compressed texts.
TASK_BYTES, BATCH_ROWS = "16MB", 256
#: Characters whose trigrams are taken at once.
STRETCH = 1 << 20
#: Segments of like size that are merged, and how far apart sizes of a tier may be.
TIER = 4


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _out(dead: DataFrame) -> DataFrame:
    """The dead places of each block: BLOCK at most."""
    return dead.groupBy("block").agg(F.collect_set(F.col("place").cast("smallint")).alias("out"))


def _less(i: int) -> Callable[[Column], Column]:
    """A function of one column, for `transform`, that takes i away."""
    return lambda p: p - F.lit(i)


@contextmanager
def _small_tasks(spark: SparkSession) -> Iterator[None]:
    """Tasks of TASK_BYTES and batches of BATCH_ROWS, for what is run within."""
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES, "spark.sql.files.maxPartitionBytes": TASK_BYTES, "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": True}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come block by block (last column but one, then place), in batches that end where a block ends."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        blocks = b.column(b.num_columns - 2)
        cut = blocks.index(blocks[-1]).as_py()  # where the last block begins
        if rest and (cut or blocks[0] != rest[-1].column(b.num_columns - 2)[-1]):
            yield pa.concat_batches([*rest, b.slice(0, cut)])
            rest = []
        elif cut:
            yield b.slice(0, cut)
        rest.append(b.slice(cut))
    if rest:
        yield pa.concat_batches(rest)


def _numbered(blocks: pa.Array) -> np.ndarray:
    """The number of each row's block, from 0."""
    return blocks.dictionary_encode().indices.to_numpy()


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before; 0 is one."""
    differ = np.ones(len(columns[0]), bool)
    differ[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(differ)


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _inverted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings, without bucket, of documents (key, dl, words, block, place) that come block by block."""
    for b in _whole_blocks(batches):
        key, dl, words, blocks, place = b.columns
        dl, place = dl.to_numpy(), place.to_numpy()
        said = words.flatten().dictionary_encode()
        if not len(said):
            continue
        row = np.repeat(np.arange(len(b)), dl)
        pos = (np.arange(len(row)) - np.repeat(np.cumsum(dl) - dl, dl)).astype(np.int32)
        at = said.indices.to_numpy().astype(np.int64) * len(b) + row
        order = np.argsort(at, kind="stable")
        entry = _firsts(at[order])  # a term in a document
        term, of = said.indices.to_numpy()[order][entry], row[order][entry]
        tf = np.diff(np.append(entry, len(row))).astype(np.int32)
        group = _firsts(term, _numbered(blocks)[of])  # a term in a block
        n = np.diff(np.append(group, len(of))).astype(np.int32)
        lists = [_lists(group, x) for x in (pa.array(place[of]), key.take(pa.array(of)), pa.array(tf), pa.array(dl[of]), _lists(entry, pa.array(pos[order])))]
        figures = [pa.array(x) for x in (n, np.maximum.reduceat(tf, group), np.minimum.reduceat(dl[of], group))]
        yield pa.RecordBatch.from_arrays([said.dictionary.take(pa.array(term[group])), blocks.take(pa.array(of[group])), *figures, *lists], ["term", "block", "n", "max_tf", "min_dl", "places", "keys", "tfs", "dls", "pos"])


def _trigrams(text: bytes) -> np.ndarray:
    """Each run of three characters once, A-Z lower-cased, as three code points of 21 bits in a number, ascending."""
    chars = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    chars[(chars >= 65) & (chars <= 90)] += 32
    at = range(0, max(len(chars) - 2, 0), STRETCH)
    parts = [np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:]) for x in (chars[i : i + STRETCH + 2] for i in at)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.zeros(0, np.int64), *parts]))


def _inverted_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, block, n and places of the trigrams of texts (text, block, place) that come block by block."""
    for b in _whole_blocks(batches):
        text, blocks, place = b.columns
        held = [_trigrams(x or b"") for x in text.cast(pa.binary()).to_pylist()]
        row, run = np.repeat(np.arange(len(b)), [len(x) for x in held]), np.concatenate(held)
        if not len(run):
            continue
        order = np.argsort(run, kind="stable")
        run, row = run[order], row[order]
        group = _firsts(run, _numbered(blocks)[row])
        first = run[group]
        spelt = np.stack([first >> 42, first >> 21 & 0x1FFFFF, first & 0x1FFFFF], 1).astype(np.uint32).tobytes().decode("utf-32-le")
        columns = [pa.array([spelt[i : i + 3] for i in range(0, len(spelt), 3)], pa.string()), blocks.take(pa.array(row[group])), pa.array(np.diff(np.append(group, len(row))).astype(np.int32)), _lists(group, pa.array(place.to_numpy()[row]))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "places"])


def query_units(query: str) -> list[tuple[str, ...]]:
    """What a query asks for, in order and each once: terms, and phrases as several terms. Words in double quotes are a
    phrase, and so are words joined by hyphens or underscores; other punctuation only parts terms."""
    units = []
    for quoted, bare in re.findall(r'"([^"]*)"|([^\s"]+)', query):
        for part in [quoted] if quoted else re.findall(r"\w+(?:-+\w+)*", bare):
            words = [t for w in re.split(r"[\W_]+", part) for t in query_terms(w)]
            units.append(tuple(words))
    return [u for u in dict.fromkeys(units) if u]


def crowded(sizes: list[int], tier: int = TIER) -> list[int] | None:
    """Which of the segments (by their documents, in any order) to merge next: TIER of one size class; None if no class
    has so many. Classes are powers of TIER, so n updates leave some TIER * log(n) segments and write each document
    log(n) times."""
    classes: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        classes.setdefault(int(math.log(max(n, 1), tier) + 1e-9), []).append(i)
    full = [c for c in sorted(classes) if len(classes[c]) >= tier]
    return classes[full[0]] if full else None


@dataclass
class TextIndex:
    """The index at root, of words. Documents have a key and belong to an owner (their session)."""

    spark: SparkSession
    root: str
    key: str = "chunk_id"
    owner: str = "session_id"
    text: str = "combined_text"
    buckets: int = BUCKETS
    #: What a text is indexed by.
    split: Callable[[Column], Column] = terms
    #: Whether counts and positions are of use: if not, a document is indexed by each trigram once, and its text is kept.
    ranked: bool = True
    #: The version to read and to go on from (0: none), where something else records which one counts; default: the last.
    at: int | None = None

    _manifest: dict | None = field(default=None, repr=False)

    # --- the commit log

    def manifest(self) -> dict:
        """The manifest that counts; read once."""
        if self._manifest is None:
            version = max(self._versions(), default=0) if self.at is None else self.at
            self._manifest = json.loads(storage.read_text(self.spark, f"{self.root}/manifests/{version:012d}")) if version else {"version": 0, "segments": [], "key_type": "bigint"}
        return self._manifest

    def _versions(self) -> list[int]:
        return [int(n) for n in storage.names(self.spark, f"{self.root}/manifests") if n.isdigit()]

    def refresh(self) -> TextIndex:
        """Forget the manifest, after another process has committed one."""
        self._manifest = None
        return self

    def segments(self) -> list[int]:
        """The segments that count, numbered from the oldest."""
        return list(range(len(self.manifest()["segments"])))

    def _commit(self, segments: list[dict], **more) -> None:
        last = self.manifest()["version"] if self.at is None else max(self._versions(), default=0)
        now = {**self.manifest(), **more, "version": last + 1, "segments": segments}
        storage.put_text(self.spark, f"{self.root}/manifests/{now['version']:012d}", json.dumps(now))
        self._manifest = now
        if self.at is not None:
            self.at = now["version"]

    def sweep(self, keep: int = 2, versions: set[int] | None = None) -> None:
        """Delete all but the last `keep` manifests (or those of the given versions) and what they name: what others left
        unfinished or has been merged. Not while another process writes; a reader that holds an older manifest must refresh."""
        left = sorted(self._versions())
        left = [f"{v:012d}" for v in (left[-keep:] if versions is None else left) if versions is None or v in versions]
        kept = {s["name"] for n in left for s in json.loads(storage.read_text(self.spark, f"{self.root}/manifests/{n}"))["segments"]}
        for name in storage.names(self.spark, f"{self.root}/manifests"):
            if name not in left:
                storage.delete(self.spark, f"{self.root}/manifests/{name}")
        for name in storage.names(self.spark, f"{self.root}/segments"):
            if name not in kept:
                storage.delete(self.spark, f"{self.root}/segments/{name}")

    # --- tables of segments

    def _save(self, df: DataFrame, name: str, table: str, partition_by: tuple[str, ...] = ()) -> None:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(f"{self.root}/segments/{name}/{table}")

    def _read(self, table: str, column: str, segments: list[dict] | None = None, only: list[int] | None = None) -> DataFrame | None:
        """A table of some segments (default: all), of the given buckets only, with the segment's name in `target`; None
        where no segment has any of it. Which buckets there are is in the manifest."""
        out = []
        for s in self.manifest()["segments"] if segments is None else segments:
            have = s[table]
            at = f"{self.root}/segments/{s['name']}/{table}"
            paths = [f"{at}/{column}={b}" for b in have if only is None or b in only]
            if paths:
                out.append(self.spark.read.option("basePath", at).parquet(*paths).withColumn("target", F.lit(s["name"])))
        return reduce(DataFrame.unionByName, out) if out else None

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (with block and place) of documents that no later segment replaces."""
        return self._without(rows, self._dead())

    @staticmethod
    def _without(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
        """Rows of documents that are not dead. A row for each block that has dead ones is broadcast (some two bytes a
        dead document), so the rows, which may be wide, stay where they are."""
        if dead is None:
            return rows
        return rows.join(F.broadcast(_out(dead)), "block", "left").filter(F.col("out").isNull() | ~F.array_contains("out", F.col("place").cast("smallint"))).drop("out")

    def _dead(self, targets: list[dict] | None = None) -> DataFrame | None:
        dead, live = self._read("dead", "obucket"), [s["name"] for s in (self.manifest()["segments"] if targets is None else targets)]
        return None if dead is None else dead.drop("target").withColumnRenamed("victim", "target").filter(F.col("target").isin(live))

    # --- writing

    def _numbered_docs(self, docs: DataFrame, name: str) -> DataFrame:
        """The documents in blocks: dealt by owner, a large owner to several tasks, and sorted by the length of their
        texts. Of equal keys the texts decide, so that a task that is run again numbers them alike."""
        rows = docs.select(self.key, F.col(self.owner).alias("owner"), F.col(self.text).alias("text"), _bucket(F.col(self.owner), self.buckets).alias("obucket"))
        at = F.monotonically_increasing_id()
        numbered = rows.hint("rebalance", "obucket").sortWithinPartitions("obucket", F.octet_length("text"), self.key, F.xxhash64("text")).withColumn("at", at)
        row = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        padded = lambda c: F.lpad(F.hex(c), 8, "0")  # noqa: E731  so that a file's blocks are in order
        block = F.concat_ws("-", F.lit(name[:16]), padded(F.shiftright("at", 33)), padded(F.floor(row / BLOCK).cast("long")))
        content = [F.length(F.coalesce("text", F.lit(""))).alias("dl"), F.col("text")]
        if self.ranked:
            numbered = numbered.withColumn("words", self.split(F.coalesce("text", F.lit(""))))
            content = [F.size("words").alias("dl"), F.col("words")]
        return numbered.select(self.key, "owner", *content, "obucket", block.alias("block"), (row % BLOCK).cast("int").alias("place"))

    def _write_postings(self, docs: DataFrame, name: str) -> None:
        """Each task turns the blocks that it has into postings and writes them to their buckets; nothing is shuffled."""
        if self.ranked:
            kind = docs.schema[self.key].dataType.simpleString()
            rows = docs.select(self.key, "dl", "words", "block", "place").mapInArrow(_inverted_words, f"term string, block string, n int, max_tf int, min_dl int, places array<int>, keys array<{kind}>, tfs array<int>, dls array<int>, pos array<array<int>>")
        else:
            rows = docs.select("text", "block", "place").mapInArrow(_inverted_trigrams, "term string, block string, n int, places array<int>")
        self._save(rows.withColumn("bucket", _bucket(F.col("term"), self.buckets)).sortWithinPartitions("bucket", "term", "block"), name, "postings", ("bucket",))

    def _entry(self, name: str, n_docs: int, n_terms: int) -> dict:
        """A segment in the manifest: its live documents and terms, and which buckets of each table it has."""
        have = {t: sorted(int(x.split("=")[1]) for x in storage.names(self.spark, f"{self.root}/segments/{name}/{t}") if "=" in x) for t in ("docs", "postings", "dead", "lost")}
        return {"name": name, "n_docs": n_docs, "terms": n_terms, **have}

    def _segment(self, docs: DataFrame, name: str) -> dict:
        """Write docs and postings from one numbering, which is kept on the executors' disks until both are there."""
        with _small_tasks(self.spark):
            numbered = self._numbered_docs(docs, name).persist(StorageLevel.DISK_ONLY)
            try:
                self._save(numbered, name, "docs", ("obucket",))
                self._write_postings(numbered, name)
                n = numbered.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
            finally:
                numbered.unpersist()
        return self._entry(name, n.n, n.t)

    def build(self, docs: DataFrame) -> TextIndex:
        """Index all documents anew; what was there counts until this is done."""
        self._commit([self._segment(docs, uuid.uuid4().hex)], key_type=docs.schema[self.key].dataType.simpleString())
        return self

    def update(self, docs: DataFrame, owners: DataFrame | None = None) -> TextIndex:
        """Replace all documents of the owners (default: those of docs) by docs, in a segment of its own; then merge
        segments of a crowded size. A null owner is replaced like any other."""
        before = self.manifest()["segments"]
        if not before:
            return self.build(docs)
        name = uuid.uuid4().hex
        fresh = self._segment(docs, name)
        gone = (docs if owners is None else owners).select(F.col(self.owner).alias("gone")).distinct()
        places = sorted(r[0] for r in gone.select(_bucket(F.col("gone"), self.buckets)).distinct().collect())  # as many as buckets
        old = self._read("docs", "obucket", only=places)
        if old is not None:
            hit = self._live(old.join(gone, F.col("owner").eqNullSafe(F.col("gone")), "left_semi"))
            self._save(hit.select(F.col("target").alias("victim"), "block", "place", "dl", "obucket"), name, "dead", ("obucket",))
            words = hit.withColumn("words", F.col("words") if self.ranked else F.array().cast("array<string>")).select("target", F.explode(F.array_distinct("words")).alias("term")).groupBy("target", "term").agg(F.count("*").alias("n"))
            self._save(words.select(F.col("target").alias("victim"), "term", "n", _bucket(F.col("term"), self.buckets).alias("bucket")).repartition("bucket"), name, "lost", ("bucket",))
            fresh = self._entry(name, fresh["n_docs"], fresh["terms"])
        if fresh["dead"]:
            lost = self._read("dead", "obucket", [fresh]).groupBy("victim").agg(F.count("*").alias("n"), F.sum("dl").alias("t")).collect()  # a row for each segment
            taken = {r.victim: (r.n, r.t) for r in lost}
            before = [{**s, "n_docs": s["n_docs"] - taken.get(s["name"], (0, 0))[0], "terms": s["terms"] - taken.get(s["name"], (0, 0))[1]} for s in before]
        self._commit([*before, fresh])
        while (some := crowded([s["n_docs"] for s in self.manifest()["segments"]])) is not None:
            self._merge(some)
        return self

    def merge(self) -> TextIndex:
        """One segment of all that is live."""
        if len(self.segments()) > 1 or self.manifest()["segments"] and self._dead() is not None:
            self._merge(self.segments())
        return self

    def _arrays(self) -> dict[str, str]:
        """The arrays of a posting, and what an entry of each is called."""
        return {"places": "place", "keys": "key", "tfs": "tf", "dls": "dl", "pos": "pos"} if self.ranked else {"places": "place"}

    def _left(self, rows: DataFrame, dead: DataFrame) -> DataFrame:
        """Postings without the dead documents; blocks that have none dead are passed through as they are."""
        d = F.when(F.col("out").isNotNull(), F.filter(F.arrays_zip(*(F.col(a).alias(b) for a, b in self._arrays().items())), lambda e: ~F.array_contains("out", e["place"].cast("smallint"))))
        cut = rows.join(F.broadcast(_out(dead)), "block", "left").withColumn("d", d).filter(F.col("d").isNull() | (F.size("d") > 0))
        new = {a: F.col(f"d.{b}") for a, b in self._arrays().items()} | {"n": F.size("d")}
        if self.ranked:
            new |= {"max_tf": F.array_max("d.tf"), "min_dl": F.array_min("d.dl")}
        return cut.withColumns({c: F.when(F.col("d").isNull(), F.col(c)).otherwise(v) for c, v in new.items()}).drop("d", "out")

    def _merge(self, which: list[int]) -> None:
        """Make one segment of several, from their postings: dead documents are left out, texts are not read again and
        nothing is shuffled."""
        have = self.manifest()["segments"]
        parts, rest = [have[i] for i in which], [s for i, s in enumerate(have) if i not in which]
        name, dead = uuid.uuid4().hex, self._dead(parts)
        docs, rows = self._read("docs", "obucket", parts), self._read("postings", "bucket", parts)
        with _small_tasks(self.spark):
            if docs is not None:
                self._save(self._without(docs.drop("target"), dead).sortWithinPartitions("obucket", "block", "place"), name, "docs", ("obucket",))
            if rows is not None:
                rows = rows.drop("target")
                self._save((rows if dead is None else self._left(rows, dead)).sortWithinPartitions("bucket", "term", "block"), name, "postings", ("bucket",))
        others = [s["name"] for s in rest]
        for table, column in (("dead", "obucket"), ("lost", "bucket")):  # what the merged ones replace elsewhere
            moved = self._read(table, column, parts)
            if moved is not None:
                self._save(moved.drop("target").filter(F.col("victim").isin(others)), name, table, (column,))
        self._commit([*rest, self._entry(name, sum(s["n_docs"] for s in parts), sum(s["terms"] for s in parts))])

    # --- searching

    def _figures(self) -> tuple[int, float]:
        n = sum(s["n_docs"] for s in self.manifest()["segments"])
        return n, sum(s["terms"] for s in self.manifest()["segments"]) / max(n, 1)

    def _postings(self, wanted: list[str], *columns: str) -> DataFrame | None:
        rows = self._read("postings", "bucket", only=self._buckets_of(wanted))
        return None if rows is None else rows.filter(F.col("term").isin(wanted)).select("term", "block", *columns)

    def _buckets_of(self, wanted: list[str]) -> list[int]:
        return [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "term string").select(_bucket(F.col("term"), self.buckets)).distinct().collect()]

    def _frequencies(self, wanted: list[str], rows: DataFrame) -> dict[str, int]:
        """In how many live documents each term is: the postings' sizes less what was lost since."""
        n = rows.select("term", F.col("n").cast("long").alias("n"))
        lost = self._read("lost", "bucket", only=self._buckets_of(wanted))
        if lost is not None:
            n = n.unionByName(lost.filter(F.col("term").isin(wanted) & F.col("victim").isin([s["name"] for s in self.manifest()["segments"]])).select("term", (-F.col("n")).alias("n")))
        return {r.term: r.n for r in n.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term

    @staticmethod
    def _entries(rows: DataFrame, key: str) -> DataFrame:
        """term, block, place, key, tf and dl of the documents in postings."""
        zipped = F.arrays_zip("places", "keys", "tfs", "dls")
        return rows.select("term", "block", F.explode(zipped).alias("e")).select("term", "block", "e.places", F.col("e.keys").alias(key), F.col("e.tfs").alias("tf"), F.col("e.dls").alias("dl")).withColumnRenamed("places", "place")

    def _phrase(self, phrase: tuple[str, ...]) -> DataFrame | None:
        """The postings of a phrase, as `_entries` gives those of a term: documents where its terms stand side by side.

        Positions are read only here. A row is a block that holds all of the terms; its arrays are compared where they
        are, so a task holds no row for each place of a word.
        """
        first, *others = dict.fromkeys(phrase)
        rows = self._postings([first, *others], "places", "keys", "dls", "pos")
        if rows is None:
            return None
        held = rows.filter(F.col("term") == first).drop("term")
        for i, t in enumerate(others):
            held = held.join(rows.filter(F.col("term") == t).select("block", F.col("places").alias(f"places{i}"), F.col("pos").alias(f"pos{i}")), "block")

        def times(e: Column) -> Column:
            said = {first: e["pos"]} | {t: F.get(f"pos{i}", (F.array_position(f"places{i}", e["places"]) - 1).cast("int")) for i, t in enumerate(others)}
            starts = reduce(F.array_intersect, [F.transform(said[t], _less(i)) for i, t in enumerate(phrase)])
            return F.coalesce(F.size(starts), F.lit(0))

        found = F.filter(F.transform(F.arrays_zip("places", "keys", "dls", "pos"), lambda e: F.struct(e["places"].alias("place"), e["keys"].alias("key"), times(e).alias("tf"), e["dls"].alias("dl"))), lambda e: e["tf"] > 0)
        each = held.select("block", F.explode(found).alias("e"))
        return each.select(F.lit(" ".join(phrase)).alias("term"), "block", "e.place", F.col("e.key").alias(self.key), F.col("e.tf").cast("long").alias("tf"), "e.dl")

    def hits(self, query: str) -> DataFrame | None:
        """term (or phrase), block, place, key, tf and dl of the live documents of each of the query's terms and
        phrases; None if the index has none."""
        units = query_units(query)
        single = [u[0] for u in units if len(u) == 1]
        rows = self._postings(single, "places", "keys", "tfs", "dls") if single else None
        parts = [] if rows is None else [self._entries(rows, self.key)]
        parts += [p for u in units if len(u) > 1 and (p := self._phrase(u)) is not None]
        return self._live(reduce(DataFrame.unionByName, parts)) if parts else None

    def search(self, query: str, limit: int | None = 20, match: str = "any", allowed: DataFrame | None = None, own_figures: bool = False) -> DataFrame:
        """key and rank (negative; less is better) of the best documents, of the allowed owners only if given.

        With own_figures the allowed documents are a corpus of their own: its size, mean length and document
        frequencies are summed from lengths and postings. match "all" wants every term and phrase.
        """
        units = query_units(query)
        n, mean = self._figures()
        if not units or not n:
            return self.spark.createDataFrame([], f"{self.key} {self.manifest()['key_type']}, rank double")
        least = len(units) if match == "all" else 1
        if allowed is None and limit is not None and all(len(u) == 1 for u in units):
            return self._top([u[0] for u in units], limit, least)
        found = self.hits(query)
        if found is None:
            return self.spark.createDataFrame([], f"{self.key} {self.manifest()['key_type']}, rank double")
        if allowed is None:
            out = bm25_of_hits(found, F.lit(n), F.lit(mean), self.key, least)
        else:
            mine = self._live(self._read("docs", "obucket").join(allowed.select(F.col(self.owner).alias("owner")).distinct(), "owner", "left_semi")).select("block", "place", "dl")
            among = found.join(mine.select("block", "place", F.lit(1).alias("owner")), ["block", "place"], "left" if not own_figures else "inner")
            if own_figures:
                own = F.broadcast(mine.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))  # one row
                out = bm25_of_hits(among.crossJoin(own), F.col("n_docs"), F.col("avgdl"), self.key, least)
            else:
                out = bm25_of_hits(among, F.lit(n), F.lit(mean), self.key, least, self.spark.createDataFrame([(1,)], "owner int"))
        return out if limit is None else out.orderBy("rank", self.key).limit(limit)

    def opened(self, query: str, limit: int = 20, match: str = "any") -> tuple[int, int]:
        """How many postings rows (a term in a block) a top-k search of single terms opens, of how many there are."""
        wanted = [u[0] for u in query_units(query)]
        plan, rows = self._plan(wanted, limit, len(wanted) if match == "all" else 1), self._postings(wanted)
        return (0 if plan is None else plan[0].count(), 0 if rows is None else rows.count())

    def _top(self, wanted: list[str], limit: int, least: int) -> DataFrame:
        plan = self._plan(wanted, limit, least)
        if plan is None:
            return self.spark.createDataFrame([], f"{self.key} {self.manifest()['key_type']}, rank double")
        rows, scored = plan
        return scored(rows).orderBy("rank", self.key).limit(limit)

    def _plan(self, wanted: list[str], limit: int, least: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]] | None:
        """The postings that a top-k search has to open, and the scores of postings; None if nothing can be found.

        A block's bound is what its documents would score if each had the block's largest counts and least length. The
        most promising blocks are scored first; then blocks whose bound is under the limit-th best rank are passed over.
        """
        rows = self._postings(wanted, "n", "max_tf", "min_dl", "places", "keys", "tfs", "dls")
        if rows is None:
            return None
        n, mean = self._figures()
        known = {t: m for t, m in self._frequencies(wanted, rows).items() if m > 0}
        if not known or least > len(known):
            return None
        gain = reduce(lambda c, t: c.when(F.col("term") == t, idf(F.lit(n), F.lit(known[t]))), known, F.when(F.lit(False), 0.0))
        rows = rows.filter(F.col("term").isin(list(known)))
        most = F.sum(gain * weight(F.col("max_tf"), F.col("min_dl"), F.lit(mean)))
        bounds = rows.groupBy("block").agg(most.alias("bound"), F.count("*").alias("held")).filter(F.col("held") >= least)

        def scored(some: DataFrame) -> DataFrame:
            rank = F.sum(gain * weight(F.col("tf"), F.col("dl"), F.lit(mean)))
            each = self._live(self._entries(some, self.key))
            return each.groupBy(self.key, "block", "place").agg((-rank).alias("rank"), F.count("*").alias("found")).filter(F.col("found") >= least).select(self.key, "rank")

        if n > FEW_BLOCKS * limit * BLOCK:  # else there is little to pass over
            first = bounds.orderBy(F.desc("bound"), "block").limit(limit)
            worst = scored(rows.join(F.broadcast(first.select("block")), "block", "left_semi")).orderBy("rank").limit(limit).agg(F.count("*").alias("n"), F.max("rank").alias("rank")).first()
            if worst.n == limit:
                bounds = bounds.filter(F.col("bound") >= -worst.rank * (1 - 1e-9))
            rows = rows.join(bounds.select("block"), "block", "left_semi")
        elif least > 1:
            rows = rows.join(bounds.select("block"), "block", "left_semi")
        return rows, scored


def pattern_trigrams(part: str) -> list[str]:
    """The trigrams that a text must have to hold part in the sense of `contains_like`: those between wildcards."""
    low = part.translate({i: i + 32 for i in range(65, 91)})
    return list(dict.fromkeys(run[i : i + 3] for run in re.split("[%_]", low) for i in range(len(run) - 2)))


@dataclass
class TrigramIndex(TextIndex):
    """An index for LIKE: which documents have the trigrams that a pattern needs. It keeps the texts, block by block, so
    that only blocks with candidates are read to verify them."""

    ranked: bool = False

    def candidates(self, part: str) -> DataFrame | None:
        """block and place of documents that have all trigrams of the pattern (dead ones too); None if it has none, or
        the index has none of them."""
        wanted = pattern_trigrams(part)
        rows = self._postings(wanted, "places") if wanted else None
        if rows is None:
            return None
        sets = rows.groupBy("block").agg(F.collect_list("places").alias("sets")).filter(F.size("sets") == len(wanted))
        both = F.aggregate(F.slice("sets", 2, len(wanted)), F.element_at("sets", 1), lambda a, b: F.array_intersect(a, b))
        return sets.select("block", F.explode(both).alias("place"))

    def grep(self, part: str, limit: int | None = 50) -> DataFrame:
        """key, owner and text of the documents that hold part in the sense of `contains_like`, largest key first.

        A blank pattern holds nothing. One without three literal characters in a row is looked for in all texts.
        """
        docs = self._read("docs", "obucket")
        if docs is None or not part.strip():
            return self.spark.createDataFrame([], f"{self.key} {self.manifest()['key_type']}, {self.owner} string, {self.text} string")
        wanted, found = pattern_trigrams(part), self.candidates(part)
        if wanted:
            if found is None:
                return self.grep(" ")
            blocks = [r[0] for r in found.select("block").distinct().limit(MOST_NAMED + 1).collect()]
            if len(blocks) <= MOST_NAMED:  # named, they let the scan pass over files and row groups
                docs = docs.filter(F.col("block").isin(blocks))
            docs = docs.join(found, ["block", "place"], "left_semi")
        hits = self._live(docs.filter(contains_like(F.col("text"), part))).select(self.key, F.col("owner").alias(self.owner), F.col("text").alias(self.text))
        return hits if limit is None else hits.orderBy(F.desc(self.key)).limit(limit)
