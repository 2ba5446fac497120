"""The engine's commands as functions over stored tables: ingest, search, inspection and upkeep.

Each returns a DataFrame (or several); printing is left to the caller.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from threadwell import schema
from threadwell.functions import hooks
from threadwell.functions import text as x
from threadwell.operators import dml, filters, search, storage, turns
from threadwell.operators.snapshots import Change, Snapshot, Tables
from threadwell.operators.text_index import BUCKETS, TextIndex
from threadwell.sources import transcripts
from threadwell.streaming import indexing

SCHEMAS: dict[str, StructType] = {"sessions": schema.SESSIONS, "chunks": schema.CHUNKS, "vectors": schema.VECTORS, "subagents": schema.SUBAGENTS}
#: As they are stored: vectors beside their session, which goes with them.
STORED = {**SCHEMAS, "vectors": StructType([*schema.VECTORS.fields, schema.SESSIONS["session_id"]])}
#: Characters of user and assistant text that are shown of a turn, and of the one asked for.
SHOWN, HIGHLIGHTED, RECOVERED, OF_SUBAGENT = (150, 250), (300, 600), (500, 800), (500, 800)


@dataclass
class Store:
    """The tables below one folder, dealt to buckets by session, with the text index and the search log.

    What a command changes in tables and index counts from one commit on; commands that read keep to one snapshot.
    """

    spark: SparkSession
    root: str
    buckets: int = dml.BUCKETS
    embedder: hooks.Embedder = hooks.hashed_embedding
    cached: dict[str, tuple[dict, DataFrame]] = field(default_factory=dict)
    #: Held while a change is made, by whichever of the daemon's queries does it.
    lock: threading.RLock = field(default_factory=threading.RLock, repr=False)
    #: Snapshots that a sweep leaves to readers.
    keep: int = 4
    pinned: Snapshot | None = None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def tables(self) -> Tables:
        return Tables(self.spark, self.root, STORED, self.buckets)

    def snapshot(self) -> Snapshot:
        return self.tables.latest() if self.pinned is None else self.pinned

    def pin(self) -> Store:
        """The store as it is now, whatever is committed meanwhile."""
        return replace(self, pinned=self.snapshot())

    def read(self, name: str) -> DataFrame:
        """A table in today's columns; without rows if it is not there yet."""
        return self.tables.read(name, self.snapshot()).select(*SCHEMAS[name].names)

    def vectors(self) -> DataFrame:
        """The vectors, kept in memory until they change."""
        now = self.snapshot().tables.get("vectors", {})
        held = self.cached.get("vectors")
        if held is None or held[0] != now:
            self.invalidate()
            held = self.cached["vectors"] = now, self.read("vectors").cache()
        return held[1]

    def invalidate(self) -> None:
        for _, df in self.cached.values():
            df.unpersist()
        self.cached.clear()

    def index_at(self, version: int) -> TextIndex:
        return TextIndex(self.spark, self.path("text_index"), buckets=min(BUCKETS, self.buckets), at=version)

    @property
    def index(self) -> TextIndex:
        return self.index_at(self.snapshot().marks.get("text_index", 0))

    def sweep(self) -> None:
        """Delete what no snapshot of the last `keep` names, and what failed changes left."""
        kept = self.tables.sweep(self.keep)
        self.index_at(0).sweep(versions={s.marks.get("text_index", 0) for s in kept})

    def query_vector(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([([float(v) for v in self.embedder([query])[0]],)], "q array<float>")


def stats(store: Store) -> DataFrame:
    """Sessions, summarised ones, chunks and embedded chunks."""
    store = store.pin()
    return filters.stats(store.read("sessions"), store.read("chunks"), store.read("vectors"))


def _embedded(store: Store, chunks: DataFrame) -> DataFrame:
    path = storage.scratch(store.spark, "embedded")
    hooks.embed(chunks, store.embedder).write.parquet(path)
    return store.spark.read.parquet(path)


def _add_vectors(store: Store, change: Change, made: DataFrame, old: DataFrame) -> None:
    """Add those of the vectors whose chunks are still there and have none."""
    owners = store.read("chunks").groupBy("chunk_id").agg(F.min("session_id").alias("session_id"))
    change.append("vectors", filters.not_embedded(made.join(owners, "chunk_id"), old))


def embed(store: Store) -> None:
    """Vectors for the chunks that have none. They are made before the tables are touched, so that indexing goes on
    meanwhile; those of chunks that have gone since are left out."""
    before = store.pin()
    made = _embedded(store, filters.not_embedded(before.read("chunks"), before.read("vectors")))
    if made.isEmpty():
        return
    with store.lock:
        change = store.tables.change()
        now = replace(store, pinned=change.base)
        _add_vectors(now, change, made, now.read("vectors"))
        change.commit()


def index(store: Store, lines: DataFrame, subagents: DataFrame | None = None, remotes: DataFrame | None = None, force: bool = False, wipe: bool = False, now: str | None = None) -> DataFrame:
    """Index the transcripts whose lines (`transcripts.scan`) are new or have changed since; returns their sessions.

    Sessions without messages or turns are left out. Of a session that is indexed again, summary and remote stay, and
    its vectors go. force takes all sessions; wipe puts them in the place of all tables but the subagents. All changes,
    those of the text index too, count from one commit on.
    """
    if not (force or wipe):
        files = lines.groupBy("path", "session_id").agg(F.max(_iso("mtime")).alias("mtime"))
        lines = lines.join(filters.stale(files, store.read("sessions")).select("path"), "path", "left_semi")
    return _index_messages(store, _parsed(store, lines), subagents, remotes, wipe, now)


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _parsed(store: Store, lines: DataFrame) -> DataFrame:
    """The messages of lines, written once for all who read them."""
    path = storage.scratch(store.spark, "messages")
    transcripts.messages(lines).write.parquet(path)
    return store.spark.read.parquet(path)


def _index_messages(store: Store, msgs: DataFrame, subagents: DataFrame | None, remotes: DataFrame | None, wipe: bool, now: str | None) -> DataFrame:
    spark = store.spark
    at = F.lit(now) if now else _iso(F.current_timestamp())
    made = transcripts.sessions(msgs).withColumns({"indexed_at": at, "parent_session_id": F.lit(None).cast("string"), "topic_summary": F.lit(None).cast("string")})
    made = transcripts.with_remotes(made, remotes) if remotes is not None else made.withColumn("git_remote", F.lit(None).cast("string"))
    ordered = turns.collect_turns(transcripts.dedup_stream(msgs), "session_id", "seq", kind="type", tools="tools")
    cut = turns.number_chunks(turns.create_chunks(ordered, "session_id"), "session_id")
    path = storage.scratch(spark, "indexed")
    made.write.parquet(f"{path}/sessions")
    cut.write.parquet(f"{path}/chunks")
    made, cut = spark.read.parquet(f"{path}/sessions"), spark.read.parquet(f"{path}/chunks")
    ids = made.select("session_id").distinct()
    with store.lock:
        change = store.tables.change()
        if not made.isEmpty() or wipe:
            if wipe:
                change.clear("sessions", "chunks", "vectors")
            old = store.tables.read("sessions", change.now).join(ids, "session_id", "left_semi").select("session_id", "topic_summary", "git_remote")
            kept = dml.upsert_sessions(dml.migrated(old, schema.SESSIONS), dml.migrated(made, schema.SESSIONS))
            change.replace("vectors", None, ids)
            change.replace("chunks", cut, ids)
            change.replace("sessions", kept, ids)
            text_index = store.index_at(0 if wipe else change.base.marks.get("text_index", 0)).update(cut, ids)
            change.mark("text_index", text_index.manifest()["version"])
        if subagents is not None:
            mine = subagents.withColumn("indexed_at", at)
            change.replace("subagents", mine.select(*(c for c in mine.columns if c in schema.SUBAGENTS.names)), mine, "parent_session_id")
        if change.now.tables != change.base.tables or wipe:
            change.commit()
            store.sweep()
    return made


def init(store: Store, lines: DataFrame, **kw) -> DataFrame:
    """Index all transcripts, embed their chunks, and count."""
    index(store, lines, force=True, **kw)
    embed(store)
    return stats(store)


def search_command(
    store: Store,
    query: str,
    limit: int = 10,
    project: str | None = None,
    branch: str | None = None,
    since: str | None = None,
    before: str | None = None,
    grep: bool = False,
    file: bool = False,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
    expand: Callable[[str], list[tuple[str, str]]] | None = None,
    bonus: float = 0.0,
) -> DataFrame:
    """The best hits with their sessions' columns and summaries; file goes before grep, grep before hybrid. Logged."""
    began, store = time.monotonic(), store.pin()
    sessions, chunks = store.read("sessions"), store.read("chunks")
    given = {k: v for k, v in {"project": project, "branch": branch, "since": since, "before": before}.items() if v}
    allowed = filters.session_filter(sessions, project, branch, x.parse_date(since), x.parse_date(before))
    mode = "file" if file else "grep" if grep else "hybrid"
    if file:
        hits = search.file_search(sessions, query, limit, allowed).select("session_id", "score", "chunk_id", "turn_number", "timestamp", F.lit(f"[Session touched file matching: {query}]").alias("user_content"), F.lit("").alias("assistant_content"))
    elif grep:
        hits = search.grep_search(chunks, query, limit, allowed)
    else:
        variants = search.expanded(query, expand, store.query_vector) if expand else []
        hits = search.hybrid(chunks, store.vectors(), query, store.query_vector(query), limit, allowed, variants=variants, rerank=rerank, index=store.index, bonus=bonus)
    hits = hits.select("session_id", "score", "chunk_id", "turn_number", "timestamp", "user_content", "assistant_content")
    about = sessions.select("session_id", "project_path", "slug", "git_branch", "message_count", "first_message_at", "last_message_at", "topic_summary")
    out = about.join(F.broadcast(hits), "session_id", "right")  # limit rows
    path = storage.scratch(store.spark, "hits")
    out.write.parquet(path)
    out = store.spark.read.schema(out.schema).parquet(path).orderBy(F.desc("score"), F.desc("last_message_at") if file else F.desc("chunk_id") if grep else "chunk_id")
    search.log_search(out, query, mode, (time.monotonic() - began) * 1000, store.path("search_log"), filters=given or None)
    return out


def cross_command(store: Store, query: str, research: DataFrame, limit: int = 10, project: str | None = None, branch: str | None = None, since: str | None = None, before: str | None = None) -> DataFrame:
    """Chat and research hits in turns."""
    store = store.pin()
    allowed = filters.session_filter(store.read("sessions"), project, branch, x.parse_date(since), x.parse_date(before))
    return search.cross_search(store.read("chunks"), store.vectors(), research, query, store.query_vector(query), limit, allowed, index=store.index)


def resume_command(store: Store, query: str, limit: int = 10, project: str | None = None) -> DataFrame:
    """The sessions that match best."""
    store = store.pin()
    allowed = filters.session_filter(store.read("sessions"), project)
    return search.resume(store.read("chunks"), store.vectors(), query, store.query_vector(query), limit, allowed=allowed, index=store.index)


def resolve(store: Store, given: str) -> DataFrame:
    """Sessions that an id or the beginning of one means, with `verdict`; none if it means nothing."""
    return filters.resolve_prefix(store.read("sessions"), "session_id", given)


def _one(store: Store, given: str) -> str | None:
    rows = resolve(store, given).filter("verdict = 'found'").select("session_id").limit(1).collect()
    return rows[0][0] if rows else None


def _shortened(chunks: DataFrame, user: int, assistant: int) -> DataFrame:
    return chunks.withColumns({"user": x.truncate(F.coalesce("user_content", F.lit("")), user), "assistant": x.truncate(F.coalesce("assistant_content", F.lit("")), assistant)})


def show(store: Store, given: str, turn: int | None = None, around: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The session with its duration and number of subagents, its chunks in order (matched where they are the turn
    asked for), and its subagents. All empty if the id is unknown or ambiguous."""
    store = store.pin()
    me = _one(store, given) or ""
    session = store.read("sessions").filter(F.col("session_id") == me)
    mine = store.read("subagents").filter(F.col("parent_session_id") == me).orderBy("first_message_at", "agent_id")
    session = session.join(filters.subagent_counts(session, mine), "session_id").withColumn("duration", x.format_duration(F.col("first_message_at"), F.col("last_message_at")))
    chunks = filters.context(filters.session_chunks(store.read("chunks"), me), turn, around)
    matched = F.col("turn_number") == F.lit(turn) if turn is not None else F.lit(False)
    both = [x.truncate(F.coalesce(c, F.lit("")), n) for c, n in (("user_content", HIGHLIGHTED[0]), ("user_content", SHOWN[0]), ("assistant_content", HIGHLIGHTED[1]), ("assistant_content", SHOWN[1]))]
    shown = chunks.select("chunk_id", "turn_number", "timestamp", matched.alias("matched"), F.when(matched, both[0]).otherwise(both[1]).alias("user"), F.when(matched, both[2]).otherwise(both[3]).alias("assistant"))
    return session, shown, mine.withColumns({"size": x.format_size(F.coalesce("file_size", F.lit(0))), "prompt": x.truncate(F.coalesce("first_prompt", F.lit("")), SHOWN[0])})


def list_subagents(store: Store, given: str, found: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """The subagents of a session; where none are stored, those that `found` reads from its files, which are stored."""
    me = _one(store, given) or ""
    mine = store.read("subagents").filter(F.col("parent_session_id") == me)
    if found is not None and me and mine.isEmpty():
        fresh = dml.migrated(found(me), schema.SUBAGENTS).withColumn("indexed_at", F.coalesce("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))
        with store.lock:
            change = store.tables.change()
            change.replace("subagents", fresh, fresh, "parent_session_id")
            change.commit()
        mine = store.read("subagents").filter(F.col("parent_session_id") == me)
    return mine.orderBy("first_message_at", "agent_id")


def subagent(store: Store, given: str, agent: str, lines: DataFrame, raw: bool = False) -> DataFrame:
    """The turns of a session's subagent, from the lines of the subagents' logs."""
    store = store.pin()
    sub = filters.resolve_subagent(store.read("subagents"), _one(store, given) or "", agent).select("agent_id", F.col("jsonl_path").alias("path"))
    msgs = transcripts.dedup_stream(transcripts.messages(lines.join(F.broadcast(sub), "path")))
    paired = turns.pair_turns(msgs, "agent_id", "seq", kind="type").withColumnsRenamed({"user_text": "user_content", "assistant_text": "assistant_content"})
    out = paired if raw else _shortened(paired, *OF_SUBAGENT)
    return out.orderBy("turn_number")


def recover(store: Store, given: str, n: int = 20) -> DataFrame:
    """The last n chunks of a session, in order, in short form."""
    store = store.pin()
    mine = filters.session_chunks(store.read("chunks"), _one(store, given) or "")
    last = filters.tail(mine, "session_id", n, "turn_number", "chunk_id")
    return _shortened(last, *RECOVERED).select("turn_number", "chunk_id", "user", "assistant").orderBy("turn_number", "chunk_id")


def reembed(store: Store) -> DataFrame:
    """Make all vectors anew; counts as in `stats`. The old ones count until the new ones are there."""
    made = _embedded(store, store.read("chunks"))
    with store.lock:
        change = store.tables.change()
        change.clear("vectors")
        now = replace(store, pinned=change.base)
        _add_vectors(now, change, made, store.tables.read("vectors", change.now))
        change.commit()
    embed(store)  # what came meanwhile
    return stats(store)


def summarise(store: Store, limit: int = 50, call: Callable[[str], str | None] = hooks.first_sentence) -> DataFrame:
    """Summaries for the latest sessions that have none; returns them."""
    before = store.pin()
    wanted = filters.without_summary(before.read("sessions"), limit)
    texts = turns.session_text(before.read("chunks").join(F.broadcast(wanted.select("session_id")), "session_id", "left_semi"), "session_id")
    path = storage.scratch(store.spark, "summaries")
    hooks.summarise(texts, call).write.parquet(path)
    made = store.spark.read.parquet(path)
    with store.lock:
        change = store.tables.change()
        sessions = store.tables.read("sessions", change.base).join(made.select("session_id"), "session_id", "left_semi")
        change.replace("sessions", dml.set_summary(sessions, made), made)
        change.commit()
    return made


def full_scan(store: Store, lines: DataFrame, now: str | None = None) -> DataFrame:
    """Catch up at start: index every session whose file or number of messages changed, without cooldown. Lines are read
    and parsed once."""
    msgs = _parsed(store, lines)
    counted = msgs.groupBy("session_id").agg(F.count("*").alias("message_count"))
    known = store.read("sessions").select("session_id", F.col("message_count").alias("had"))
    changed = counted.join(known, "session_id", "left").filter(F.col("had").isNull() | (F.col("had") != F.col("message_count"))).select("session_id")
    return _index_messages(store, msgs.join(changed, "session_id", "left_semi"), None, None, False, now)


@dataclass
class Daemon:
    """The running queries of `daemon`: one that indexes, one that embeds."""

    indexing: StreamingQuery
    embedding: StreamingQuery | None = None
    at_end: Callable[[], None] | None = None

    def awaitTermination(self) -> None:  # noqa: N802  as a query's
        self.indexing.awaitTermination()
        if self.at_end:
            self.at_end()

    def stop(self) -> None:
        for query in (self.indexing, self.embedding):
            if query is not None:
                query.stop()


def daemon(store: Store, queue: str, scan: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = False, root: str | None = None, embed_seconds: int = 30, **rule) -> Daemon:
    """Index the sessions whose paths arrive in a queue folder, and embed their chunks beside it; scan gives the lines of
    a batch's paths.

    With root, paths that are no session's transcript below it are passed over. A session is indexed at once, or when
    its cooldown is over (`indexing.Cooldown`, which takes rule), so no path is lost. Embedding has a query and a timer of
    its own: if the encoder fails, that query ends and indexing goes on. With once, what is queued is indexed without
    cooldown and embedded, and the daemon ends.
    """
    spark = store.spark
    arrived = indexing.read_queue(spark, queue)
    plain = arrived.withColumn("bare", F.regexp_replace("path", "^file:/+", "/"))
    known = transcripts.resolve_paths(plain, root, "bare") if root else plain.withColumn("session_id", F.regexp_replace(x.basename(F.col("path")), r"\.jsonl$", ""))

    def batch(paths: DataFrame, _: int) -> None:
        distinct = paths.select("path").distinct()
        if not distinct.isEmpty():
            full_scan(store, scan(distinct))

    if once:  # timers would keep it waiting for more, so nothing cools down
        return Daemon(indexing.index_stream(known.select("path"), batch, f"{checkpoint}/index", once=True), at_end=lambda: embed(store))
    with indexing.keyed_state(spark):
        main = indexing.index_stream(indexing.cooled(known, **rule), batch, f"{checkpoint}/index")
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    beside = indexing.index_stream(ticks, lambda _, __: embed(store), f"{checkpoint}/embed", seconds=embed_seconds)
    return Daemon(main, beside)
