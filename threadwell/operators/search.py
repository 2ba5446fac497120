"""The search modes: hybrid, grep, file, cross-corpus and resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadwell.functions.text import basename
from threadwell.operators.filters import file_matches, grep
from threadwell.operators.retrieval import bm25, first_per_group, ranked, reciprocal_rank_fusion, vector_topk
from threadwell.operators.text_index import TextIndex, TrigramIndex
from threadwell.operators.vector_index import VectorIndex

#: How many times the limit each list is asked for, since the session filter comes after them.
HYBRID_FETCH, FUSED_CAP, GREP_FETCH, FILE_FETCH, RESUME_FETCH = 5, 10, 5, 3, 3


def _allowed(df: DataFrame, allowed: DataFrame | None, session: str) -> DataFrame:
    return df if allowed is None else df.join(allowed, session, "left_semi")


def fused(chunks: DataFrame, vectors: DataFrame | VectorIndex, query: str, query_vector: DataFrame, limit: int, key: str = "chunk_id", text: str = "combined_text", match: str = "any", variants: list[tuple[str, str, DataFrame | None]] = (), index: TextIndex | None = None, bonus: float = 0.0, allowed: DataFrame | None = None) -> DataFrame:
    """Vector and text lists joined by rank; of the allowed sessions only, if given, for which chunks and vectors are
    already filtered and the index sums figures of its own. variants are more queries: ("lex", text, None), ("vec", text, vector) or
    ("hyde", text, vector), which is a made-up answer. bonus goes to the first of each list."""
    fetch = limit * HYBRID_FETCH
    near = lambda q: ranked(vectors.search(q, fetch) if isinstance(vectors, VectorIndex) else vector_topk(vectors, q, fetch, key), "distance", key)
    words = lambda q: ranked(index.search(q, fetch, match, allowed, own_figures=allowed is not None) if index else bm25(chunks, q, fetch, key, text, match), "rank", key)
    lists = [near(query_vector), words(query)]
    lists += [words(q) if kind == "lex" else near(v) for kind, q, v in variants]
    return reciprocal_rank_fusion(lists, key, bonus=bonus).orderBy(F.desc("score"), "list_no", "pos", key).limit(limit * FUSED_CAP)


def hybrid(
    chunks: DataFrame,
    vectors: DataFrame | VectorIndex,
    query: str,
    query_vector: DataFrame,
    limit: int = 10,
    allowed: DataFrame | None = None,
    key: str = "chunk_id",
    session: str = "session_id",
    text: str = "combined_text",
    filter_mode: str = "post",
    match: str = "any",
    variants: list[tuple[str, str, DataFrame | None]] = (),
    rerank: Callable[[DataFrame], DataFrame] | None = None,
    index: TextIndex | None = None,
    bonus: float = 0.0,
) -> DataFrame:
    """The best chunk of each session by fused rank; words come from the index where one is given, and near vectors from
    a clustered table if vectors is one (filtered before, all vectors are compared).

    filter_mode "post" filters sessions after the lists are cut, "pre" before, which loses nothing; then the index sums
    its figures over the allowed documents. Ranking works on ids and scores; the wide rows are joined to the few that
    stay. rerank gets the result and returns it with new
    scores.
    """
    narrow = chunks.select(key, session, text)
    before = allowed if filter_mode == "pre" else None
    if before is not None:
        narrow = narrow.join(before, session, "left_semi")
        vectors = (vectors.table() if isinstance(vectors, VectorIndex) else vectors).join(narrow.select(key), key, "left_semi")
    hits = fused(narrow, vectors, query, query_vector, limit, key, text, match, variants, index, bonus, before)
    few = F.broadcast(hits)  # 10 * limit rows
    placed = _allowed(chunks.select(key, session).join(few, key), allowed, session)
    order = (F.desc("score"), "list_no", "pos", key)
    best = first_per_group(placed, session, *order).orderBy(*order).limit(limit)
    out = chunks.drop(session).join(F.broadcast(best), key).orderBy(*order)
    return rerank(out).orderBy(F.desc("score"), key) if rerank else out


def grep_search(chunks: DataFrame, query: str, limit: int = 10, allowed: DataFrame | None = None, key: str = "chunk_id", session: str = "session_id", text: str = "combined_text", index: TrigramIndex | None = None) -> DataFrame:
    """The newest chunk of each session that holds the query; score 1. With an index only its candidates are read for
    the query, and the few hits are joined to their rows."""
    if index is None:
        found = grep(chunks, query, limit * GREP_FETCH, key, text)
    else:
        found = chunks.join(F.broadcast(index.grep(query, limit * GREP_FETCH).select(key)), key, "left_semi")
    hits = _allowed(found, allowed, session)
    return first_per_group(hits, session, F.desc(key)).orderBy(F.desc(key)).limit(limit).withColumn("score", F.lit(1.0))


def file_search(sessions: DataFrame, query: str, limit: int = 10, allowed: DataFrame | None = None, files: str = "files_touched", session: str = "session_id") -> DataFrame:
    """Sessions that touched a file with the query in its name; score 1, no chunk."""
    hits = _allowed(file_matches(sessions, query, limit * FILE_FETCH, files, session), allowed, session)
    shown = {"score": F.lit(1.0), "chunk_id": F.lit(0).cast("long"), "turn_number": F.lit(0).cast("long"), "timestamp": F.col("first_message_at")}
    return hits.orderBy(F.desc("last_message_at"), session).limit(limit).withColumns(shown)


def cross(chat: DataFrame, research: DataFrame, limit: int = 10, chat_text: str = "content", name: str = "source_file") -> DataFrame:
    """Chat hits and research hits (each with `pos` from 0) in turns, chat first.

    A research hit goes if its file's name stands in a chat hit before it. Both lists are short, so the comparison is
    a nested loop over a few rows; a file is taken once, by its best place.
    """
    files = ranked(first_per_group(research, name, "pos"), "pos").withColumn("rank", F.col("pos"))
    both = chat.select(F.lit("chat").alias("source"), "pos", F.col(chat_text).alias("content"), F.lit(None).cast("string").alias(name)).unionByName(files.select(F.lit("research").alias("source"), "pos", "content", name))
    scored = both.withColumn("score", 1.0 / (61 + F.col("pos")))
    order = (F.desc("score"), "source")
    merged = ranked(scored.withColumnRenamed("pos", "own_pos"), *order)
    named = merged.filter("source = 'chat'").select(F.col("content").alias("said"), F.col("pos").alias("said_at"))
    told = F.contains("said", basename(F.col(name))) & (F.col("said_at") < F.col("pos"))
    kept = merged.filter("source = 'research'").join(F.broadcast(named), told, "left_anti")
    return merged.filter("source = 'chat'").unionByName(kept).orderBy("pos").limit(limit)


def cross_search(chunks: DataFrame, vectors: DataFrame, research: DataFrame, query: str, query_vector: DataFrame, limit: int = 10, allowed: DataFrame | None = None, key: str = "chunk_id", session: str = "session_id", text: str = "combined_text", **kw) -> DataFrame:
    """The chat hits of a hybrid search, a chunk for each session and not cut by limit, in turns with the research hits.

    research has id, source_file, content and embedding; its hits are its nearest vectors, as many as are fetched for
    each chat list.
    """
    hits = fused(chunks, vectors, query, query_vector, limit, key, text, **kw)
    placed = _allowed(chunks.select(key, session, F.col(text).alias("content")).join(F.broadcast(hits), key), allowed, session)
    order = (F.desc("score"), "list_no", F.col("pos"), key)
    best = first_per_group(placed, session, *order)
    chat = best.withColumnsRenamed({"pos": "_pos"}).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "list_no", "_pos", key)) - 1)  # 10 * limit rows at most
    near = vector_topk(research, query_vector, limit * HYBRID_FETCH, "id")
    found = ranked(research.select("id", "source_file", "content").join(F.broadcast(near), "id"), "distance", "id")
    return cross(chat, found, limit)


def expanded(query: str, expand: Callable[[str], list[tuple[str, str]]], embed: Callable[[str], DataFrame]) -> list[tuple[str, str, DataFrame | None]]:
    """The variants of a query for `hybrid`, from an expander: lex as it is, vec and hyde with their vectors."""
    return [(kind, q, None if kind == "lex" else embed(q)) for kind, q in expand(query) if kind in ("lex", "vec", "hyde")]


def resume(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: DataFrame, limit: int = 10, session: str = "session_id", **kw) -> DataFrame:
    """The sessions that match best, by their best chunk; of equal ones the chunk with the smallest id."""
    key = kw.get("key", "chunk_id")
    hits = hybrid(chunks, vectors, query, query_vector, limit * RESUME_FETCH, session=session, **kw)
    return hits.groupBy(session).agg(F.max("score").alias("score"), F.min_by(key, F.struct(-F.col("score"), key)).alias("chunk")).orderBy(F.desc("score"), session).limit(limit)


def with_summaries(hits: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Hits with the topic_summary of their sessions; hits are few and are what is broadcast."""
    return sessions.select(session, "topic_summary").join(F.broadcast(hits), session, "right")


def log_entry(result: DataFrame, query: str, mode: str, ms: float, session: str = "session_id", filters: dict[str, str] | None = None) -> DataFrame:
    """One row for a search: time, query, mode, number of results, milliseconds, filters and hits."""
    has = lambda c, else_: F.col(c) if c in result.columns else F.lit(else_)
    hit = F.struct(
        F.substring(F.col(session).cast("string"), 1, 12).alias("session"),
        F.bround("score", 4).alias("score"),
        basename(F.coalesce(has("project_path", ""), F.lit(""))).alias("project"),
        F.coalesce(has("turn_number", 0), F.lit(0)).cast("long").alias("turn"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col(session).cast("string").alias("s"), hit.alias("hit")))), lambda x: x["hit"])
    given = [F.create_map(*(F.lit(x) for kv in filters.items() for x in kv)).alias("filters")] if filters else []
    return result.agg(F.current_timestamp().alias("ts"), F.lit(query).alias("query"), F.lit(mode).alias("mode"), F.count("*").alias("results"), F.lit(round(ms, 1)).alias("ms"), listed.alias("hits")).select("*", *given)


def log_search(result: DataFrame, query: str, mode: str, ms: float, path: str, session: str = "session_id", filters: dict[str, str] | None = None) -> None:
    """Append one JSON line for a search with its hits."""
    log_entry(result, query, mode, ms, session, filters).write.mode("append").json(path)
