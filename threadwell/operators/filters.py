"""Filters and lookups over sessions and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadwell.functions.text import ascii_json, ascii_lower, contains_like


def expand_project(sessions: DataFrame, project: str) -> DataFrame:
    """project_path of every session whose remote is shared with a path that matches; none unless that is over one path.

    The count gate is a broadcast of one row, so the choice is made inside the plan.
    """
    remotes = sessions.filter(contains_like(F.col("project_path"), project) & F.col("git_remote").isNotNull()).select("git_remote").distinct()
    paths = sessions.join(remotes, "git_remote", "left_semi").select("project_path").distinct()
    many = paths.agg(F.count("*").alias("n")).filter("n > 1").select("n")
    return paths.crossJoin(F.broadcast(many)).select("project_path")


def session_filter(sessions: DataFrame, project: str | None = None, branch: str | None = None, since: str | None = None, before: str | None = None, key: str = "session_id") -> DataFrame | None:
    """Allowed sessions, or None if nothing is filtered. An empty string counts as absent.

    Times are compared as text; a session qualifies if it overlaps the window, ends included.
    """
    checks: list[Column] = []
    if branch:
        checks.append(contains_like(F.col("git_branch"), branch))
    if since:
        checks.append(F.col("last_message_at") >= since)
    if before:
        checks.append(F.col("first_message_at") <= before)
    if not project and not checks:
        return None
    out = sessions
    if project:
        by_name = contains_like(F.col("project_path"), project)
        if "git_remote" in sessions.columns:
            paths = expand_project(sessions, project).withColumn("_shared", F.lit(True))
            any_ = paths.agg((F.count("*") > 0).alias("_any"))
            out = out.join(paths, "project_path", "left").crossJoin(F.broadcast(any_))
            by_name = F.when(F.col("_any"), F.coalesce("_shared", F.lit(False))).otherwise(by_name)
        checks.append(by_name)
    return out.filter(reduce(Column.__and__, checks)).select(key).distinct()


def grep(chunks: DataFrame, query: str, limit: int | None = 50, key: str = "chunk_id", text: str = "combined_text") -> DataFrame:
    """Chunks whose text holds the query in the sense of `like`, newest id first."""
    if not query.strip():
        return chunks.limit(0)
    out = chunks.filter(contains_like(F.col(text), query))
    return out if limit is None else out.orderBy(F.desc(key)).limit(limit)


def file_matches(sessions: DataFrame, query: str, limit: int | None = 20, files: str = "files_touched", key: str = "session_id") -> DataFrame:
    """Sessions whose list of files, as JSON text, holds the query; latest first.

    The text is ASCII, so that an accented letter of a name stands there as its escape, and is found by that alone.
    """
    if not query.strip():
        return sessions.limit(0)
    out = sessions.filter(contains_like(ascii_json(F.col(files)), query))
    return out if limit is None else out.orderBy(F.desc("last_message_at"), key).limit(limit)


def resolve_prefix(df: DataFrame, column: str, given: str) -> DataFrame:
    """Matches of an id or its prefix with `verdict`: found, or ambiguous; an exact id wins over longer ones."""
    exact = F.col(column) == given
    hit = df.filter(F.startswith(ascii_lower(F.col(column)), ascii_lower(F.lit(given))) | exact)
    all_rows = Window.partitionBy(F.lit(1))  # the few rows that match
    counted = hit.withColumns({"_exact": F.max(exact.cast("int")).over(all_rows), "_n": F.count("*").over(all_rows)})
    kept = counted.filter((F.col("_exact") == 0) | exact)
    verdict = F.when((F.col("_exact") == 1) | (F.col("_n") == 1), "found").otherwise("ambiguous")
    return kept.withColumn("verdict", verdict).drop("_exact", "_n")


def context(chunks: DataFrame, turn: int | None, around: int | None) -> DataFrame:
    """Chunks within `around` turns, if both are given."""
    return chunks if turn is None or around is None else chunks.filter(F.abs(F.col("turn_number") - turn) <= around)


def tail(df: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    """The last n rows of each group in order."""
    last = F.row_number().over(Window.partitionBy(group).orderBy(*(F.desc(o) for o in order)))
    return df.withColumn("_n", last).filter(F.col("_n") <= n).drop("_n")


def without_summary(sessions: DataFrame, limit: int = 50) -> DataFrame:
    """Sessions of over two messages that have no summary, latest first."""
    return sessions.filter(F.col("topic_summary").isNull() & (F.col("message_count") > 2)).orderBy(F.desc("first_message_at"), "session_id").limit(limit)


def not_embedded(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    return chunks.join(vectors.select(key), key, "left_anti")


def stale(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files (session_id, mtime) that were never indexed or have changed since (indexed_at, as ISO text)."""
    return files.join(indexed.select("session_id", "indexed_at"), "session_id", "left").filter(F.col("indexed_at").isNull() | (F.col("indexed_at") < F.col("mtime"))).drop("indexed_at")


def stats(sessions: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts of sessions, summarised ones, chunks and embedded chunks."""
    a = sessions.agg(F.count("*").alias("sessions"), F.count("topic_summary").alias("summarised"))
    b = chunks.agg(F.count("*").alias("chunks"))
    c = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_semi").agg(F.count("*").alias("embedded"))
    return a.crossJoin(b).crossJoin(c)


def session_chunks(chunks: DataFrame, session_id, session: str = "session_id", key: str = "chunk_id") -> DataFrame:
    """The chunks of one session by turn; parts of a turn by their id."""
    return chunks.filter(F.col(session) == session_id).orderBy("turn_number", key)


def resolve_subagent(subagents: DataFrame, parent: str, given: str) -> DataFrame:
    """The first subagent of a session, by id, whose id begins with what is given; ambiguity does not matter."""
    hit = subagents.filter((F.col("parent_session_id") == parent) & F.startswith(ascii_lower(F.col("agent_id")), ascii_lower(F.lit(given))))
    return hit.orderBy("agent_id").limit(1)


def subagent_counts(sessions: DataFrame, subagents: DataFrame, session: str = "session_id") -> DataFrame:
    """session and the number of its subagents, 0 for none."""
    n = subagents.groupBy(F.col("parent_session_id").alias(session)).agg(F.count("*").alias("subagents"))
    return sessions.select(session).distinct().join(n, session, "left").withColumn("subagents", F.coalesce("subagents", F.lit(0)))
