"""Transcripts: JSON lines under <root>/<project>/<session>.jsonl, parsed into messages, sessions and subagents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadwell.functions.text import basename, decode_project, first_word

KINDS = ("user", "assistant")
#: Tools by what their summary shows.
FILE_TOOLS, SEARCH_TOOLS = ("Read", "Edit", "Write", "MultiEdit"), ("Grep", "Glob")
INTERNAL = ("/.claude/", "/tool-results/")

_BLOCK = "struct<type: string, text: string, name: string, input: struct<file_path: string, command: string, pattern: string, description: string, path: string>>"


def scan(spark: SparkSession, root: str, pattern: str = "*/*.jsonl") -> DataFrame:
    """path, project, session_id (file stem), mtime, size, line_no (from 0) and value of each line of the files one
    level deep.

    Files are split by bytes and read by many tasks, however large one is. A task numbers the lines of its splits as
    they come; what a split's numbers begin at is the count of lines in the file's splits before it, from a first pass
    that reads no more than line ends.
    """
    raw = spark.read.option("pathGlobFilter", "*.jsonl").text(f"{root.rstrip('/')}/{pattern}")
    meta = {"path": "file_path", "mtime": "file_modification_time", "size": "file_size", "_split": "file_block_start"}
    lines = raw.select("value", *(F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("path", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select("path", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = lines.join(shifts, ["path", "_split"]).withColumn("line_no", (F.col("_id") + F.col("_shift")).cast("long"))
    return _named(numbered).select("path", "project", "session_id", "mtime", "size", "line_no", "value")


def _named(files: DataFrame) -> DataFrame:
    """Files with the project and session of their path."""
    parts = F.split("path", "/")
    return files.withColumns({"project": F.element_at(parts, -2), "session_id": F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "")})


def file_lines(files: DataFrame) -> DataFrame:
    """The lines of files (path, mtime, size and value, their whole text), with the project and session of their path."""
    return _named(files).select("path", "project", "session_id", "mtime", "size", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def project_folders(folders: DataFrame, paths: DataFrame) -> DataFrame:
    """project_path and the first folder, by name, that decodes to it; names with hyphens are ambiguous."""
    decoded = folders.select(decode_project(F.col("folder")).alias("project_path"), "folder")
    return decoded.join(paths.select("project_path").distinct(), "project_path").groupBy("project_path").agg(F.min("folder").alias("folder"))


def resolve_paths(paths: DataFrame, root: str, column: str = "path") -> DataFrame:
    """Paths that are transcripts of a session: below root, in a project's folder, not a subagent's."""
    below = F.substring(F.col(column), len(root.rstrip("/")) + 2, 1 << 30)
    ok = F.startswith(column, F.lit(root.rstrip("/") + "/")) & F.endswith(column, F.lit(".jsonl")) & ~F.contains(F.col(column), F.lit("/subagents/")) & (F.size(F.split(below, "/")) >= 2)
    return paths.filter(ok).withColumns({"session_id": F.regexp_replace(basename(F.col(column)), r"\.jsonl$", ""), "project_path": decode_project(F.split(below, "/")[0])})


def _text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def blocks(content: Column) -> Column:
    """A message's content, null, a string or a list of strings and blocks, as an array of blocks."""
    kind = F.schema_of_variant(content)
    as_list = F.transform(
        F.try_variant_get(content, "$", "array<variant>"),
        lambda v: F.when(F.schema_of_variant(v) == "STRING", F.struct(F.lit("text").alias("type"), _text_of(v).alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("input"))).otherwise(
            F.struct(F.try_variant_get(v, "$.type", "string").alias("type"), F.try_variant_get(v, "$.text", "string").alias("text"), F.try_variant_get(v, "$.name", "string").alias("name"), F.try_variant_get(v, "$.input", "variant").alias("input"))
        ),
    )
    one = F.array(F.struct(F.lit("text").alias("type"), _text_of(content).alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("input")))
    return F.when(kind == "STRING", one).when(F.startswith(kind, F.lit("ARRAY")), as_list).otherwise(F.slice(one, 1, 0))


def messages(lines: DataFrame) -> DataFrame:
    """User and assistant messages of scanned lines; blank, broken and non-object lines are skipped."""
    v = F.try_parse_json("value")
    read = lines.withColumn("v", v).filter(F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    get = lambda path: F.try_variant_get("v", path, "string")
    out = read.withColumns({"type": get("$.type")}).filter(F.col("type").isin(*KINDS))
    fields = {"stored_id": "$.sessionId", "slug": "$.slug", "git_branch": "$.gitBranch", "cwd": "$.cwd", "timestamp": "$.timestamp", "request_id": "$.requestId"}
    out = out.withColumns({k: get(p) for k, p in fields.items()} | {"blocks": blocks(F.try_variant_get("v", "$.message.content", "variant"))})
    return out.withColumns({"text": extract_text(F.col("blocks")), "tools": tool_summary(F.col("blocks"))}).drop("v", "value")


def extract_text(blocks: Column) -> Column:
    """The text blocks, joined by line ends; tool and thinking blocks are skipped."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")


def _input(b: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(b["input"], f"$.{key}", "string"), F.lit(""))


def tool_summary(blocks: Column) -> Column:
    """[Tools: ...] with one distinct entry for each way a tool was used, in order, at most 200 characters."""

    def one(b: Column) -> Column:
        name = F.coalesce(b["name"], F.lit(""))
        path, command, pattern, about = (_input(b, k) for k in ("file_path", "command", "pattern", "description"))
        return (
            F.when(name.isin(*FILE_TOOLS), F.when(path != "", F.concat(name, F.lit(" "), basename(path))).otherwise(name))
            .when(name == "Bash", F.when(F.trim(command) != "", F.concat(F.lit("Bash: "), first_word(command))).otherwise(name))
            .when(name.isin(*SEARCH_TOOLS), F.when(pattern != "", F.concat(name, F.lit(" "), F.substring(pattern, 1, 30))).otherwise(name))
            .when(name == "Task", F.when(about != "", F.concat(F.lit("Task: "), F.substring(about, 1, 30))).otherwise(name))
            .otherwise(name)
        )

    parts = F.array_distinct(F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), one))
    whole = F.concat(F.lit("[Tools: "), F.array_join(parts, ", "), F.lit("]"))
    return F.when(F.size(parts) == 0, "").when(F.length(whole) > 200, F.concat(F.substring(whole, 1, 197), F.lit("...]"))).otherwise(whole)


def first_value(value: Column, order: Column | str) -> Column:
    """The first non-null value in order."""
    return F.min_by(value, F.when(value.isNotNull(), F.col(order) if isinstance(order, str) else order))


def ordered_distinct(value: Column, order: str) -> Column:
    """The distinct non-null values of a group in the order in which they first come."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda s: s["v"]))


def sessions(msgs: DataFrame) -> DataFrame:
    """One row for each file: ids, first values, first and last time (as text), count, and what the tools touched."""
    time = F.nullif(F.col("timestamp"), F.lit(""))
    base = msgs.groupBy("path", "project", "session_id").agg(
        F.coalesce(first_value(F.col("stored_id"), "line_no"), F.first("session_id")).alias("stored_id"),
        first_value(F.col("slug"), "line_no").alias("slug"),
        F.coalesce(first_value(F.nullif(F.col("git_branch"), F.lit("")), "line_no"), F.lit("")).alias("git_branch"),
        first_value(F.col("cwd"), "line_no").alias("cwd"),
        F.min(time).alias("first_message_at"),
        F.max(time).alias("last_message_at"),
        F.count("*").alias("message_count"),
    )
    return base.join(tool_metadata(msgs), "path", "left").withColumn("project_path", decode_project(F.col("project")))


def tool_metadata(msgs: DataFrame) -> DataFrame:
    """Files (sorted, internal ones left out), tools (sorted) and the first 50 commands of each file's messages."""
    used = msgs.filter("type = 'assistant'").select("path", "line_no", F.posexplode("blocks").alias("block_no", "b")).filter("b.type = 'tool_use'")
    b = F.col("b")
    name = F.col("b.name")
    file = F.when(name.isin(*FILE_TOOLS), F.nullif(_input(b, "file_path"), F.lit(""))).when(name.isin(*SEARCH_TOOLS), F.nullif(_input(b, "path"), F.lit("")))
    outside = ~(F.contains(file, F.lit(INTERNAL[0])) | F.contains(file, F.lit(INTERNAL[1])))
    command = F.when(name == "Bash", F.nullif(_input(b, "command"), F.lit("")))
    rows = used.select("path", "line_no", "block_no", name.alias("tool"), F.when(outside, file).alias("file"), F.substring(command, 1, 150).alias("command"))
    listed = F.array_sort(F.collect_list(F.when(F.col("command").isNotNull(), F.struct("line_no", "block_no", "command"))))
    return rows.groupBy("path").agg(
        F.array_sort(F.collect_set("file")).alias("files_touched"),
        F.array_sort(F.collect_set(F.nullif(F.col("tool"), F.lit("")))).alias("tools_used"),
        F.slice(F.transform(listed, lambda x: x["command"]), 1, 50).alias("commands_run"),
    )


def dedup_stream(msgs: DataFrame, key: str = "path", order: str = "line_no") -> DataFrame:
    """One assistant message for each request: the longest text, the first of equals. Ordered by time, passed-through
    rows before winners, then by where they were first seen (column `seq`)."""
    keyed = msgs.withColumn("_group", F.when((F.col("type") == "assistant") & F.col("request_id").isNotNull(), F.col("request_id")))
    w = Window.partitionBy(key, "_group")
    best = keyed.withColumns({"_n": F.row_number().over(w.orderBy(F.desc(F.length("text")), order)), "_seen": F.min(order).over(w)}).filter("_group is null or _n = 1")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("timestamp", F.lit("")), F.col("_group").isNotNull(), F.when(F.col("_group").isNull(), F.col(order)).otherwise(F.col("_seen"))))
    return best.withColumn("seq", rank).drop("_group", "_n", "_seen")


def subagents(spark: SparkSession, root: str) -> DataFrame:
    """One row for each <project>/<session>/subagents/agent-<id>.jsonl, with its sidecar's type and description."""
    side = spark.read.option("pathGlobFilter", "*.meta.json").option("recursiveFileLookup", True).text(root, wholetext=True)
    return subagent_table(scan(spark, root, "*/*/subagents/agent-*.jsonl"), side.select(F.col("_metadata.file_path").alias("path"), "value"))


def subagent_table(lines: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The same from the lines of the logs and the sidecars (path and value). Times are first and last in file order."""
    found = lines.withColumns({"agent_id": F.regexp_replace("session_id", "^agent-", ""), "parent_session_id": F.element_at(F.split("path", "/"), -3)})
    msgs = messages(found)
    file = found.groupBy("path", "agent_id", "parent_session_id").agg(F.first("size").alias("file_size"))
    timed = F.when(F.nullif(F.col("timestamp"), F.lit("")).isNotNull(), F.col("line_no"))
    stats = msgs.groupBy("path").agg(
        F.count("*").alias("message_count"),
        F.min_by("timestamp", timed).alias("first_message_at"),
        F.max_by("timestamp", timed).alias("last_message_at"),
        F.substring(F.min_by("text", F.when(F.col("type") == "user", F.col("line_no"))), 1, 500).alias("first_prompt"),
    )
    v = F.try_parse_json("value")
    side = sidecars.select(F.regexp_replace("path", r"\.meta\.json$", ".jsonl").alias("path"), F.try_variant_get(v, "$.agentType", "string").alias("agent_type"), F.try_variant_get(v, "$.description", "string").alias("description"))
    return file.join(stats, "path", "left").join(side, "path", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0))).withColumnRenamed("path", "jsonl_path")


def with_remotes(sessions_: DataFrame, remotes: DataFrame) -> DataFrame:
    """sessions with git_remote from a table (project_path, git_remote) that is filled outside of the engine."""
    return sessions_.drop("git_remote").join(remotes.select("project_path", "git_remote"), "project_path", "left")
