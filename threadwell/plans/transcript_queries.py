"""Registered queries of the transcript source: conversations written as JSON lines and read back.

A conversation is a file /logs/-home-p<id mod 3>/<id>.jsonl. Assistants use tools by their turn: Read, Edit or Grep a
file, Bash a command, Task. User texts are strings, assistant texts lists of blocks. Each file has a blank line, a
broken one and one that is no object.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadwell.plans.search_queries import query
from threadwell.plans.stand_ins import load
from threadwell.sources import transcripts

_TOOLS = """CASE turn % 4
WHEN 0 THEN concat('{{"type":"tool_use","name":"Read","input":{{"file_path":"/src/f', turn, '.py"}}}}')
WHEN 1 THEN concat('{{"type":"tool_use","name":"Bash","input":{{"command":"run  t', turn, ' -v"}}}}')
WHEN 2 THEN concat('{{"type":"tool_use","name":"Grep","input":{{"pattern":"p', turn, '","path":"/home/.claude/x"}}}}')
ELSE concat('{{"type":"tool_use","name":"Task","input":{{"description":"d', turn, '"}}}}') END""".replace("{{", "{").replace("}}", "}")


def logs(spark, d, path: str = "concat('/logs/-home-p', conv_id % 3, '/', conv_id, '.jsonl')"):
    """The files: path, mtime, size and value."""
    rows = load(spark, d, "conversations")
    said = F.to_json(F.struct("text"))  # {"text":...}: the text with its escapes
    quoted = said.substr(F.lit(9), F.length(said) - 9)
    content = F.when(F.col("role") == "assistant", F.concat(F.lit('[{"type":"text","text":'), quoted, F.lit("},"), F.expr(_TOOLS), F.lit("]"))).otherwise(quoted)
    head = F.concat(
        F.lit('{"type":"'), "role", F.lit('","sessionId":"s'), F.col("conv_id").cast("string"), F.lit('","cwd":"/w","timestamp":"2024-01-01T00:0'), F.col("turn").cast("string"), F.lit(':00Z"'),
        F.when(F.col("turn") >= 2, F.lit(',"slug":"late"')).otherwise(""), F.when(F.col("turn") == 1, F.lit(',"gitBranch":""')).otherwise(F.lit(',"gitBranch":"main"')),
        F.when(F.col("role") == "assistant", F.concat(F.lit(',"requestId":"r'), F.floor(F.col("turn") / 4).cast("string"), F.lit('"'))).otherwise(""),
    )
    line = F.concat(head, F.lit(',"message":{"content":'), content, F.lit("}}"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    value = F.concat(F.lit("\n{broken\n[1, 2]\n"), F.array_join("lines", "\n"))
    files = rows.groupBy("conv_id").agg(listed.alias("lines")).withColumn("value", value)
    return files.select(F.expr(path).alias("path"), F.current_timestamp().alias("mtime"), F.length("value").cast("long").alias("size"), "value")


def messages(spark, d):
    return transcripts.messages(transcripts.file_lines(logs(spark, d)))


#: Messages, what their tools say, and the line in the file (three lines stand before).
MESSAGES_SQL = """m AS (SELECT *, turn - min(turn) OVER (PARTITION BY conv_id) + 3 AS at FROM conversations WHERE role IN ('user', 'assistant', 'system')),
said AS (SELECT conv_id, turn, role, text, CASE WHEN role <> 'assistant' THEN '' ELSE '[Tools: ' || CASE turn % 4 WHEN 0 THEN 'Read f' || turn || '.py' WHEN 1 THEN 'Bash: run' WHEN 2 THEN 'Grep p' || turn ELSE 'Task: d' || turn END || ']' END AS tools FROM m WHERE role <> 'system')"""


@query(f"WITH {MESSAGES_SQL} SELECT conv_id::VARCHAR AS session_id, '2024-01-01T00:0' || turn || ':00Z' AS timestamp, role AS type, md5(text) AS text_md5, tools FROM said")
def transcript_messages(spark, d):
    return messages(spark, d).select("session_id", "timestamp", "type", F.md5("text").alias("text_md5"), "tools")


@query(f"""WITH {MESSAGES_SQL} SELECT conv_id::VARCHAR AS session_id, 's' || conv_id AS stored_id, '/home/p' || (conv_id % 3) AS project_path, CASE WHEN max(turn) >= 2 THEN 'late' END AS slug,
CASE WHEN bool_or(turn <> 1) THEN 'main' ELSE '' END AS git_branch, min('2024-01-01T00:0' || turn || ':00Z') AS first_message_at, max('2024-01-01T00:0' || turn || ':00Z') AS last_message_at, count(*) AS message_count FROM said GROUP BY conv_id""")
def transcript_sessions(spark, d):
    return transcripts.sessions(messages(spark, d)).select("session_id", "stored_id", "project_path", "slug", "git_branch", "first_message_at", "last_message_at", "message_count")


@query(f"""WITH {MESSAGES_SQL}, a AS (SELECT * FROM said WHERE role = 'assistant') SELECT conv_id::VARCHAR AS session_id,
coalesce(string_agg(DISTINCT CASE WHEN turn % 4 = 0 THEN '/src/f' || turn || '.py' END, ',' ORDER BY CASE WHEN turn % 4 = 0 THEN '/src/f' || turn || '.py' END), '') AS files,
string_agg(DISTINCT CASE turn % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Grep' ELSE 'Task' END, ',' ORDER BY CASE turn % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Grep' ELSE 'Task' END) AS tools,
coalesce(string_agg(CASE WHEN turn % 4 = 1 THEN 'run  t' || turn || ' -v' END, ',' ORDER BY turn), '') AS commands FROM a GROUP BY conv_id""")
def transcript_tools(spark, d):
    used = transcripts.sessions(messages(spark, d)).filter("tools_used is not null")
    return used.select("session_id", F.array_join("files_touched", ",").alias("files"), F.array_join("tools_used", ",").alias("tools"), F.array_join("commands_run", ",").alias("commands"))


@query(f"""WITH {MESSAGES_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY length(text) DESC, turn) AS k FROM said WHERE role = 'assistant') SELECT conv_id::VARCHAR AS session_id, turn FROM g WHERE k = 1
UNION ALL SELECT conv_id::VARCHAR, turn FROM said WHERE role = 'user'""")
def transcript_dedup(spark, d):
    kept = transcripts.dedup_stream(messages(spark, d))
    return kept.select("session_id", F.substring("timestamp", 16, 1).cast("long").alias("turn"))


_AGENT = "concat('/logs/-home-p', conv_id % 3, '/s', conv_id % 10, '/subagents/agent-', lpad(conv_id, 6, '0'), '.jsonl')"


@query(f"""WITH {MESSAGES_SQL}, n AS (SELECT conv_id, count(*) AS message_count, min('2024-01-01T00:0' || turn || ':00Z') AS first_message_at, max('2024-01-01T00:0' || turn || ':00Z') AS last_message_at, md5(substr(arg_min(text, turn) FILTER (WHERE role = 'user'), 1, 500)) AS prompt_md5 FROM said GROUP BY conv_id)
SELECT lpad(c.conv_id::VARCHAR, 6, '0') AS agent_id, 's' || (c.conv_id % 10) AS parent_session_id, coalesce(message_count, 0) AS message_count, first_message_at, last_message_at, prompt_md5, CASE WHEN c.conv_id % 2 = 0 THEN 'kind' || c.conv_id END AS agent_type FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n USING (conv_id)""")
def transcript_subagents(spark, d):
    files = logs(spark, d, _AGENT)
    even = load(spark, d, "conversations").filter("conv_id % 2 = 0").select("conv_id").distinct()
    sidecars = even.select(F.regexp_replace(F.expr(_AGENT), r"\.jsonl$", ".meta.json").alias("path"), F.concat(F.lit('{"agentType": "kind'), F.col("conv_id").cast("string"), F.lit('", "description": "x"}')).alias("value"))
    found = transcripts.subagent_table(transcripts.file_lines(files), sidecars)
    return found.select("agent_id", "parent_session_id", "message_count", "first_message_at", "last_message_at", F.md5("first_prompt").alias("prompt_md5"), "agent_type")


@query("SELECT conv_id::VARCHAR AS session_id, '/home/p' || (conv_id % 3) AS project_path FROM conversations GROUP BY conv_id")
def transcript_paths(spark, d):
    """Of all paths, those of sessions."""
    own = logs(spark, d).select("path").unionByName(logs(spark, d, _AGENT).select("path")).unionByName(logs(spark, d, "concat('/logs/', conv_id, '.jsonl')").select("path")).unionByName(logs(spark, d, "concat('/other/-home-p1/', conv_id, '.jsonl')").select("path"))
    return transcripts.resolve_paths(own, "/logs").select("session_id", "project_path")
