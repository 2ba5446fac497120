"""The stored relations."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


SESSIONS = _struct(
    session_id=_S, project_path=_S, slug=_S, git_branch=_S, first_message_at=_S, last_message_at=_S, message_count=_L, indexed_at=_S,
    files_touched=T.ArrayType(_S), tools_used=T.ArrayType(_S), commands_run=T.ArrayType(_S), parent_session_id=_S, topic_summary=_S, git_remote=_S, cwd=_S,
)
CHUNKS = _struct(chunk_id=_L, session_id=_S, turn_number=_L, part=T.IntegerType(), timestamp=_S, user_content=_S, assistant_content=_S, combined_text=_S, token_estimate=_L)
SUBAGENTS = _struct(agent_id=_S, parent_session_id=_S, agent_type=_S, description=_S, message_count=_L, file_size=_L, first_prompt=_S, first_message_at=_S, last_message_at=_S, jsonl_path=_S, indexed_at=_S)
VECTORS = _struct(chunk_id=_L, embedding=T.ArrayType(T.FloatType()))
