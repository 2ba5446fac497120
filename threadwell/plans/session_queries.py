"""Registered queries of messages, turns, chunks, formatting and continuous indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadwell.functions import hooks
from threadwell.functions import text as x
from threadwell.operators import filters, turns
from threadwell.plans.search_queries import query
from threadwell.plans.stand_ins import LIVES_SQL, MESSAGES_SQL, chunks, lives, load, messages
from threadwell.sources.transcripts import dedup_stream, first_value
from threadwell.sources.transcripts import ordered_distinct as in_order
from threadwell.streaming import indexing


@query(f"WITH {LIVES_SQL} SELECT session_id, first_message_at, last_message_at, message_count FROM lives")
def session_rollup(spark, d):
    return lives(spark, d).drop("files_touched")


@query("SELECT user_id, arg_min(CASE WHEN value > 20 THEN event_type END, event_id) FILTER (WHERE value > 20) AS first_type FROM events GROUP BY user_id")
def first_non_null(spark, d):
    big = F.when(F.col("value") > 20, F.col("event_type"))
    return load(spark, d, "events").groupBy("user_id").agg(first_value(big, "event_id").alias("first_type"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2")
def tail_n(spark, d):
    return filters.tail(load(spark, d, "conversations"), "conv_id", 2, "turn").select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations WHERE abs(turn - 3) <= 1")
def context_window(spark, d):
    return filters.context(load(spark, d, "conversations").withColumnRenamed("turn", "turn_number"), 3, 1).select("conv_id", F.col("turn_number").alias("turn"))


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
TURNS_SQL = f"""WITH {MESSAGES_SQL}, n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM msgs),
t AS (SELECT conv_id, g, {_TRIM.format("coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), '')")} AS user_text, {_TRIM.format("coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '')")} AS assistant_text FROM n WHERE g > 0 GROUP BY conv_id, g),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS turn_number, user_text, assistant_text FROM t WHERE NOT (user_text = '' AND length(assistant_text) < 100))"""


def _turns(spark, d):
    return turns.collect_turns(messages(spark, d), "conv_id", "turn")


@query(f"{TURNS_SQL} SELECT conv_id, turn_number, md5(user_text) AS user_md5, md5(assistant_text) AS assistant_md5 FROM turns")
def turn_pairs(spark, d):
    return _turns(spark, d).select("conv_id", "turn_number", F.md5("user_text").alias("user_md5"), F.md5("assistant_text").alias("assistant_md5"))


@query(f"""WITH {MESSAGES_SQL}, s AS (SELECT *, CASE WHEN role = 'user' OR coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'assistant') <> 'user' THEN 1 ELSE 0 END AS st FROM msgs),
n AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_number FROM s)
SELECT conv_id, turn_number::BIGINT AS turn_number, md5(coalesce(max(text) FILTER (WHERE role = 'user'), '')) AS user_md5, md5(coalesce(max(text) FILTER (WHERE role = 'assistant'), '')) AS assistant_md5 FROM n GROUP BY conv_id, turn_number""")
def turn_pairs_next_only(spark, d):
    return turns.pair_turns(messages(spark, d), "conv_id", "turn").select("conv_id", "turn_number", F.md5("user_text").alias("user_md5"), F.md5("assistant_text").alias("assistant_md5"))


@query(f"WITH {MESSAGES_SQL}, g AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN turn // 3 END AS request FROM msgs) SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, request ORDER BY length(text) DESC, turn) AS k FROM g) WHERE request IS NULL OR k = 1")
def stream_dedup_longest(spark, d):
    request = F.when(F.col("role") == "assistant", F.floor(F.col("turn") / 3).cast("string"))
    rows = messages(spark, d).withColumns({"type": F.col("role"), "request_id": request, "timestamp": F.lpad(F.col("turn").cast("string"), 4, "0")})
    return dedup_stream(rows, "conv_id", "turn").select("conv_id", "turn")


_TOK = "CAST(ceil(length({0}) / 4.0) AS BIGINT)"
_RENDER = "'User: ' || {0} || chr(10) || chr(10) || 'Assistant: ' || {1}"
_JOIN = "CASE WHEN {0} = '' THEN {1} WHEN {2} = '' THEN {0} ELSE {0} || chr(10) || '---' || chr(10) || {1} END"
_JU = _JOIN.format("f.pu", "t.user_text", "trim(t.user_text)")
_JA = _JOIN.format("f.pa", "t.assistant_text", "trim(t.assistant_text)")
#: The merge of tiny turns as a recursive walk over each conversation's turns: the pending turn, and what was emitted.
MERGE_SQL = f"""{TURNS_SQL.replace("WITH msgs", "WITH RECURSIVE msgs")},
fold AS (
  SELECT conv_id, -1::BIGINT AS i, NULL::BIGINT AS pn, ''::VARCHAR AS pu, ''::VARCHAR AS pa, []::STRUCT(n BIGINT, u VARCHAR, a VARCHAR)[] AS out FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, i + 1,
    CASE WHEN pn IS NULL THEN CASE WHEN tok < 200 THEN i + 1 END WHEN jt <= 600 THEN CASE WHEN jt < 200 THEN pn END ELSE CASE WHEN tok < 200 THEN i + 1 END END,
    CASE WHEN pn IS NULL OR jt > 600 THEN tu ELSE ju END,
    CASE WHEN pn IS NULL OR jt > 600 THEN ta ELSE ja END,
    CASE WHEN pn IS NULL THEN CASE WHEN tok < 200 THEN out ELSE list_append(out, {{'n': i + 1, 'u': tu, 'a': ta}}) END
         WHEN jt <= 600 THEN CASE WHEN jt < 200 THEN out ELSE list_append(out, {{'n': pn, 'u': ju, 'a': ja}}) END
         ELSE CASE WHEN tok < 200 THEN list_append(out, {{'n': pn, 'u': pu, 'a': pa}}) ELSE list_append(list_append(out, {{'n': pn, 'u': pu, 'a': pa}}), {{'n': i + 1, 'u': tu, 'a': ta}}) END END
  FROM (SELECT f.*, t.user_text AS tu, t.assistant_text AS ta, {_JU} AS ju, {_JA} AS ja,
               {_TOK.format('(' + _RENDER.format('t.user_text', 't.assistant_text') + ')')} AS tok, {_TOK.format('(' + _RENDER.format('(' + _JU + ')', '(' + _JA + ')') + ')')} AS jt
        FROM fold f JOIN turns t ON t.conv_id = f.conv_id AND t.turn_number = f.i + 1)
),
last AS (SELECT f.* FROM fold f JOIN (SELECT conv_id, max(i) AS i FROM fold GROUP BY conv_id) m ON m.conv_id = f.conv_id AND m.i = f.i),
emitted AS (SELECT conv_id, unnest(CASE WHEN pn IS NULL THEN out ELSE list_append(out, {{'n': pn, 'u': pu, 'a': pa}}) END) AS r FROM last),
merged AS (SELECT conv_id, r.n AS turn_number, r.u AS user_text, r.a AS assistant_text FROM emitted)"""


@query(f"{MERGE_SQL} SELECT conv_id, turn_number, md5(user_text) AS user_md5, md5(assistant_text) AS assistant_md5 FROM merged")
def merge_tiny_turns(spark, d):
    return turns.merged_turns(_turns(spark, d), "conv_id").select("conv_id", "turn_number", F.md5("user_text").alias("user_md5"), F.md5("assistant_text").alias("assistant_md5"))


_PREFIX = "'User: ' || user_text || chr(10) || chr(10)"
_TOKENS_OF = "list_sum(list_transform({0}, lambda x: CAST(ceil(length(x) / 4.0) AS BIGINT)))"


def _walk_sql(source: str, keys: str) -> str:
    """CTEs walk and cut: the parts of texts with paragraphs ps and a limit `most`, by a recursive walk: the parts at
    hand and those that are complete, each opening with the end of the last."""
    return f"""walk AS (
  SELECT {keys}, ps, most, 0::BIGINT AS i, []::VARCHAR[] AS parts, 0::BIGINT AS now, []::VARCHAR[] AS done FROM {source}
  UNION ALL
  SELECT {keys}, ps, most, i + 1,
    list_append(CASE WHEN full_ THEN tail ELSE parts END, p), tok + CASE WHEN full_ THEN coalesce({_TOKENS_OF.format("tail")}, 0)::BIGINT ELSE now END,
    CASE WHEN full_ THEN list_append(done, array_to_string(parts, chr(10))) ELSE done END
  FROM (SELECT *, parts[len(parts) - keep + 1:] AS tail FROM (
    SELECT *, len(parts) > 0 AND now + tok > most AS full_, list_max(list_filter(range(0, len(parts) + 1), lambda k: coalesce({_TOKENS_OF.format("parts[len(parts) - k + 1:]")}, 0) <= floor(now * 0.25))) AS keep
    FROM (SELECT *, ps[i + 1] AS p, CAST(ceil(length(ps[i + 1]) / 4.0) AS BIGINT) AS tok FROM walk WHERE i < len(ps))))
),
cut AS (SELECT {keys}, unnest(list_append(done, array_to_string(parts, chr(10)))) AS piece, generate_subscripts(list_append(done, array_to_string(parts, chr(10))), 1) - 1 AS part FROM walk WHERE i = len(ps))"""


#: Chunks of merged turns.
CHUNKS_SQL = f"""{MERGE_SQL},
sized AS (SELECT *, {_TOK.format("(" + _RENDER.format("user_text", "assistant_text") + ")")} AS n FROM merged WHERE NOT starts_with(trim(user_text), 'Your task is to create a detailed summary')),
long AS (SELECT *, string_split(assistant_text, chr(10)) AS ps, CASE WHEN 600 - {_TOK.format("(" + _PREFIX + ")")} >= 100 THEN 600 - {_TOK.format("(" + _PREFIX + ")")} ELSE 600 END AS most FROM sized WHERE n > 600),
{_walk_sql("long", "conv_id, turn_number, user_text")},
chunks AS (
  SELECT conv_id, turn_number, 0::BIGINT AS part, user_text AS said, assistant_text AS answer, {_RENDER.format("user_text", "assistant_text")} AS whole FROM sized WHERE n <= 600 AND (n >= 150 OR trim(user_text) <> '')
  UNION ALL SELECT conv_id, turn_number, part, user_text, piece, {_RENDER.format("user_text", "piece")} FROM cut
),
texts AS (SELECT conv_id, string_agg(concat_ws(chr(10) || chr(10), CASE WHEN said <> '' THEN 'User: ' || said END, CASE WHEN answer <> '' THEN 'Assistant: ' || answer END), chr(10) || chr(10) ORDER BY turn_number, part) AS t FROM chunks GROUP BY conv_id)"""


@query(f"{CHUNKS_SQL} SELECT conv_id, turn_number, part, {_TOK.format('whole')} AS token_estimate, md5(whole) AS text_md5 FROM chunks")
def create_chunks(spark, d):
    made = turns.create_chunks(_turns(spark, d), "conv_id", sep="\n")
    return turns.number_chunks(made, "conv_id").select("conv_id", "turn_number", "part", "token_estimate", F.md5("combined_text").alias("text_md5"))


@query(f"WITH RECURSIVE docs AS (SELECT doc_id, string_split(text, chr(10)) AS ps, 150 AS most FROM documents), {_walk_sql('docs', 'doc_id')} SELECT doc_id, part, md5(piece) AS text_md5 FROM cut")
def paragraph_split(spark, d):
    cut = turns.split_texts(load(spark, d, "documents"), "doc_id", most=150, sep="\n")
    return cut.select("doc_id", "part", F.md5("piece").alias("text_md5"))


@query(f"{CHUNKS_SQL}, s AS (SELECT conv_id, CASE WHEN length(t) > 3000 THEN substr(t, 1, 2000) || chr(10) || chr(10) || '{turns.OMITTED}' || chr(10) || chr(10) || right(t, 1000) ELSE t END AS t FROM texts) SELECT conv_id, length(t) AS n, md5(t) AS text_md5 FROM s")
def session_text_head_tail(spark, d):
    made = turns.create_chunks(_turns(spark, d), "conv_id", sep="\n")
    return turns.session_text(made, "conv_id", 3000, 2000, 1000).select("conv_id", F.length("session_text").alias("n"), F.md5("session_text").alias("text_md5"))


@query(f"{CHUNKS_SQL} SELECT conv_id, substr(list_filter(string_split(regexp_replace(t, '^User: ', ''), chr(10)), lambda x: trim(x) <> '')[1], 1, 120) AS summary FROM texts WHERE length(t) BETWEEN 100 AND 12000")
def summaries(spark, d):
    made = turns.create_chunks(_turns(spark, d), "conv_id", sep="\n")
    return hooks.summarise(turns.session_text(made, "conv_id"), key="conv_id")


@query("SELECT doc_id AS chunk_id, 384 AS dim FROM documents")
def embedded_chunks(spark, d):
    return hooks.embed(chunks(spark, d)).select("chunk_id", F.size("embedding").alias("dim"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS f FROM documents), c AS (SELECT doc_id, f, substr(f, 1, 80) AS c FROM s),
p AS (SELECT *, CASE WHEN contains(c, '. ') THEN length(c) - instr(reverse(c), ' .') - 1 ELSE -1 END AS dot, CASE WHEN contains(c, ' ') THEN length(c) - instr(reverse(c), ' ') ELSE -1 END AS sp FROM c)
SELECT doc_id, CASE WHEN length(f) <= 80 THEN f WHEN dot > 48 THEN substr(c, 1, dot + 1) WHEN sp > 64 THEN substr(c, 1, sp) || '...' ELSE c || '...' END AS short FROM p""")
def truncate_text(spark, d):
    return load(spark, d, "documents").select("doc_id", x.truncate(F.col("text"), 80).alias("short"))


@query(f"""WITH {LIVES_SQL}, m AS (SELECT session_id, CAST(floor(epoch(last_message_at::TIMESTAMP - first_message_at::TIMESTAMP) / 60) AS BIGINT) AS n FROM lives)
SELECT session_id, CASE WHEN n < 1 THEN '<1min' WHEN n < 60 THEN n::VARCHAR || 'min' WHEN n % 60 = 0 THEN (n // 60)::VARCHAR || 'h' ELSE (n // 60)::VARCHAR || 'h' || (n % 60)::VARCHAR || 'm' END AS duration FROM m""")
def format_duration(spark, d):
    return lives(spark, d).select("session_id", x.format_duration(F.col("first_message_at"), F.col("last_message_at")).alias("duration"))


@query(f"WITH {LIVES_SQL} SELECT session_id, substr(last_message_at, 1, 10) || ' ' || substr(last_message_at, 12, 5) AS shown FROM lives")
def format_time(spark, d):
    return lives(spark, d).select("session_id", x.format_time(F.col("last_message_at")).alias("shown"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n::VARCHAR || 'B' WHEN n < 1048576 THEN (n // 1024)::VARCHAR || 'KB' ELSE (n // 1048576)::VARCHAR || 'MB' END AS size FROM (SELECT doc_id, n_chars * 300 AS n FROM documents)")
def format_size(spark, d):
    return load(spark, d, "documents").select("doc_id", x.format_size(F.col("n_chars") * 300).alias("size"))


@query(f"WITH {LIVES_SQL} SELECT session_id FROM lives WHERE last_message_at >= '2024-01-01T12:00:00'")
def relative_date(spark, d):
    from datetime import datetime

    since = x.parse_date("2w", datetime(2024, 1, 15, 12))
    return filters.session_filter(lives(spark, d), since=since)


@query("SELECT page_id, split_part(url, '/', -1) AS name FROM pages")
def basename(spark, d):
    return load(spark, d, "pages").select("page_id", x.basename(F.col("url")).alias("name"))


@query(r"SELECT page_id, lower(nullif(regexp_extract(url, '^https?://[^/]+/(.+?)(?:\.git)?$', 1), '')) AS remote FROM pages")
def git_remote(spark, d):
    return load(spark, d, "pages").select("page_id", x.git_remote(F.col("url")).alias("remote"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return load(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY user_id")
def ordered_distinct(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.array_join(in_order(F.col("event_type"), "event_id"), ",").alias("kinds"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS n FROM events")
def reindex_count_600s(spark, d):
    whole = load(spark, d, "events").withColumn("second", F.timestamp_seconds(F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")))
    return indexing.reindexes(whole, "user_id", "second").select("user_id", "event_id", F.col("recent").alias("n"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def queue_dedup(spark, d):
    return indexing.first_in_batch(load(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id")


_COOLDOWN_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (
  SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS indexed, []::DOUBLE[] AS seen FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, i, event_id, ok, CASE WHEN ok THEN list_append(recent, t) ELSE recent END FROM (
    SELECT *, len(recent) = 0 OR t - recent[len(recent)] >= CASE WHEN len(recent) >= 3 THEN 300 ELSE 60 END AS ok FROM (
      SELECT e.user_id, e.i, e.event_id, e.t, list_filter(f.seen, lambda x: e.t - x <= 600) AS recent FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
)
SELECT user_id, event_id, indexed FROM f WHERE i > 0"""


@query(_COOLDOWN_SQL)
def cooldown_batch(spark, d):
    return indexing.cooldown_batch(load(spark, d, "events"), "user_id", "ts", "event_id")


def _stream(spark, d, columns: list[str]):
    """The events as a stream of one file."""
    static = load(spark, d, "events")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d).select(*columns)


def _drained(spark, stream, mode: str = "append"):
    """What a stream yields when it has read all there is."""
    from threadwell.operators.storage import scratch

    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(_COOLDOWN_SQL)
def queue_stream(spark, d):
    return _drained(spark, indexing.cooldown_stream(_stream(spark, d, ["user_id", "event_id", "ts"]), "user_id", "ts", "event_id"))


@query("SELECT user_id AS session_id, event_id AS seq, n AS message_count FROM (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS n FROM events) WHERE n > 0) WHERE n IS DISTINCT FROM before")
def change_detection_stream(spark, d):
    files = _stream(spark, d, ["user_id", "event_id", "ts", "value"]).select(F.col("user_id").alias("session_id"), F.col("ts").cast("string").alias("mtime"), F.col("event_id").alias("size"), F.floor("value").cast("long").alias("message_count"), F.col("event_id").alias("seq"))
    return _drained(spark, indexing.change_stream(files))


@query(r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS l FROM documents),
c AS (SELECT doc_id, unnest(l) AS c, unnest(range(len(l))) AS i FROM l),
e AS (SELECT doc_id, i, CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
  WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c)) ELSE printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END AS x FROM c)
SELECT d.doc_id, md5('["' || coalesce(string_agg(x, '' ORDER BY i), '') || '"]') AS json_md5 FROM documents d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id""")
def ascii_json_texts(spark, d):
    """Every whole text as a list of one, as it is searched for names of files."""
    return load(spark, d, "documents").select("doc_id", F.md5(x.ascii_json(F.array("text")).cast("binary")).alias("json_md5"))
