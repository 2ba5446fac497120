"""Ingest, turns, retrieval, filters, upserts and streams on hand-made cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from threadwell.functions import hooks
from threadwell.functions import text as x
from threadwell.operators import dml, filters, retrieval, search, turns
from threadwell.sources import transcripts
from threadwell.streaming import indexing


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    folder = top / "-home-me-proj"
    agents = folder / "s1" / "subagents"
    agents.mkdir(parents=True)
    tool = lambda name, **kw: {"type": "tool_use", "name": name, "input": kw}
    lines = [
        {"type": "user", "sessionId": None, "slug": None, "gitBranch": "", "timestamp": "2024-01-01T00:00:02Z", "message": {"content": "hello"}},
        "",
        "{broken",
        "[1, 2]",
        {"type": "system", "sessionId": "zz", "message": {"content": "no"}},
        {"type": "assistant", "sessionId": "real", "slug": "", "gitBranch": "main", "cwd": "/w", "timestamp": "2024-01-01T00:00:03Z", "requestId": "r1", "message": {"content": [{"type": "text", "text": "abc"}, "plain", {"type": "thinking", "text": "hm"}]}},
        {"type": "assistant", "slug": "late", "timestamp": "2024-01-01T00:00:04Z", "requestId": "r1", "message": {"content": [{"type": "text", "text": "a longer answer"}, tool("Read", file_path="/a/b.py"), tool("Bash", command=" ls -l "), tool("Grep", pattern="p" * 40, path="/src"), tool("Task", description="look around"), tool("Read", file_path="/x/.claude/y"), tool("Odd"), tool("Read", file_path="/c/b.py")]}},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:01Z", "requestId": "r1", "message": {"content": [{"type": "text", "text": "a longer answer"}]}},
        {"type": "user", "timestamp": None, "message": {"content": None}},
    ]
    (folder / "s1.jsonl").write_text("\n".join(v if isinstance(v, str) else json.dumps(v) for v in lines))
    (agents / "agent-a1.jsonl").write_text("\n".join(json.dumps(v) for v in [{"type": "user", "timestamp": "2024-01-02", "message": {"content": "q" * 600}}, {"type": "assistant", "timestamp": "2024-01-01", "message": {"content": "r"}}]))
    (agents / "agent-a1.meta.json").write_text(json.dumps({"agentType": "finder", "description": "d"}))
    (agents / "agent-a2.jsonl").write_text("{}")
    return str(top)


def test_transcripts(spark, root):
    msgs = transcripts.messages(transcripts.scan(spark, root)).cache()
    assert [(r.line_no, r.type, r.text) for r in msgs.orderBy("line_no").collect()] == [(0, "user", "hello"), (5, "assistant", "abc\nplain"), (6, "assistant", "a longer answer"), (7, "assistant", "a longer answer"), (8, "user", "")]
    tools = msgs.filter("line_no = 6").first().tools
    assert tools == "[Tools: Read b.py, Bash: ls, Grep " + "p" * 30 + ", Task: look around, Read y, Odd]"
    s = transcripts.sessions(msgs).first()
    assert (s.session_id, s.stored_id, s.slug, s.git_branch, s.cwd, s.project_path) == ("s1", "real", "", "main", "/w", "/home/me/proj")
    assert (s.first_message_at, s.last_message_at, s.message_count) == ("2024-01-01T00:00:01Z", "2024-01-01T00:00:04Z", 5)
    assert (s.files_touched, s.tools_used, s.commands_run) == (["/a/b.py", "/c/b.py", "/src"], ["Bash", "Grep", "Odd", "Read", "Task"], [" ls -l "])
    kept = transcripts.dedup_stream(msgs).orderBy("seq").collect()
    assert [r.line_no for r in kept] == [8, 0, 6]


def test_subagents_and_paths(spark, root):
    got = {r.agent_id: r for r in transcripts.subagents(spark, root).collect()}
    a = got["a1"]
    assert (a.parent_session_id, a.agent_type, a.message_count, a.first_message_at, a.last_message_at, len(a.first_prompt)) == ("s1", "finder", 2, "2024-01-02", "2024-01-01", 500)
    assert got["a2"].message_count == 0 and got["a2"].agent_type is None
    paths = spark.createDataFrame([("/r/p-q/s.jsonl",), ("/r/s.jsonl",), ("/r/p/s/subagents/agent-1.jsonl",), ("/o/p/s.jsonl",), ("/r/p/s.txt",)], "path string")
    assert [(r.session_id, r.project_path) for r in transcripts.resolve_paths(paths, "/r").collect()] == [("s", "p/q")]


def test_turns(spark):
    rows = [(1, 0, "assistant", "lost"), (1, 1, "user", " hi "), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (1, 4, "user", ""), (1, 5, "assistant", "x" * 99), (1, 6, "user", " "), (1, 7, "assistant", "y" * 100)]
    msgs = spark.createDataFrame(rows, "s long, n int, role string, text string")
    got = turns.collect_turns(msgs, "s", "n").orderBy("turn_number").collect()
    assert [(r.turn_number, r.user_text, r.assistant_text) for r in got] == [(0, "hi", "a\nb"), (1, "", "y" * 100)]
    pairs = turns.pair_turns(msgs.filter("n < 5"), "s", "n").orderBy("turn_number").collect()
    assert [(r.user_text, r.assistant_text) for r in pairs] == [("", "lost"), (" hi ", "a"), ("", "b"), ("", "")]


def turn(user, assistant, tools=""):
    return {"user_text": user, "assistant_text": assistant, "tool_summary": tools, "timestamp": None}


def test_merge_of_tiny_turns():
    words = lambda t: len(t.split())
    frame = words(turns.combine("", "", ""))
    fill = lambda n: " ".join(["w"] * (n - frame))
    shape = lambda ts: [(t["turn_number"], words(turns.combine(t["user_text"], t["assistant_text"], t["tool_summary"]))) for t in turns.merge_tiny(ts, words)]
    assert shape([turn("", fill(199)), turn("", fill(200))]) == [(0, 398)]
    assert shape([turn("", fill(200)), turn("", fill(10))]) == [(0, 200), (1, 10)]
    assert shape([turn("", fill(150)), turn("", fill(451))]) == [(0, 600)]
    assert shape([turn("", fill(150)), turn("", fill(452))]) == [(0, 150), (1, 452)]
    merged = turns.merge_tiny([turn("", "a", "t1"), turn("u", "", "t2")], words)
    assert merged[0]["user_text"] == "u" and merged[0]["assistant_text"] == "a" and merged[0]["tool_summary"] == "t1\nt2"
    assert turns.merge_tiny([]) == []


def test_paragraph_split():
    words = lambda t: len(t.split())
    text = "\n\n".join(["a a a a", "b b", "c c c c", "d"])
    assert turns.split_paragraphs(text, 6, 0.25, count=words) == ["a a a a\n\nb b", "c c c c\n\nd"]
    assert turns.split_paragraphs(text, 6, 0.34, count=words) == ["a a a a\n\nb b", "b b\n\nc c c c", "d"]
    assert turns.split_paragraphs("x " * 50, 5, count=words) == ["x " * 50]
    for part in text.split("\n\n"):
        assert any(part in p for p in turns.split_paragraphs(text, 3, 0.5, count=words))


def test_chunks(spark):
    big = "\n\n".join(" ".join(["word"] * 100) for _ in range(10))
    rows = [(1, 0, "user", turns.TEMPLATES[0] + " and " + "z " * 500), (1, 1, "assistant", "ok"), (1, 2, "user", "q"), (1, 3, "assistant", big)]
    t = turns.collect_turns(spark.createDataFrame(rows, "s long, n int, role string, text string"), "s", "n")
    made = turns.number_chunks(turns.create_chunks(t, "s"), "s").orderBy("part").collect()
    assert {r.turn_number for r in made} == {1} and len(made) > 1 and len({r.chunk_id for r in made}) == len(made)
    assert all(r.token_estimate <= turns.MAX_TOKENS + 1 and r.user_content == "q" for r in made)
    texts = turns.session_text(turns.create_chunks(t, "s"), "s", 2000, 100, 50).first().session_text
    assert len(texts) == 150 + len(turns.OMITTED) + 4
    assert hooks.summarise(turns.session_text(turns.create_chunks(t, "s"), "s"), key="s").count() == 1


@pytest.mark.parametrize(("value", "pattern", "want"), [("axb", "%a_b%", True), ("É", "é", False), ("ABC", "%b%", True), ("a\\b", "%\\%", True), ("100%", "100%", True), ("ab", "%a\\_b%", False)])
def test_like(spark, value, pattern, want):
    assert one(spark, x.like(F.lit(value), pattern)) is want


def test_formats(spark):
    size = lambda n: one(spark, x.format_size(F.lit(n)))
    assert [size(n) for n in (1023, 1024, 1 << 20)] == ["1023B", "1KB", "1MB"]
    span = lambda a, b: one(spark, x.format_duration(F.lit(a), F.lit(b)))
    t = "2024-01-01T10:{:02d}:00Z".format
    assert [span(t(0), t(0)), span(t(5), t(0)), span(t(0), t(59)), span(t(0), "2024-01-01T11:00:00Z"), span(t(0), "2024-01-01T11:01:00Z"), span("bad", t(0))] == ["<1min", "<1min", "59min", "1h", "1h1m", ""]
    remote = lambda u: one(spark, x.git_remote(F.lit(u)))
    assert [remote(u) for u in ("git@h.com:Org/Repo.git", "https://h.com/Org/Repo", "http://h/a/b.git", "ssh://git@h/a")] == ["org/repo", "org/repo", "a/b", None]
    assert one(spark, x.format_time(F.lit("2024-05-06T07:08:09+02:00"))) == "2024-05-06 07:08"
    assert [one(spark, x.format_time(F.lit(v))) for v in ("nope", None, "2024-05-06")] == ["nope", "", "2024-05-06 00:00"]
    short = lambda s: one(spark, x.truncate(F.lit(s), 20))
    assert short("short") == "short"
    assert short("A sentence here. And then more") == "A sentence here."
    assert short("seventeen letters ab cdefgh") == "seventeen letters..." or short("seventeen letters ab cdefgh").endswith("...")
    assert short("x" * 30) == "x" * 20 + "..."
    assert x.parse_date(" 2024-01-02 ") == "2024-01-02T00:00:00+00:00" and x.parse_date("odd") == "odd"


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "skill doc type"), (2, "doc doc Éclair"), (3, "other words"), (4, None), (5, "more")], "doc_id long, text string")
    hits = lambda q, **kw: [r.doc_id for r in retrieval.bm25(docs, q, **kw).collect()]
    assert hits("skill-doc-type") == [1, 2] and hits("skill/doc", match="all") == [1] and hits("eclair") == [2]
    for q in ("", "!!! --", "AND OR NOT"):
        assert hits(q) == []
    ranks = [r.rank for r in retrieval.bm25(docs, "doc").collect()]
    assert all(r <= 0 for r in ranks)
    again = retrieval.bm25_from_postings(retrieval.postings(docs), retrieval.corpus_stats(docs), "doc type")
    assert [(r.doc_id, round(r.rank, 9)) for r in again.collect()] == [(r.doc_id, round(r.rank, 9)) for r in retrieval.bm25(docs, "doc type").collect()]


def test_fusion_and_hybrid(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, pos int")
    b = spark.createDataFrame([(3, 0), (1, 1)], "id long, pos int")
    got = retrieval.reciprocal_rank_fusion([a, b], "id").orderBy(F.desc("score"), "list_no", "pos").collect()
    assert [r.id for r in got] == [1, 3, 2] and abs(got[0].score - (1 / 61 + 1 / 62)) < 1e-12
    chunks = spark.createDataFrame([(1, "s", "red fox"), (2, "s", "fox"), (3, "t", "blue"), (4, "u", "fox den")], "chunk_id long, session_id string, combined_text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [0.8, 0.6])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    out = search.hybrid(chunks, vectors, "fox", q, 10).collect()
    assert sorted(r.session_id for r in out) == ["s", "t", "u"]
    only = spark.createDataFrame([("t",)], "session_id string")
    assert [r.session_id for r in search.hybrid(chunks, vectors, "fox", q, 10, allowed=only, filter_mode="pre").collect()] == ["t"]
    assert [r.chunk_id for r in search.grep_search(chunks, "FOX").collect()] == [4, 2]


def test_session_filters(spark):
    rows = [("a1", "/p/x", "org/r", "main", "2024-01-01", "2024-01-03"), ("a2", "/q/y", "org/r", None, "2024-01-05", "2024-01-06"), ("b", "/p/z", None, "dev", None, None)]
    s = spark.createDataFrame(rows, "session_id string, project_path string, git_remote string, git_branch string, first_message_at string, last_message_at string")
    ids = lambda df: sorted(r.session_id for r in df.collect())
    assert filters.session_filter(s) is None and filters.session_filter(s, project="", since="") is None
    assert ids(filters.session_filter(s, project="/P/X")) == ["a1", "a2"] and ids(filters.session_filter(s, project="/p/")) == ["a1", "a2"]
    assert ids(filters.session_filter(s, project="/p/z")) == ["b"] and ids(filters.session_filter(s, branch="MAI")) == ["a1"]
    assert ids(filters.session_filter(s, since="2024-01-03", before="2024-01-03")) == ["a1"]
    verdict = lambda p: [(r.session_id, r.verdict) for r in filters.resolve_prefix(s, "session_id", p).orderBy("session_id").collect()]
    assert verdict("zz") == [] and verdict("a") == [("a1", "ambiguous"), ("a2", "ambiguous")] and verdict("B") == [("b", "found")] and verdict("a1") == [("a1", "found")]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "sum"), (2, "b", None)], "session_id long, slug string, topic_summary string")
    new = spark.createDataFrame([(2, None), (3, "c")], "session_id long, slug string")
    got = sorted(tuple(r) for r in dml.upsert_sessions(old, new).collect())
    assert got == [(1, "a", "sum"), (2, None, None), (3, "c", None)]
    s = spark.createDataFrame([("x", "/a", None), ("y", "/a", "r"), ("z", "/b", "k")], "session_id string, project_path string, git_remote string")
    after, changed = dml.set_remotes(s, spark.createDataFrame([("/a", "r")], "project_path string, git_remote string"))
    assert changed.first().changed == 1 and {r.session_id: r.git_remote for r in after.collect()} == {"x": "r", "y": "r", "z": "k"}


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "chunks")
    dml.replace_sessions(spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, n long"), path)
    dml.replace_sessions(spark.createDataFrame([("a", 3)], "session_id string, n long"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("session_id", "n").collect()) == [("a", 3), ("b", 2)]


def test_cooldown_rule():
    assert indexing.admit([0, 59, 60, 120, 180, 300, 420, 479, 480], [])[0] == [True, False, True, True, False, False, True, False, False]


def test_streams_match_batches(spark, tmp_path):
    rows = [(i % 3, i, f"2024-01-01 00:{i // 2:02d}:{i % 2 * 30:02d}") for i in range(100)]
    events = spark.createDataFrame(rows, "user long, n long, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = indexing.cooldown_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user", "ts", "n")
    got = []
    indexing.index_stream(stream, lambda df, _: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "state"), once=True).awaitTermination()
    assert sorted(got) == sorted(tuple(r) for r in indexing.cooldown_batch(events, "user", "ts", "n").collect())


def test_change_detection(spark):
    files = spark.createDataFrame([("a", 1, 10, 5), ("b", 2, 20, 5), ("c", 3, 30, 0), ("d", 4, 40, 7)], "session_id string, mtime long, size long, message_count long")
    known = spark.createDataFrame([("a", 1, 10, 4), ("b", 1, 20, 5), ("d", 1, 1, 6)], "session_id string, mtime long, size long, message_count long")
    assert [r.session_id for r in indexing.changed(files, known).collect()] == ["d"]


def test_cross_takes_turns_and_drops_named_files(spark):
    chat = spark.createDataFrame([(0, "see notes.md"), (1, "later other.md")], "pos int, content string")
    research = spark.createDataFrame([(0, "a", "/d/other.md"), (1, "b", "/d/notes.md"), (2, "c", "/d/other.md")], "pos int, content string, source_file string")
    got = [(r.source, r.source_file) for r in search.cross(chat, research).collect()]
    assert got == [("chat", None), ("research", "/d/other.md"), ("chat", None)]


def test_hooks(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "chunk_id long, combined_text string")
    first = hooks.embed(chunks.filter("chunk_id = 1"))
    both = {r.chunk_id: r.embedding for r in hooks.embed_backlog(chunks, first).collect()}
    assert sorted(both) == [1, 2, 3] and abs(sum(v * v for v in both[1]) - 1) < 1e-6 and set(both[2]) == {0.0}
    hits = spark.createDataFrame([(1, "red", "fox"), (2, "x", "y")], "chunk_id long, user_content string, assistant_content string")
    assert {r.chunk_id: r.score for r in hooks.overlap_scorer("Red den")(hits).collect()} == {1: 0.5, 2: 0.0}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_registered_queries_run(spark):
    import __spark_entry__ as e

    known, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(known)
    assert e.entry(spark).count() > 0
    for name in ("fts_any", "hybrid", "cross_antidedup", "merge_tiny_turns", "cooldown_batch", "queue_stream"):
        assert known[name](spark, "/root/testdata/sf0.001").count() > 0
