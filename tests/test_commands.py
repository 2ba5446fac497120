"""The commands over a store of hand-written transcripts, and the written text index."""

import json
import time

import pytest
from pyspark.sql import functions as F

from threadwell import commands
from threadwell.functions import hooks
from threadwell.operators import dml, retrieval, storage
from threadwell.operators.text_index import TextIndex
from threadwell.sources import transcripts


def line(kind, text, at, session, **more):
    return json.dumps({"type": kind, "sessionId": session, "timestamp": f"2024-03-0{at}T10:00:00Z", "message": {"content": text}, **more})


def write(root, project, session, rows):
    folder = root / project
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{session}.jsonl").write_text("\n".join(rows) + "\n")


@pytest.fixture
def logs(tmp_path):
    root = tmp_path / "logs"
    long = " ".join(f"word{i}" for i in range(180))
    edit = [{"type": "text", "text": f"The parser was mended. {long}"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "/w/app/parser.py"}}]
    write(root, "-w-app", "aaa111", [line("user", "please mend the parser", 1, "aaa111", slug="mend"), line("assistant", edit, 1, "aaa111", requestId="r1"), line("user", "thanks, and the lexer? " + long, 2, "aaa111"), line("assistant", f"The lexer is fine. {long}", 2, "aaa111", requestId="r2")])
    write(root, "-w-app", "aaa222", [line("user", "deploy failed: permission denied " + long, 3, "aaa222", gitBranch="main"), line("assistant", f"Give the role more rights. {long}", 4, "aaa222")])
    write(root, "-w-web", "bbb333", ["", "{broken", line("user", "why is the page slow " + long, 5, "bbb333"), line("assistant", f"Images are large. {long}", 5, "bbb333")])
    sub = root / "-w-app" / "aaa111" / "subagents"
    sub.mkdir(parents=True)
    (sub / "agent-c0ffee.jsonl").write_text("\n".join([line("user", "look for bugs", 1, "x"), line("assistant", "one bug", 1, "x"), line("assistant", "another", 1, "x")]))
    (sub / "agent-c0ffee.meta.json").write_text(json.dumps({"agentType": "finder", "description": "bugs"}))
    return root


@pytest.fixture
def store(spark, tmp_path):
    return commands.Store(spark, str(tmp_path / "store"), buckets=4)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_commands(spark, store, logs):
    assert rows(commands.stats(store), "sessions", "chunks", "embedded") == [(0, 0, 0)]
    scan = lambda: transcripts.scan(spark, str(logs))
    first = commands.init(store, scan(), subagents=transcripts.subagents(spark, str(logs)))
    got = first.first()
    assert got.sessions == 3 and got.chunks == got.embedded >= 4

    hits = commands.search_command(store, "permission denied")
    assert hits.first().session_id == "aaa222" and {"project_path", "topic_summary", "message_count"} <= set(hits.columns)
    assert rows(commands.search_command(store, "PERMISSION den", grep=True), "session_id", "score") == [("aaa222", 1.0)]
    assert rows(commands.search_command(store, "parser.py", grep=True, file=True), "session_id", "chunk_id") == [("aaa111", 0)]  # file goes first
    assert {r[0] for r in rows(commands.search_command(store, "the", project="/w/web"), "session_id")} == {"bbb333"}
    assert {r[0] for r in rows(commands.search_command(store, "the", before="2024-03-02", expand=lambda q: [("lex", "lexer"), ("vec", "parser"), ("odd", "x")], rerank=hooks.overlap_scorer("the parser")), "session_id")} == {"aaa111"}
    logged = spark.read.json(store.path("search_log")).collect()
    assert len(logged) == 5 and {r.mode for r in logged} == {"hybrid", "grep", "file"}
    assert {h.project for r in logged for h in r.hits} == {"app", "web"}
    assert commands.resume_command(store, "slow page").first().session_id == "bbb333"

    assert rows(commands.resolve(store, "aaa"), "session_id", "verdict") and {r[1] for r in rows(commands.resolve(store, "aaa"), "session_id", "verdict")} == {"ambiguous"}
    session, chunks, subs = commands.show(store, "aaa1", turn=0, around=0)
    assert session.first().subagents == 1 and [r.matched for r in chunks.collect()] == [True] and subs.first().agent_type == "finder"
    assert all(df.count() == 0 for df in commands.show(store, "aaa")) and commands.show(store, "zzz")[0].count() == 0
    assert commands.recover(store, "aaa111", 1).count() == 1 and commands.recover(store, "aaa111").count() >= 2
    assert rows(commands.list_subagents(store, "aaa111"), "agent_id") == [("c0ffee",)]
    logs_of = transcripts.scan(spark, str(logs), "*/*/subagents/agent-*.jsonl")
    assert rows(commands.subagent(store, "aaa111", "C0F", logs_of), "turn_number", "user_content", "assistant_content") == [(0, "look for bugs", "one bug"), (1, "", "another")]
    assert commands.subagent(store, "aaa111", "nope", logs_of).count() == 0

    assert commands.summarise(store).count() == 1  # of over two messages
    summary = commands.search_command(store, "parser", grep=True).first().topic_summary
    assert summary

    # one session grows; another's file is as it was
    write(logs, "-w-app", "aaa111", [line("user", "all new zebra text " + "x" * 700, 6, "aaa111"), line("assistant", "ok " + "y" * 700, 6, "aaa111")])
    assert rows(commands.full_scan(store, scan()), "session_id") == [("aaa111",)]
    assert commands.full_scan(store, scan()).count() == 0
    assert ("aaa111",) in rows(commands.search_command(store, "zebra"), "session_id")
    assert commands.search_command(store, "lexer", grep=True).count() == 0
    assert rows(commands.search_command(store, "zebra", grep=True), "topic_summary") == [(summary,)]
    left = commands.stats(store).first()
    assert left.embedded < left.chunks
    again = commands.reembed(store).first()
    assert again.embedded == again.chunks and again.sessions == 3


def test_daemon_reads_a_queue(spark, store, logs, tmp_path):
    queue = tmp_path / "queue"
    queue.mkdir()
    path = f"file:{logs}/-w-app/aaa222.jsonl"
    (queue / "1.txt").write_text(f"{path}\n\n{path}\n")
    lines = transcripts.scan(spark, str(logs))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    scan = lambda paths: lines.withColumn("bare", bare("path")).join(paths.select(bare("path").alias("bare")), "bare", "left_semi").drop("bare")
    running = commands.daemon(store, str(queue), scan, str(tmp_path / "state"), once=True)
    running.awaitTermination()
    assert rows(store.read("sessions"), "session_id") == [("aaa222",)]
    assert rows(commands.stats(store), "chunks", "embedded") == [(1, 1)]


def test_daemon_cools_down_and_embeds_beside(spark, store, logs, tmp_path):
    queue = tmp_path / "queue"
    queue.mkdir()
    calls = []

    def scan(paths):
        calls.append(sorted(r.path for r in paths.collect()))
        return transcripts.scan(spark, str(logs)).filter(F.col("session_id").isin([p.split("/")[-1].removesuffix(".jsonl") for p in calls[-1]]))

    def broken(texts):
        raise ValueError("no model")

    good, store.embedder = store.embedder, broken
    path = f"{logs}/-w-app/aaa222.jsonl"
    (queue / "1.txt").write_text(f"{path}\n{path}\n{logs}/-w-app/aaa111/subagents/agent-c0ffee.jsonl\n/elsewhere/p/s.jsonl\n")
    running = commands.daemon(store, str(queue), scan, str(tmp_path / "state"), root=str(logs), embed_seconds=1, cooldown=5, busy_cooldown=9, window=15)

    def until(what):
        end = time.time() + 120
        while not what() and time.time() < end:
            time.sleep(0.5)
        assert what(), (calls, running.indexing.exception())

    try:
        until(lambda: store.read("sessions").count() == 1 and not running.embedding.isActive)  # the encoder fails, indexing has not
        assert running.indexing.isActive and calls == [[path]]
        (queue / "2.txt").write_text(f"{path}\n")
        (queue / "3.txt").write_text(f"{path}\n")
        until(lambda: len(calls) == 2)  # the waiting path, once
        time.sleep(3)
        assert calls == [[path]] * 2
    finally:
        running.stop()
    store.embedder = good
    commands.embed(store)
    assert rows(commands.stats(store), "sessions", "chunks", "embedded") == [(1, 1, 1)]


def test_index_counts_as_a_whole_or_not_at_all(spark, store, logs, monkeypatch):
    """The driver is lost between the writes of tables, index and manifest; readers keep to what they began with."""
    commands.index(store, transcripts.scan(spark, str(logs)).filter("session_id = 'aaa222'"))
    commands.embed(store)

    def seen(at):
        found = at.index.search("permission zebra", None).select("chunk_id").collect()
        return rows(commands.stats(at), "sessions", "chunks", "embedded"), sorted(r[0] for r in found), sorted(r[0] for r in rows(at.read("chunks"), "combined_text"))

    before, was = store.pin(), seen(store)
    write(logs, "-w-app", "aaa222", [line("user", "zebra " + "x" * 700, 6, "aaa222"), line("assistant", "ok " + "y" * 700, 6, "aaa222")])
    again = lambda **kw: commands.index(store, transcripts.scan(spark, str(logs)).filter("session_id = 'aaa222'"), force=True, **kw)
    put = storage.put_text
    for failing in (f"{store.root}/text_index/manifests", f"{store.root}/manifests"):

        def lost(spark, path, text, failing=failing):
            if path.startswith(failing):
                raise OSError("lost")
            put(spark, path, text)

        with monkeypatch.context() as m:
            m.setattr(storage, "put_text", lost)
            with pytest.raises(OSError, match="lost"):
                again(wipe=failing.endswith("text_index/manifests"))
        assert seen(store) == was
    again()
    now = seen(store)
    assert now[0] == [(1, 1, 0)] and len(now[1]) == 1 and "zebra" in now[2][0]
    assert seen(before) == was


def test_subagents_are_read_from_files_where_none_are_stored(spark, store, logs):
    commands.index(store, transcripts.scan(spark, str(logs)))
    assert commands.list_subagents(store, "aaa111").count() == 0
    found = lambda me: transcripts.subagents(spark, str(logs)).filter(F.col("parent_session_id") == me)
    assert rows(commands.list_subagents(store, "aaa111", found), "agent_id", "message_count") == [("c0ffee", 3)]
    assert rows(commands.list_subagents(store, "aaa111"), "agent_id") == [("c0ffee",)]


def test_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"s{i % 3}", t) for i, t in enumerate(["alpha beta", "alpha alpha gamma", "Beta, gamma!", None, "", "delta élan", "alpha"])], "chunk_id long, session_id string, combined_text string")
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=4).build(docs)

    def same(now, query, **kw):
        want = {r.chunk_id: round(r["rank"], 9) for r in retrieval.bm25(now, query, None, "chunk_id", "combined_text", kw.get("match", "any")).collect()}
        assert {r.chunk_id: round(r["rank"], 9) for r in index.search(query, None, **kw).collect()} == want

    for q in ("alpha", "beta gamma", "elan", "nothing", "", "...", "alpha nothing"):
        same(docs, q)
        same(docs, q, match="all")
    new = spark.createDataFrame([(1, "s1", "omega"), (9, "s1", "alpha omega")], docs.schema)
    index.update(new)
    now = docs.filter("session_id <> 's1'").unionByName(new)
    for q in ("alpha omega", "gamma delta"):
        same(now, q)
    index.update(new.limit(0), new.select("session_id"))  # a session goes
    now = docs.filter("session_id <> 's1'")
    same(now, "alpha beta omega")
    assert index.segments() == [0, 1, 2] and index.merge().segments() == [0]
    same(now, "alpha beta omega")
    allowed = spark.createDataFrame([("s0",)], "session_id string")
    assert {r.chunk_id for r in index.search("alpha", allowed=allowed).collect()} == {0, 6}


def test_replacing_the_last_session_of_a_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, n int")
    dml.replace_sessions(df, path, buckets=2)
    dml.replace_sessions(df.limit(0), path, changed=df, buckets=2)
    assert spark.read.schema("session_id string, n int").parquet(path).count() == 0
    dml.replace_sessions(df, path, changed=df, buckets=2)
    assert sorted(rows(spark.read.parquet(path), "session_id", "n")) == [("a", 1), ("b", 2)]
