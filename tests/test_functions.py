"""JSON in ASCII, and byte-pair counts against plain merges."""

import base64
import json
import os

import pytest
import regex
from pyspark.sql import functions as F

from threadwell.functions import text as x
from threadwell.functions.tokens import PATTERN, TokenCounter
from threadwell.operators import filters, turns

LISTS = [["a.py"], [], None, ["é/ü.py", 'q"uo\\te', "tab\there\nand\r\b\f\x01\x7f"], ["😀.md", "a😀b", " ", ""], ["a", None, "b"], ["plain [x] ~ !"]]


def test_ascii_json(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(LISTS)], "i long, files array<string>")
    got = {r.i: r.j for r in df.select("i", x.ascii_json(F.col("files")).alias("j")).collect()}
    assert got == {i: None if v is None else json.dumps(v) for i, v in enumerate(LISTS)}


def test_names_are_found_by_their_escapes(spark):
    rows = [("s1", ["/w/résumé.txt", "/w/b.py"], "2024-01-02"), ("s2", ["/w/😀.md"], "2024-01-01"), ("s3", None, "2024-01-03")]
    df = spark.createDataFrame(rows, "session_id string, files_touched array<string>, last_message_at string")
    ids = lambda q: [r.session_id for r in filters.file_matches(df, q).collect()]
    assert ids("résumé") == [] and ids("r\\u00e9sum\\u00e9") == ["s1"] and ids("R\\U00E9SUM") == ["s1"]
    assert ids("😀") == [] and ids("\\ud83d\\ude00.md") == ["s2"]
    assert ids('.txt", "/w/b') == ["s1"] and ids("/W/") == ["s1", "s2"]


def plain_count(ranks, text):
    """Merge the adjacent pair of lowest rank, time and again."""
    n = 0
    for piece in regex.findall(PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        n += len(parts)
    return n


RANKS, DATA = os.environ.get("TOKEN_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken"), "/root/testdata/sf0.001"


@pytest.mark.skipif(not (os.path.exists(RANKS) and os.path.isdir(DATA)), reason="needs a ranks file and the driver's tables")
def test_byte_pair_counts(spark):
    counter = TokenCounter.of(spark, RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, counter.ranks.splitlines())}
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "text", counter.column("text").alias("n")).collect()
    assert rows and all(r.n == plain_count(ranks, r.text) for r in rows)
    odd = spark.createDataFrame([(None,), ("",), ("<|endoftext|> I'LL été 12345 😀\n\n  x",)], "t string")
    assert [r.n for r in odd.select(counter.column("t").alias("n")).collect()] == [None, 0, plain_count(ranks, "<|endoftext|> I'LL été 12345 😀\n\n  x")]

    msgs = spark.read.parquet(f"{DATA}/conversations.parquet").filter("role <> 'system'")
    said = turns.collect_turns(msgs, "conv_id", "turn")
    made = turns.create_chunks(said, "conv_id", "\n", counter).collect()
    assert made and all(r.token_estimate == counter(r.combined_text) for r in made)
    by = {}
    for t in said.orderBy("turn_number").collect():
        by.setdefault(t.conv_id, []).append({c: t[c] for c in ("turn_number", "timestamp", "user_text", "assistant_text", "tool_summary")})
    want = {(k, t["turn_number"]) for k, ts in by.items() for t in turns.merge_tiny(ts, counter)}
    assert {(r.conv_id, r.turn_number) for r in turns.merged_turns(said, "conv_id", counter).collect()} == want
