"""The ordered fold: state over batches and keys, cuts that change nothing, odd keys."""

import random

import pytest
from pyspark.sql import functions as F

from threadwell.operators import turns
from threadwell.operators.fold import before, ordered_fold
from threadwell.streaming import indexing


def summing():
    """A running sum; made here, so that tasks get it by value."""

    def running(rows):
        total = 0
        for i, n in rows:
            total += n
            yield i, total

    return running


def test_state_runs_over_batches_and_keys(spark):
    running = summing()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(k, i, i % 5 + 1) for k in ("a", "b", None) for i in range(50)]
        random.Random(1).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, i long, n long")
        got = sorted(((r.k or "", r.i, r.total) for r in ordered_fold(df, "k", ["i"], running, "i long, total long").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((k, i, sum(j % 5 + 1 for j in range(i + 1))) for k in ("", "a", "b") for i in range(50))
    assert ordered_fold(df.limit(0), "k", ["i"], running, "i long, total long").count() == 0


def test_only_the_state_is_held(spark):
    """A key of 300,000 rows goes by in one pass: the fold sees an iterator, and may stop early."""
    running = summing()
    df = spark.range(300_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.lit(1).alias("n"))

    def last(rows):
        assert iter(rows) is rows
        for i, total in running(rows):
            if i % 100_000 == 99_999:
                yield i, total

    assert sorted(r.total for r in ordered_fold(df, "k", ["i"], last, "i long, total long").collect()) == [100_000, 200_000, 300_000]
    assert ordered_fold(df, "k", ["i"], lambda rows: [next(rows)], "i long, n int").count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_cuts_change_nothing(spark, seed):
    rng = random.Random(seed)
    at, rows = 0.0, []
    for i in range(400):
        at += rng.choice([1, 30, 61, 200, 700])
        rows.append((i % 2, i, at))
    events = spark.createDataFrame(rows, "k long, i long, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.k, r.i): r.indexed for r in indexing.cooldown_batch(events, "k", "ts", "i").collect()}
    for k in (0, 1):
        mine = [(i, s) for kk, i, s in rows if kk == k]
        ok, _ = indexing.admit([s for _, s in mine], [])
        assert [got[k, i] for i, _ in mine] == ok
    timed = events.select("k", "i", "s")
    far = F.col("s") - before("s", "k", ["i"]) > 600
    sizes = ordered_fold(timed, "k", ["i"], lambda rows: [(sum(1 for _ in rows),)], "n long", far)
    assert sizes.agg(F.sum("n")).first()[0] == 400 and sizes.count() > 2


def test_merge_with_a_counter_of_its_own(spark):
    rng = random.Random(3)
    said = [{"turn_number": i, "timestamp": None, "user_text": "u" * rng.randint(0, 90), "assistant_text": "a " * rng.randint(0, 900), "tool_summary": ""} for i in range(120)]
    df = spark.createDataFrame([(1, *t.values()) for t in said], "s long, turn_number long, timestamp string, user_text string, assistant_text string, tool_summary string")
    words = lambda t: len(t.split())
    for count in (turns.count_tokens, words):
        want = [(t["turn_number"], t["user_text"], t["assistant_text"]) for t in turns.merge_tiny(said, count)]
        assert [(r.turn_number, r.user_text, r.assistant_text) for r in turns.merged_turns(df, "s", count).orderBy("turn_number").collect()] == want


def test_reindexes_in_the_last_seconds(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:10:01"), (2, "2024-01-01 00:10:01")], "k long, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.k, r.recent) for r in indexing.reindexes(df, "k", "t").collect()) == [(1, 1), (1, 2), (1, 2), (2, 1)]
