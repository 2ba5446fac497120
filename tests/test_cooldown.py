"""The cooldown by the clock: waiting paths go on by a timer, and sessions that fall silent are forgotten."""

import time

from threadwell.streaming import indexing


def test_waiting_paths_go_on_and_state_shrinks(spark, tmp_path):
    queue, out = tmp_path / "queue", []
    queue.mkdir()
    (queue / "1.txt").write_text("a /p/a1\na /p/a2\nb /p/b1\n")
    paths = spark.readStream.text(str(queue)).selectExpr("split(value, ' ')[0] AS session_id", "split(value, ' ')[1] AS path")

    def take(batch, _):
        out.extend((r.session_id, r.path, r.at) for r in batch.collect())

    with indexing.keyed_state(spark):
        query = indexing.index_stream(indexing.cooled(paths, cooldown=4, busy_cooldown=8, window=12), take, str(tmp_path / "state"), seconds=1)

    def until(what, seconds):
        end = time.time() + seconds
        while not what() and time.time() < end and query.isActive:
            time.sleep(0.3)
        assert what(), (out, query.exception())

    try:
        until(lambda: len(out) == 2, 90)
        assert sorted(r[:2] for r in out) == [("a", "/p/a2"), ("b", "/p/b1")]  # of a batch the last
        (queue / "2.txt").write_text("a /p/a3\na /p/a4\n")
        until(lambda: len(out) == 3, 60)
        gone = {r[1]: r[2] for r in out}
        assert out[2][:2] == ("a", "/p/a4") and gone["/p/a4"] - gone["/p/a2"] >= 4
        rows = lambda: sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
        until(lambda: rows() == 0, 60)
        assert len(out) == 3
    finally:
        query.stop()
