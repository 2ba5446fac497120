"""Continuous indexing: a queue of changed sessions, change detection and an adaptive cooldown."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from threadwell.operators.fold import before, ordered_fold

#: Seconds: the cooldown, that of a busy session, the window that makes one busy, and the re-indexes in it.
COOLDOWN, BUSY_COOLDOWN, BUSY_WINDOW, BUSY_COUNT = 60, 300, 600, 3


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """A folder of queue files, a path in each line; blank lines are dropped."""
    return spark.readStream.text(path).select(F.trim("value").alias("path")).filter("path != ''")


def first_in_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: a path queued many times is handled once."""
    return batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def admitting(times: Iterable[float], last: list[float]) -> Iterator[bool]:
    """Whether each of the arrivals (ascending seconds) is indexed, given earlier re-indexes, to which it is added.

    An arrival waits until the cooldown after the last re-index is over: 300 s if there were three in the 600 s
    before, else 60 s.
    """
    for t in times:
        last[:] = [x for x in last if t - x <= BUSY_WINDOW]
        wait = BUSY_COOLDOWN if len(last) >= BUSY_COUNT else COOLDOWN
        ok = not last or t - last[-1] >= wait
        if ok:
            last.append(t)
        yield ok


def admit(times: list[float], last: list[float]) -> tuple[list[bool], list[float]]:
    """`admitting` of a list, and the re-indexes to remember."""
    last = list(last)
    return list(admitting(times, last)), last


def cooldown_batch(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """key, tie and `indexed`, the cooldown's decision, for each event in the order of its key's time. A gap longer than
    the window that makes a session busy clears its state, so there a key is cut and its stretches are spread."""
    kind = dict(events.dtypes)[tie]
    order = ["_at", tie]
    timed = events.select(key, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_at"), tie)

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        """An arrival of the last 600 s at most is held for each re-index."""
        last: list[float] = []
        for at, name in rows:
            yield name, next(admitting([at], last))

    return ordered_fold(timed, key, order, fold, f"`{tie}` {kind}, indexed boolean", F.col("_at") - before("_at", key, order) > BUSY_WINDOW)


def reindexes(events: DataFrame, key: str, ts: str, seconds: int = BUSY_WINDOW) -> DataFrame:
    """events with `recent`, how many of their key fell in the `seconds` up to each, itself included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("recent", F.count("*").over(Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)))


def cooldown_stream(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The same over a stream: the state of a key is its re-indexes of the last 600 s and survives restarts. It stays
    for as long as the stream runs: a few numbers for each session, as in the table of sessions."""
    (kt,), (tt,) = ([t for n, t in events.dtypes if n == c] for c in (key, tie))

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(["_at", tie])
        last = list(state.get[0]) if state.exists else []
        ok, last = admit(pdf["_at"].tolist(), last)
        state.update((last,))
        yield pd.DataFrame({key: pdf[key], tie: pdf[tie], "indexed": ok})

    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    narrow = events.select(key, tie, at.alias("_at"))
    return narrow.groupBy(key).applyInPandasWithState(run, f"{key} {kt}, {tie} {tt}, indexed boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)


class Cooldown(StatefulProcessor):
    """The cooldown by the clock: a session's paths go on at once, or when its cooldown is over, each once.

    State of a session: its re-indexes of the last `window` seconds, and the path that waits. A timer lets the waiting
    path go on, and later forgets the session: after a window without re-indexes nothing of it is left.
    """

    def __init__(self, cooldown: float = COOLDOWN, busy_cooldown: float = BUSY_COOLDOWN, window: float = BUSY_WINDOW, busy_count: int = BUSY_COUNT):
        self.rule = cooldown, busy_cooldown, window, busy_count

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at double")
        self.waiting = handle.getValueState("waiting", "path string")

    def _decide(self, key: tuple, path: str | None, now: float) -> Iterator[pd.DataFrame]:
        """Let the path go on or wait, and set the timer that the session needs next."""
        cooldown, busy_cooldown, window, busy_count = self.rule
        times = sorted(t for (t,) in self.times.get() if now - t < window)
        ready = times[-1] + (busy_cooldown if len(times) >= busy_count else cooldown) if times else now
        if path is not None and now >= ready:
            times.append(now)
            self.waiting.clear()
            yield pd.DataFrame({"session_id": [key[0]], "path": [path], "at": [now]})
        elif path is not None:
            self.waiting.update((path,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.times.put([(t,) for t in times])
            wake = ready if self.waiting.exists() else times[0] + window
            self.handle.registerTimer(int(max(wake, now) * 1000) + 1)
        else:
            self.times.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        path = None
        for part in rows:
            path = part["path"].iloc[-1] if len(part) else path
        yield from self._decide(key, path, timerValues.getCurrentProcessingTimeInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        path = self.waiting.get()[0] if self.waiting.exists() else None
        yield from self._decide(key, path, timerValues.getCurrentProcessingTimeInMs() / 1000)

    def close(self) -> None:
        pass


def cooled(paths: DataFrame, **rule) -> DataFrame:
    """session_id and path of a stream of those, as `Cooldown` lets them through, and when (at, in seconds); needs `keyed_state` where it starts."""
    return paths.select("session_id", "path").groupBy("session_id").transformWithStateInPandas(Cooldown(**rule), "session_id string, path string, at double", "append", "ProcessingTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in the store that lists and timers need; the session's own choice is
    put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (mtime, size) are new and that have messages, in another number than was indexed."""
    old = known.select("session_id", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.col("message_count").alias("_c"))
    same = F.col("mtime").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s"))
    kept = files.join(old, "session_id", "left").filter(~same & (F.col("message_count") > 0) & ~F.col("message_count").eqNullSafe(F.col("_c")))
    return kept.drop("_m", "_s", "_c")


def change_stream(files: DataFrame, tie: str = "seq") -> DataFrame:
    """Rows of a stream of (session_id, mtime, size, message_count, tie) that change the session's count."""
    kinds = dict(files.dtypes)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(tie)
        mark, count = state.get if state.exists else ("", -1)
        keep = []
        for m, s, n in zip(pdf["mtime"], pdf["size"], pdf["message_count"], strict=True):
            now = f"{m}|{s}"
            keep.append(now != mark and n > 0 and n != count)
            if now != mark and n > 0:
                mark, count = now, int(n)
        state.update((mark, count))
        yield pdf[keep][["session_id", tie, "message_count"]]

    narrow = files.select("session_id", "mtime", "size", "message_count", tie)
    schema = f"session_id {kinds['session_id']}, {tie} {kinds[tie]}, message_count {kinds['message_count']}"
    return narrow.groupBy("session_id").applyInPandasWithState(run, schema, "mark string, count long", "append", GroupStateTimeout.NoTimeout)


def index_stream(stream: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 2, once: bool = False):
    """Run index(batch, id) on each micro-batch: at least once, so index must overwrite by session."""
    writer = stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
