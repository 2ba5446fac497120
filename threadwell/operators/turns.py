"""Turns and chunks: ordered folds over the messages of a session."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadwell.functions.text import strip
from threadwell.operators.fold import before, ordered_fold

MAX_TOKENS, MIN_TOKENS, MERGE_BELOW, OVERLAP = 600, 150, 200, 0.25
#: Fixed value: how a generated prompt that is no content opens.
TEMPLATES = ("Your task is to create a detailed summary",)


#: Fixed value: what stands for the middle of a long session.
OMITTED = "[...middle of conversation omitted...]"


def count_tokens(text: str) -> int:
    """Default token counter: four characters a token, rounded up."""
    return -(-len(text) // 4)


def collect_turns(msgs: DataFrame, key: str, order: str, kind: str = "role", text: str = "text", tools: str | None = None) -> DataFrame:
    """A turn is a user message and all assistant messages up to the next one; those before the first user are dropped.

    Turns that are empty, or whose user part is blank with under 100 characters of answer, are dropped; turn_number
    counts the rest from 0.
    """
    said = F.when(strip(F.col(text)) != "", F.col(text))
    numbered = msgs.withColumn("_turn", F.sum((F.col(kind) == "user").cast("int")).over(Window.partitionBy(key).orderBy(order))).filter("_turn > 0")
    part = lambda who: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(kind) == who, F.struct(F.col(order).alias("o"), said.alias("t"))))), lambda x: x["t"]), "\n")
    summary = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.nullif(F.col(tools), F.lit("")).isNotNull(), F.struct(F.col(order).alias("o"), F.col(tools).alias("t"))))), lambda x: x["t"]), "\n") if tools else F.lit("")
    first = F.min_by("timestamp", order) if "timestamp" in msgs.columns else F.lit(None).cast("string")
    turns = numbered.groupBy(key, "_turn").agg(strip(part("user")).alias("user_text"), strip(part("assistant")).alias("assistant_text"), summary.alias("tool_summary") if tools else F.first(F.lit("")).alias("tool_summary"), first.alias("timestamp") if "timestamp" in msgs.columns else F.first(F.lit(None).cast("string")).alias("timestamp"))
    empty = (F.col("user_text") == "") & (F.col("assistant_text") == "") & (F.col("tool_summary") == "")
    noise = (F.col("user_text") == "") & (F.length("assistant_text") < 100)
    kept = turns.filter(~empty & ~noise)
    return kept.withColumn("turn_number", F.row_number().over(Window.partitionBy(key).orderBy("_turn")) - 1).drop("_turn")


def pair_turns(msgs: DataFrame, key: str, order: str, kind: str = "role", text: str = "text") -> DataFrame:
    """A user message with the assistant message right after it, if that comes next; other assistants stand alone."""
    w = Window.partitionBy(key).orderBy(order)
    starts = (F.col(kind) == "user") | (F.coalesce(F.lag(kind).over(w), F.lit("assistant")) != "user")
    numbered = msgs.withColumn("_start", starts.cast("int")).withColumn("turn_number", F.sum("_start").over(w) - 1)
    pick = lambda who: F.coalesce(F.max(F.when(F.col(kind) == who, F.col(text))), F.lit(""))
    return numbered.groupBy(key, "turn_number").agg(pick("user").alias("user_text"), pick("assistant").alias("assistant_text"))


def combine(user: str, assistant: str, tools: str) -> str:
    return f"User: {user}\n\nAssistant: {assistant}" + (f"\n{tools}" if tools else "")


def merging(turns: Iterable[dict], count: Callable[[str], int] = count_tokens) -> Iterator[dict]:
    """Join turns under MERGE_BELOW tokens with the next while the joined text stays within MAX_TOKENS. One turn is
    held at a time."""

    def joined(a: str, b: str, by: str) -> str:
        return b if not a else a if not b.strip() else f"{a}{by}{b}"

    def size(t: dict) -> int:
        return count(combine(t["user_text"], t["assistant_text"], t["tool_summary"]))

    pending: dict | None = None
    for i, t in enumerate(turns):
        t = {"turn_number": i, **t}
        tiny = size(t) < MERGE_BELOW
        if pending is None:
            pending, done = (t, []) if tiny else (None, [t])
        else:
            both = {**pending, "user_text": joined(pending["user_text"], t["user_text"], "\n---\n"), "assistant_text": joined(pending["assistant_text"], t["assistant_text"], "\n---\n"), "tool_summary": joined(pending["tool_summary"], t["tool_summary"], "\n")}
            n = size(both)
            if n <= MAX_TOKENS:
                pending, done = (both, []) if n < MERGE_BELOW else (None, [both])
            else:
                pending, done = (t, [pending]) if tiny else (None, [pending, t])
        yield from done
    if pending:
        yield pending


def merge_tiny(turns: list[dict], count: Callable[[str], int] = count_tokens) -> list[dict]:
    """`merging` of a list."""
    return list(merging(turns, count))


def split_paragraphs(text: str, most: int = MAX_TOKENS, overlap: float = OVERLAP, sep: str = "\n\n", count: Callable[[str], int] = count_tokens) -> list[str]:
    """Parts of whole paragraphs within `most` tokens where that is possible, each opening with the end of the last."""
    out: list[str] = []
    parts: list[str] = []
    now = 0
    for paragraph in text.split(sep):
        p = count(paragraph)
        if parts and now + p > most:
            out.append(sep.join(parts))
            room, kept, total = int(now * overlap), [], 0
            for q in reversed(parts):
                n = count(q)
                if total + n > room:
                    break
                kept.insert(0, q)
                total += n
            parts, now = kept, total
        parts.append(paragraph)
        now += p
    return out + ([sep.join(parts)] if parts else [])


def split_texts(df: DataFrame, key: str, text: str = "text", most: int = MAX_TOKENS, overlap: float = OVERLAP, sep: str = "\n\n", count: Callable[[str], int] = count_tokens) -> DataFrame:
    """key, part and piece of each text's parts, as `split_paragraphs` makes them; null texts have none."""
    kind = dict(df.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(k, i, p) for k, t in zip(pdf[key], pdf[text], strict=True) if t is not None for i, p in enumerate(split_paragraphs(t, most, overlap, sep, count))]
            yield pd.DataFrame(rows, columns=[key, "part", "piece"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, part int, piece string")


#: What the folds read of a turn, in this order.
_TURN = ["turn_number", "timestamp", "user_text", "assistant_text", "tool_summary"]


def _fold_turns(turns: DataFrame, key: str, schema: str, build: Callable[[Iterator[dict]], Iterator[tuple]], count: Callable[[str], int]) -> DataFrame:
    """A fold over the ordered turns of each session.

    After a turn of MERGE_BELOW tokens or more nothing is pending, so there a session is cut and its stretches are
    dealt apart; a counter of its own is not known to the plan, so with one a session is a single stretch.
    """
    clean = None
    if count is count_tokens:
        whole = F.concat(F.lit("User: "), "user_text", F.lit("\n\nAssistant: "), "assistant_text", F.when(F.col("tool_summary") != "", F.concat(F.lit("\n"), "tool_summary")).otherwise(""))
        clean = before(F.ceil(F.length(whole) / 4) >= MERGE_BELOW, key, ["turn_number"])
    return ordered_fold(turns.select(key, *_TURN), key, ["turn_number"], lambda rows: build(dict(zip(_TURN, r, strict=True)) for r in rows), schema, clean)


def merged_turns(turns: DataFrame, key: str, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """Turns after the merge of tiny ones."""

    def build(rows: Iterator[dict]) -> Iterator[tuple]:
        for t in merging(rows, count):
            yield tuple(t[c] for c in _TURN)

    return _fold_turns(turns, key, "turn_number long, timestamp string, user_text string, assistant_text string, tool_summary string", build, count)


def create_chunks(turns: DataFrame, key: str, sep: str = "\n\n", count: Callable[[str], int] = count_tokens) -> DataFrame:
    """Chunks of each session: tiny turns merged, templates dropped, turns over MAX_TOKENS split at paragraphs.

    A turn within MAX_TOKENS is dropped if it is under MIN_TOKENS and its user part is blank. All parts of a split
    turn share its number, time and user text.
    """

    def build(rows: Iterator[dict]) -> Iterator[tuple]:
        for t in merging(rows, count):
            user = t["user_text"]
            if user.strip().startswith(TEMPLATES):
                continue
            whole = combine(user, t["assistant_text"], t["tool_summary"])
            n = count(whole)
            if n <= MAX_TOKENS:
                if n >= MIN_TOKENS or user.strip():
                    yield t["turn_number"], 0, t["timestamp"], user, t["assistant_text"], whole, n
                continue
            answer = t["assistant_text"] + (f"\n{t['tool_summary']}" if t["tool_summary"] else "")
            prefix = f"User: {user}\n\n"
            most = MAX_TOKENS - count(prefix)
            prefix += "Assistant: "
            for i, part in enumerate(split_paragraphs(answer, most if most >= 100 else MAX_TOKENS, OVERLAP, sep, count)):
                yield t["turn_number"], i, t["timestamp"], user, part, prefix + part, count(prefix + part)

    return _fold_turns(turns, key, "turn_number long, part int, timestamp string, user_content string, assistant_content string, combined_text string, token_estimate long", build, count)


def number_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """chunks with a stable chunk_id: a hash of session, turn and part, so that re-indexing gives the same ids."""
    return chunks.withColumn("chunk_id", F.xxhash64(key, "turn_number", "part"))


def session_text(chunks: DataFrame, key: str, most: int = 12_000, head: int = 8_000, tail: int = 4_000) -> DataFrame:
    """The conversation of each session as one text; a long one by its head and tail."""
    said = F.array_compact(F.array(F.when(F.coalesce("user_content", F.lit("")) != "", F.concat(F.lit("User: "), "user_content")), F.when(F.coalesce("assistant_content", F.lit("")) != "", F.concat(F.lit("Assistant: "), "assistant_content"))))
    whole = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn_number", "part", said.alias("said")))), lambda x: x["said"])), "\n\n")
    text = F.when(F.length("whole") > most, F.concat(F.substring("whole", 1, head), F.lit(f"\n\n{OMITTED}\n\n"), F.right("whole", F.lit(tail)))).otherwise(F.col("whole"))
    return chunks.groupBy(key).agg(whole.alias("whole")).select(key, text.alias("session_text"))
