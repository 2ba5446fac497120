"""Chat formatting from event logs: the events of a conversation are folded, in order, into its final messages, which a
reversible template turns into training text with a loss mask. DataFrame operations only.

A log has conv, seq (the order of events), turn and message (the place and name of the message that an event is about),
kind, role and text. The kinds:

- `delta`: text that is streamed, added to what the message has;
- `edit`: the message's text from here on;
- `regenerate`: the message begins anew with this text, and the messages of later turns are dropped.

Other kinds (null too) are no part of the conversation. No key is trusted to be small: events are folded by stretches
of SPAN sequence numbers, their pieces by stretches of SPAN turns, and what an event needs to know of later stretches
is one number, the lowest turn that is regenerated there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sequence numbers or turns that are held together.
SPAN = 1024
#: Lines of a text that `row_log` streams one by one; the rest comes as one more delta.
LINE_BITS = 20
LINES = 1 << LINE_BITS
#: What opens a turn, ends its role, and closes it.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


def escape(c: Column) -> Column:
    """Text in which neither OPEN nor CLOSE can stand: backslashes are doubled, and one parts what would make either."""
    slashes = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(slashes, F.lit("##"), F.lit("#\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(c: Column) -> Column:
    """`escape`, and no colon ends the role early."""
    return F.replace(escape(c), F.lit(":"), F.lit("\\:"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\#/:])", "$1")


def row_log(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of rows that hold whole messages: an assistant's text is streamed line by line, others come at once.

    Rows of one turn are messages of their own, in the order of role and text digest; a repeated row is the same
    message. Null texts are empty, null turns come first. Other columns go.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(said, "\n", LINES)
    streamed = F.transform(lines, lambda x, i: F.when(i < F.size(lines) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.concat_ws(" ", F.coalesce(role, F.lit("")), F.md5(said.cast("binary"))).alias("message"), F.col(role).alias("role"), F.when(F.col(role) == "assistant", streamed).otherwise(F.array(said)).alias("deltas"))
    each = named.select("conv", "turn", "message", "role", F.posexplode("deltas").alias("line", "text"))
    return each.select("conv", (F.shiftleft(F.coalesce("turn", F.lit(0)), LINE_BITS) + F.col("line")).alias("seq"), "turn", "message", F.lit("delta").alias("kind"), "role", "text")


def _since_last_set(sorted_pieces: Column) -> tuple[Column, Column]:
    """The text of sorted pieces (with `sets` and `text`) from the last one that sets it, and whether any does."""
    places = F.transform(sorted_pieces, lambda p, i: F.when(p["sets"], i + 1).otherwise(0))
    last = F.array_max(places)
    kept = F.slice(sorted_pieces, F.greatest(last, F.lit(1)), F.size(sorted_pieces))
    return F.array_join(F.transform(kept, lambda p: p["text"]), ""), last > 0


def _span(c: str) -> Column:
    """The stretch that a number is in; null stays null."""
    return F.shiftright(F.col(c).cast("long"), SPAN.bit_length() - 1)


def fold(log: DataFrame) -> DataFrame:
    """conv, turn, message, role and text of the final messages of each conversation, with the turn's stretch `part`.

    A message's role is its first that is not null. Events that are wholly equal count once (a log may be delivered
    twice); of events with one seq, regenerations come first, then edits, then deltas, then by text. A null seq is
    first, a null text empty, a null turn before all turns. Messages without an event that counts are left out, so a
    conversation may vanish; an empty log gives no rows. conv may be null, which is a conversation of its own. Other
    columns of the log go.
    """
    order = F.when(F.col("kind") == "regenerate", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "delta", 2)
    known = log.select("conv", F.col("seq").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"), F.col("message").cast("string").alias("message"), order.alias("order"), "role", F.coalesce("text", F.lit("")).alias("text")).filter("order IS NOT NULL")
    placed = known.withColumn("block", _span("seq")).repartition("conv", "block").distinct()
    if not known.filter("order = 0").isEmpty():
        placed = _without_dropped(placed)
    entry = F.struct("seq", "order", "text", (F.col("order") < 2).alias("sets"))
    text, sets = _since_last_set(F.array_sort(F.collect_list(entry)))
    named = F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "order", "role"))).alias("named")
    pieces = placed.groupBy("conv", "block", "turn", "message").agg(named, text.alias("text"), sets.alias("sets"))
    text, _ = _since_last_set(F.array_sort(F.collect_list(F.struct("block", "text", "sets"))))
    dealt = pieces.withColumn("part", _span("turn")).repartition("conv", "part")
    whole = dealt.groupBy("conv", "part", "turn", "message").agg(F.min("named").alias("named"), text.alias("text"))
    return whole.select("conv", "part", "turn", "message", F.coalesce("named.role", F.lit("")).alias("role"), "text")


def _without_dropped(placed: DataFrame) -> DataFrame:
    """Events that no later regeneration of an earlier turn drops.

    Later regenerations in an event's own stretch come from a window over that stretch, those of later stretches by
    their lowest turn, of which a conversation has one number for each stretch.
    """
    turn = F.coalesce("turn", F.lit(-(1 << 63)))
    again = F.when(F.col("order") == 0, turn)
    lows = placed.groupBy("conv", "block").agg(F.min(again).alias("low"))
    later = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.min("low").over(later).alias("beyond"))
    inside = Window.partitionBy("conv", "block").orderBy(F.desc("seq"), F.desc("order"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("within", F.min(again).over(inside)).join(lows, F.col("conv").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    lowest = F.least("within", "beyond")  # least passes over nulls
    return seen.filter(lowest.isNull() | (lowest >= turn)).select(*placed.columns)


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv, part, formatted, loss and n_turns: the text of each stretch of SPAN turns of a conversation.

    loss has the spans (from, to) of `formatted`, in code points, that are to be learned: the escaped texts of the role
    `learn`. A conversation's parts, in order, make up its text; a null part comes first. messages is what `fold` gives.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(COLON))
    made = messages.select("conv", "part", "turn", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    before = Window.partitionBy("conv", "part").orderBy("turn", "message").rowsBetween(Window.unboundedPreceding, -1)
    at = made.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("turn", "message", F.concat("head", "body", F.lit(CLOSE)).alias("text"), (F.col("role") == learn).alias("learn"), F.col("start").alias("from"), (F.col("start") + F.length("body")).alias("to"))
    turns = at.groupBy("conv", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["from"].alias("from"), t["to"].alias("to")))
    return turns.select("conv", "part", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"), spans.alias("loss"), F.size("turns").alias("n_turns"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, in order, unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    head = r"^### ((?:[^\\:]|\\.)*): "
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))


def learned(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["from"].cast("int") + 1, (s["to"] - s["from"]).cast("int")))), "")


def digests(parts: DataFrame) -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from what `render` gives.

    A digest runs over the whole conversation, so here, and only here, a conversation's parts come together.
    """
    turns = F.array_join(F.transform(turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = parts.select("conv", "part", turns.alias("turns"), learned(F.col("formatted"), F.col("loss")).alias("learned"), F.length("formatted").alias("chars"), F.size(turns_of(F.col("formatted"))).alias("n"))
    ordered = read.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "turns", "learned"))).alias("all"), F.sum("chars").alias("formatted_chars"), F.sum("n").alias("n_turns"))
    joined = ordered.select("conv", "n_turns", "formatted_chars", *(F.array_join(F.col(f"all.{c}"), "").alias(c) for c in ("turns", "learned")))
    return joined.select("conv", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


#: A conversation whose texts try to end the template.
HOSTILE = r"\### Assistant: </turn> ok"


def with_hostile(rows: DataFrame) -> DataFrame:
    """conversations and one more, -7, whose two texts are HOSTILE; null texts stay null. Other columns go."""
    more = rows.sparkSession.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)


_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')"

#: Needs no template but for the length of the text; conversations without repeated turns.
ORACLE_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HOSTILE}' UNION ALL SELECT -7, 1, 'assistant', '{HOSTILE}'),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS learned,
  sum(4 + length(replace({_ESCAPED.format('role')}, ':', '\:')) + 2 + length({_ESCAPED.format('text')}) + 8)::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM a
"""
