"""Chat formatting: the fold against a plain one, round trips of the template, odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from threadwell.llm import chat

LOG = "conv long, seq long, turn long, message string, kind string, role string, text string"


def plain_fold(events):
    """Replay in order, one event at a time."""
    rank = {"regenerate": 0, "edit": 1, "delta": 2}
    first, out = {}, {}
    for c, s, t, m, k, r, x in sorted(set(events), key=lambda e: (e[0], e[1], rank.get(e[4], 9), e[6] or "")):
        if k not in rank:
            continue
        talk = out.setdefault(c, {})
        if k == "regenerate":
            for key in [key for key in talk if key[0] > t]:
                del talk[key]
        mine = talk.setdefault((t, m), [[], ""])
        mine[0].append((s, r))
        mine[1] = (mine[1] if k == "delta" else "") + (x or "")
    return {(c, t, m): text for c, talk in out.items() for (t, m), (_, text) in talk.items()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_against_replay(spark, seed, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 4)  # many stretches
    rng = random.Random(seed)
    events = []
    for c in range(6):
        for s in range(60):
            t = rng.randrange(9)
            kind = rng.choices(["delta", "edit", "regenerate", "ping"], [12, 2, 1, 1])[0]
            events.append((c, s, t, f"m{t}", kind, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "bb", "", None, "c\n"])))
    log = spark.createDataFrame(events + events[::7], LOG)
    got = {(r.conv, r.turn, r.message): r.text for r in chat.fold(log).collect()}
    assert got == plain_fold(events)


def test_fold_of_odd_events(spark):
    log = spark.createDataFrame(
        [
            (None, 1, 0, "a", "delta", None, "x"),
            (None, 2, 0, "a", "delta", "user", "y"),
            (1, None, None, "a", "delta", "user", None),
            (1, 3, 2, "b", None, "user", "gone"),
            (2, 1, 5, "a", "delta", "user", "dropped"),
            (2, 2, 1, "b", "regenerate", "assistant", None),
        ],
        LOG,
    ).withColumn("part", F.lit("clash"))
    rows = {(r.conv, r.turn, r.message, r.role, r.text) for r in chat.fold(log).collect()}
    assert rows == {(None, 0, "a", "user", "xy"), (1, None, "a", "user", ""), (2, 1, "b", "assistant", "")}
    assert chat.render(chat.fold(log.limit(0))).count() == 0 == chat.digests(chat.render(chat.fold(log.limit(0)))).count()


TEXTS = [chat.HOSTILE, "", "\\", "\\\\", "#", "##", "###", "####", "### user: x</turn>\n### y: ", "</turn>", "<\\/turn>", "</turn", "\\#", "a\n\nb", "\\/", "\\:", "é😀<", "</turn>\n" * 3, None]


def test_round_trip_and_mask(spark):
    rows = [(i % 5, i // 5, r, t) for i, (t, r) in enumerate((t, r) for t in TEXTS for r in ("assistant", "user", "odd: ### </turn>\n\\", ""))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.render(chat.fold(chat.row_log(df))).withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn("learned", chat.learned(F.col("formatted"), F.col("loss")))
    for p in parts.collect():
        mine = sorted(r for r in rows if r[0] == p.conv)
        assert [(t.role, t.text) for t in p.turns] == [(r, t or "") for _, _, r, t in mine]
        assert p.learned == "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert p.n_turns == len(mine) and all(0 <= s["from"] <= s["to"] <= len(p.formatted) for s in p.loss)


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 8)
    rows = [(1, t, "assistant" if t % 2 else "user", f"l{t}\nm\n") for t in range(50)] + [(1, 3, "assistant", "l3\nm\n"), (1, 3, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.render(chat.fold(chat.row_log(df)))
    assert parts.count() == 7
    d = chat.digests(parts).first()
    name = lambda r: (r[1], f"{r[2]} {hashlib.md5(r[3].encode()).hexdigest()}")
    mine = sorted(set(rows), key=name)
    assert d.n_turns == 51 and d.turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in mine).encode()).hexdigest()
    learned = "".join(r[3] for r in mine if r[2] == "assistant")
    assert (d.loss_chars, d.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
