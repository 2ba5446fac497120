"""The written text index: phrases, crashes between any two writes, merges, and blocks that are passed over."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from threadwell.functions.text import contains_like, like
from threadwell.operators import filters, retrieval, storage, text_index
from threadwell.operators.text_index import TextIndex, TrigramIndex, crowded, pattern_trigrams, query_units

SCHEMA = "chunk_id long, session_id string, combined_text string"


def test_units_of_a_query():
    assert query_units('skill-doc-type "the of" x_y the,of') == [("skill", "doc", "type"), ("the", "of"), ("x", "y"), ("the",), ("of",)]
    assert query_units('a "a" ""  "--" !!! sh/demo') == [("a",), ("sh",), ("demo",)]
    assert query_units('open "quote') == [("open",), ("quote",)] and query_units("Éclair-Ünder") == [("eclair", "under")]


def plain(docs, units, least):
    """rank of each document, by counting at every place."""
    words = {k: t.split() for k, t in docs.items()}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    tf = {k: [sum(tuple(w[i : i + len(u)]) == u for i in range(len(w))) for u in units] for k, w in words.items()}
    out, idf = {}, []
    for j in range(len(units)):
        df = sum(tf[k][j] > 0 for k in docs)
        raw = math.log((n - df + 0.5) / (df + 0.5))
        idf.append(raw if raw > 0 else 1e-6)
    for k, w in words.items():
        if sum(x > 0 for x in tf[k]) >= least:
            out[k] = -round(sum(i * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(w) / mean)) for i, x in zip(idf, tf[k], strict=True)), 9)
    return out


def ranks(df):
    return {r.chunk_id: round(r["rank"], 9) for r in df.collect()}


@pytest.mark.parametrize(("query", "match"), [('"a b"', "any"), ("a-a", "any"), ('"a a a"', "any"), ('b "a b" c', "any"), ('"a b" c', "all"), ('"b zz"', "any"), ('"a b a" "c d"', "all")])
def test_phrases(spark, tmp_path, monkeypatch, query, match):
    monkeypatch.setattr(text_index, "BLOCK", 4)
    rng = random.Random(5)
    docs = {i: " ".join(rng.choice("aabcd") for _ in range(rng.randint(1, 30))) for i in range(40)}
    df = spark.createDataFrame([(i, f"s{i % 5}", t) for i, t in docs.items()], SCHEMA)
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=3).build(df)
    units = query_units(query)
    least = len(units) if match == "all" else 1
    want = {k: r for k, r in plain(docs, units, least).items() if r}
    assert ranks(index.search(query, None, match)) == want
    best = sorted((r, k) for k, r in want.items())[:5]
    assert [(round(r["rank"], 9), r.chunk_id) for r in index.search(query, 5, match).collect()] == best


def test_a_crash_between_any_two_writes(spark, tmp_path, monkeypatch):
    """The index of before is there whole, whichever write fails, and the next try succeeds."""
    old = spark.createDataFrame([(1, "s", "red fox"), (2, "t", "fox den")], SCHEMA)
    new = spark.createDataFrame([(3, "s", "blue fox")], SCHEMA)
    save, put = TextIndex._save, storage.put_text
    for fails_at in range(1, 9):
        root = str(tmp_path / f"ix{fails_at}")
        TextIndex(spark, root, buckets=2).build(old)
        left = [fails_at]

        def once(f, left=left):
            def g(*a, **kw):
                left[0] -= 1
                if left[0] == 0:
                    raise RuntimeError("lost")
                return f(*a, **kw)

            return g

        monkeypatch.setattr(TextIndex, "_save", once(save))
        monkeypatch.setattr(storage, "put_text", once(put))
        try:
            TextIndex(spark, root, buckets=2).update(new)
            done = True
        except RuntimeError:
            done = False
        monkeypatch.setattr(TextIndex, "_save", save)
        monkeypatch.setattr(storage, "put_text", put)
        index = TextIndex(spark, root, buckets=2)
        found = lambda index: {r.chunk_id for r in index.search("fox", None).collect()}
        if done:
            assert found(index) == {2, 3} and left[0] > 0
            break
        assert found(index) == {1, 2}
        index.update(new)
        assert found(TextIndex(spark, root, buckets=2)) == {2, 3}
        index.sweep(keep=1)
        assert len(storage.names(spark, f"{root}/segments")) == len(index.segments()) == 2
    assert done and fails_at > 4  # docs, postings, dead, lost and the manifest were each lost once


def test_updates_and_merges(spark, tmp_path, monkeypatch):
    """Ten updates, some of sessions that were there before: ranks are those of a scan of what is live."""
    monkeypatch.setattr(text_index, "BLOCK", 3)
    rng = random.Random(2)
    index, live = TextIndex(spark, str(tmp_path / "ix"), buckets=2), {}
    for step in range(10):
        session = f"s{rng.randrange(5)}"
        rows = [(step * 10 + j, session, " ".join(rng.choice(["fox", "den", "red", "the"]) for _ in range(rng.randint(0, 6)))) for j in range(rng.randint(1, 4))]
        live[session] = rows
        index.update(spark.createDataFrame(rows, SCHEMA))
        assert len(index.segments()) <= 6
    now = spark.createDataFrame([r for rows in live.values() for r in rows], SCHEMA)
    for query in ("fox", "the red den"):
        assert ranks(TextIndex(spark, index.root, buckets=2).search(query, None)) == ranks(retrieval.bm25(now, query, None, "chunk_id", "combined_text"))
        assert ranks(index.search(query, 3)) == ranks(retrieval.bm25(now, query, 3, "chunk_id", "combined_text"))
    allowed = spark.createDataFrame([("s1",), ("s3",), ("none",)], "session_id string")
    own = now.join(allowed, "session_id", "left_semi")
    assert ranks(index.search("the fox", None, allowed=allowed, own_figures=True)) == ranks(retrieval.bm25(own, "the fox", None, "chunk_id", "combined_text"))
    assert ranks(index.merge().search("the fox", None)) == ranks(retrieval.bm25(now, "the fox", None, "chunk_id", "combined_text")) and len(index.segments()) == 1
    assert ranks(index.search('"the fox"', None)).keys() == {r.chunk_id for r in now.filter(F.col("combined_text").contains("the fox")).collect()}


def test_segments_stay_few():
    """200 updates of one document each, and of mixed sizes: tiers keep the number of segments logarithmic."""
    for sizes in ([1] * 200, [1 + i * 7 % 50 for i in range(200)]):
        have, most, written = [1000], 0, 0
        for n in sizes:
            have.append(n)
            while (some := crowded(have)) is not None:
                whole = sum(have[i] for i in some)
                have = [n for i, n in enumerate(have) if i not in some] + [whole]
                written += whole
            most = max(most, len(have))
        assert most <= 16 and written <= 8 * (1000 + sum(sizes))
    assert crowded([]) is None and crowded([1, 1, 1]) is None and crowded([0, 1, 2, 3]) == [0, 1, 2, 3]


def test_blocks_are_passed_over(spark, tmp_path, monkeypatch):
    """A common term, mostly once in long documents: blocks of those are not opened, and the ranks are the same."""
    monkeypatch.setattr(text_index, "BLOCK", 4)
    rng = random.Random(9)
    docs = [(i, f"s{i % 7}", " ".join(["fox"] * (1 + (i % 50 == 0) * 3) + [rng.choice(["x", "y", "z"]) for _ in range(rng.randint(3, 60))])) for i in range(400)] + [(1000 + i, "t", "x y z") for i in range(500)]
    df = spark.createDataFrame(docs, SCHEMA)
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=2).build(df)
    for query, match in (("fox", "any"), ("fox x", "any"), ("fox x y", "all")):
        got = [(r.chunk_id, round(r["rank"], 9)) for r in index.search(query, 5, match).collect()]
        assert got == [(r.chunk_id, round(r["rank"], 9)) for r in retrieval.bm25(df, query, 5, "chunk_id", "combined_text", match).collect()]
    opened, there = index.opened("fox", 5)
    assert there >= 100 and opened < there / 2


def test_grep_by_trigrams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 3)
    rng = random.Random(4)
    made = ["".join(rng.choice("aAbÉé_%\\\n😀") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = [(i, f"s{i % 4}", t) for i, t in enumerate([*made, None, "", "ab"])]
    first = spark.createDataFrame([(i, s, "aaaa bbbb") for i, s, _ in docs], SCHEMA)
    df = spark.createDataFrame(docs, SCHEMA)
    index = TrigramIndex(spark, str(tmp_path / "ix"), buckets=2).build(first)
    for i in range(4):  # all sessions are replaced
        index.update(df.filter(F.col("session_id") == f"s{i}"))
    assert len(index.segments()) <= 6
    for part in ("aab", "ABA", "éba", "ÉÉ", "a_b%bA", "%", "__", "\\a", "😀a", "a\nb", "b%a%b%aab", "zzz", " ", "aaaa bbbb"):
        want = sorted((r.chunk_id for r in filters.grep(df, part, None).collect()), reverse=True)
        assert [r.chunk_id for r in index.grep(part, 100).collect()] == want, part
        assert [r.chunk_id for r in index.grep(part, 2).collect()] == want[:2]
    assert pattern_trigrams("abCd_ef%ghi") == ["abc", "bcd", "ghi"] and pattern_trigrams("a_b%") == []
    found = index.candidates("aab")
    assert found is None or found.count() < 63


def moved(spark, folder):
    """Bytes shuffled and spilled, and the largest share of memory of a task, of the stages that ran after `folder` = None."""
    gateway = spark.sparkContext._gateway
    found = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    stages = [found.apply(i) for i in range(found.size())]
    return {s.stageId(): (s.shuffleWriteBytes(), s.memoryBytesSpilled(), s.peakExecutionMemory()) for s in stages if folder is None or s.stageId() not in folder}


def test_words_are_not_shuffled(spark, tmp_path):
    """What a build and a merge shuffle is at most the texts and small figures, for words and for trigrams alike."""
    rng = random.Random(1)
    docs = [(i, f"s{i % 9}", " ".join(f"{rng.randrange(1 << 40):x}" for _ in range(200))) for i in range(600)]
    size = sum(len(t) for _, _, t in docs)
    df = spark.createDataFrame(docs, SCHEMA)
    for kind in (TextIndex, TrigramIndex):
        seen = moved(spark, None)
        index = kind(spark, str(tmp_path / kind.__name__), buckets=3).build(df)
        assert sum(s for s, _, _ in moved(spark, seen).values()) < 1.1 * size
        index.update(df.filter("session_id in ('s1', 's2')"))
        seen = moved(spark, None)
        assert len(index.merge().segments()) == 1
        assert sum(s for s, _, _ in moved(spark, seen).values()) < 0.1 * size


def test_places_of_a_phrase_are_no_rows(spark, tmp_path):
    """A text that says a phrase 200,000 times: a search holds its places in arrays."""
    df = spark.createDataFrame([(1, "s", "a b " * 200_000), (2, "s", "b a"), (3, "t", "a c b")], SCHEMA)
    index = TextIndex(spark, str(tmp_path / "ix"), buckets=3).build(df)
    seen = moved(spark, None)
    assert {r.chunk_id: r.tf for r in index.hits('"a b"').collect()} == {1: 200_000}
    assert {r.chunk_id: r.tf for r in index.hits('"a b a"').collect()} == {1: 199_999}
    assert index.hits('"a a"').count() == 0
    assert max(m for _, _, m in moved(spark, seen).values()) < 50_000_000


def test_stretches_between_wildcards(spark):
    """A stretch is looked for once, after the one before it; characters of regular expressions stand for themselves."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab.*\\E^😀É\n_%") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for part in ("a%b", "A_%.%b", "\\E%*", "^%a%b", "😀%_É", "%a%", "b%\n", "a%%b"):
        want = df.filter(like(F.col("t"), f"%{part}%")).collect()
        assert df.filter(contains_like(F.col("t"), part)).collect() == want, part
    slow = spark.createDataFrame([("ab" * 20_000,)], "t string")
    begun = time.time()
    assert slow.filter(contains_like(F.col("t"), "ab%ab%abc")).count() == 0  # by LIKE each place of the first is tried with each of the second
    assert time.time() - begun < 20
