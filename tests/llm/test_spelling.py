"""Spelling variants: the errata trie against comparing all pairs of words, and the reading of texts."""

import random
import re
import zlib
from collections import Counter

import pytest

from threadwell.llm import spelling
from threadwell.llm.common import saved

WORDS = "word string, n long"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n):
    out = {}
    for w in n:
        near = sorted((v for v in n if one_edit(w, v)), key=lambda v: (-n[v], v))
        form = near[0] if near and n[near[0]] >= 2 * n[w] else None
        out[w] = (form, len(near))
    rows = set()
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n[w], k, n[form] if form else None))
    return rows


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize(("letters", "lengths", "count"), [("ab", (5, 9), 150), ("abcdé", (5, 7), 250), ("aàÿ", (5, 6), 300), ("abc", (1, 4), 80)])
def test_against_all_pairs(spark, letters, lengths, count):
    rng = random.Random(count)
    n = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))): rng.choice([3, 4, 6, 9, 20, 50, 120]) for _ in range(count)}
    words = saved(spark.createDataFrame(list(n.items()), WORDS), "test-words")
    df = spelling.variants(words)
    assert got(df) == plain(n) and df.count() == len(n)


def test_long_chain_of_forms(spark):
    """Words of a chain, each with twice the count of the one before: all lead to the last."""
    chain = ["aaaaaaaaaaaa"[:i] + "bbbbbbbbbbbb"[i:] for i in range(12)]
    n = {w: 3 * 2**i for i, w in enumerate(chain)}
    assert got(spelling.variants(saved(spark.createDataFrame(list(n.items()), WORDS), "test-words"))) == plain(n)


def test_light_edges_halve(spark):
    """A word has at most log2(words) light edges to a character, and one more where it ends."""
    rng = random.Random(1)
    n = {"".join(rng.choice("abcd") for _ in range(rng.randint(5, 12))): 3 for _ in range(500)}
    rows = spelling.light_edges(spark.createDataFrame(list(n.items()), WORDS)).collect()
    each = Counter(r.word for r in rows if r.edge)
    assert max(each.values()) <= 9 and all(r.edge != r.heavy for r in rows)


def test_reading_of_texts(spark):
    texts = [(i, t) for i, t in enumerate(["Zebra zebra, ZEBRA! éclair_Éclair x1yz×÷abc naïve-naïve", None, "", "a" * 5000 + " zebra"] * 60)] + [(None, "zebra crossing")] * 3
    want = Counter()
    for i, t in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    n = {r.word: r.n for r in spelling.vocabulary(spelling.runs(docs)).collect()}
    assert n == {w: c for w, c in want.items() if len(w) >= 5 and c >= 3}
    assert got(spelling.spelling_variants(docs)) == plain(n)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
