"""The pipeline's result against a plain version of its five stages, on a small corpus with planted cases."""

import re

import numpy as np
import sentencepiece

import corpus_pipeline
from threadwell.llm import lines, pieces

BAD = ["grumble", "snarlish", "vilecry"]


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(n))


def corpus(rng):
    items = [prose(rng, 30) for _ in range(4)]
    passage, block = prose(rng, 60), [prose(rng, 8), prose(rng, 9), prose(rng, 7)]
    docs = []
    for i in range(220):
        text = "\n".join(prose(rng, 25) for _ in range(3))
        if i % 5 == 1:
            w = text.split(" ")
            text = " ".join([*w[:10], *rng.choice(BAD, 3), *w[10:]])
        docs.append(text)
    docs[10] = docs[7]  # an exact copy
    docs[12] = docs[12].replace("\n", " ")
    w = docs[12].split(" ")
    docs[13] = " ".join([*w[:4], "changed", *w[5:]])  # near copies, in one line of their own
    docs[14] = " ".join([*w[:6], "other", *w[7:]])
    docs[20], docs[30] = (f"{prose(rng, 12)}\n{passage}\n{prose(rng, 14)}" for _ in range(2))
    docs[22], docs[33] = ("\n".join([prose(rng, 12), *block, prose(rng, 14)]) for _ in range(2))
    docs[40] = f"{prose(rng, 10)} {items[0]} {prose(rng, 10)}"
    cut = items[1].split(" ")
    docs[42] = " ".join([prose(rng, 10), *cut[15:], prose(rng, 5), *cut[:15], prose(rng, 5)])  # reordered
    docs[44] = " ".join([prose(rng, 10), *items[2].split(" ")[:12], prose(rng, 10)])  # too little of it
    docs[50], docs[52], docs[54] = None, "", " \n "
    return docs, items


def plain(docs, items):
    left = {i: t for i, t in enumerate(docs) if t is None or not any(b in t for b in BAD)}
    seen, first = set(), dict(left)
    for i, t in left.items():  # in the order of ids: runs of two lines, and long lines, that stood before go
        if not t:
            continue
        own = [(p, x) for p, x in enumerate(t.split("\n")) if x.strip()]
        units = [(own[k : k + 2], tuple(x for _, x in own[k : k + 2])) for k in range(len(own) - 1)]
        units += [([u], (u[1],)) for u in own if len(u[1].split()) > lines.LONG_WORDS]
        gone = set()
        for places, key in units:
            if key in seen:
                gone |= {p for p, _ in places}
            seen.add(key)
        text = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
        if gone and not text.strip():
            del first[i]
        else:
            first[i] = text
    sets = {}
    for i, t in first.items():
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {i: t for i, t in first.items() if find(i) == i}
    out = {}
    for i, t in kept.items():
        held = False
        for item in items:
            p, w = item.split(), (t or "").split()
            covered, at = 0, 0
            while at < len(p):  # the planted parts are whole stretches: the longest match from each word on is a tile
                n = max((n for n in range(5, len(p) - at + 1) if any(w[j : j + n] == p[at : at + n] for j in range(len(w)))), default=0)
                covered, at = covered + n, at + max(n, 1)
            held |= covered >= 0.8 * len(p)
        if not held:
            out[i] = t
    return out


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    docs, items = corpus(np.random.default_rng(19))
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(bool(t) and bool(re.search("|".join(BAD), t)))) for i, t in enumerate(docs)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain(docs, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    assert not {10, 13, 14, 40, 42} & set(got) and {7, 12, 20, 22, 30, 33, 44, 50, 52, 54} <= set(got)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(list(got[i].token_ids) == library.encode(t or "") and got[i].round_trip for i, t in want.items())
