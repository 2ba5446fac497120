"""Operators on document texts against brute force, with nulls, blanks, ties, repeats, empty tables and odd columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from threadwell.llm import common, decontamination, hmm, jaccard, licences, lines, pieces, sharding, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, seq int, place int, shard string, key string"


def word_list(text):
    return [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdef"), 3)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = prose(rng, 120)
    family = [" ".join(w if rng.random() > 0.01 else "changed" for w in base.split()) for _ in range(12)]
    lines_ = ["First line of a block here.", "Second line of it.", "Third line.", "", "Other words stand alone " + prose(rng, 4)]
    block = "\n".join(lines_[:3])
    texts = [None, "", " \n\t ", base, base, *family, prose(rng, 3), "One", "one", "two words", f"{prose(rng, 9)}\n{block}\n{prose(rng, 7)}", f"{block}\n\n{prose(rng, 5)}", "a\na\na\na", block]
    texts += [prose(rng, int(n)) for n in rng.integers(1, 60, 20)] + [prose(rng, 5000), "é" * 900, "x" * 1500 + "é" + "x" * 900, "Ünï — ▁cödé\x00 \U0001f600 tab\tend"]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[3], (None, texts[3]), (None, "null id, own words here now")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "en" if (i or 0) % 2 else None, None if (i or 0) % 5 == 0 else "src", len(t or ""), 1, 0.5, 2, 3, "s", "k") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_match_words(rows):
    texts = [t for _, t in rows]
    seen = {}
    for lo, hi, data, offsets in common.text_chunks(pa.array(texts, pa.string()), limit=1000):
        h, owner, starts, ends = common.words(data, offsets)
        for i in range(hi - lo):
            got = [int(x) for x in h[owner == i]]
            want = word_list(texts[lo + i])
            assert len(got) == len(want)
            for a, b in zip(got, want, strict=True):
                assert seen.setdefault(a, b) == b
    assert len(seen) == len({w for t in texts for w in word_list(t)})


def shingle_set(text, k):
    w = word_list(text)
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(docs, rows, empty, k, num):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, num, 100).collect())
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for a, (i, s) in enumerate(sets):
        if i is not None:
            least[find(a)].append(i)
    want = collections.Counter((i, len(s), min(least[find(a)], default=None) if s else i) for a, (i, s) in enumerate(sets))
    assert got == want
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.keep_first(docs, k, num, 100)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(i for (i, _, c), n in want.items() for _ in range(n) if i is not None and i == c)


def test_large_family_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = prose(rng, 200).split()
    texts = []
    for _ in range(300):
        w = list(base)
        w[int(rng.integers(0, 200))] = prose(rng, 1) + "zz"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_components(docs, 4, 85, 100).collect()} == {0}


def brute_lines(rows, m=2):
    first, out, tables = {}, {}, {}
    order = sorted({(i if i is not None else 1 << 62, t or "") for i, t in rows})
    for key in order:
        tables[key] = [(p, x) for p, x in enumerate(key[1].split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        for k in range(len(tables[key]) - m + 1):
            first.setdefault(tuple(x for _, x in tables[key][k : k + m]), (key, k))
    for key in order:
        gone = set()
        for k in range(len(tables[key]) - m + 1):
            if first[tuple(x for _, x in tables[key][k : k + m])] != (key, k):
                gone |= {tables[key][k + j][0] for j in range(m)}
        out[key] = "\n".join(x for p, x in enumerate(key[1].split("\n")) if p not in gone), len(gone), len(tables[key])
    return out


@pytest.mark.parametrize("m", [2, 3, 4])
def test_line_dedup(docs, rows, empty, m):
    want = brute_lines(rows, m)
    got = lines.deduplicate(docs, m, keep_emptied=True)
    assert [c for c in got.columns if c in docs.columns] == docs.columns
    for r in got.collect():
        raw = [t for i, t in rows if i == r.doc_id]
        options = [want[(r.doc_id if r.doc_id is not None else 1 << 62, t or "")] for t in raw]
        assert (r.text or "", r.n_removed, r.n_lines) in options
    assert got.count() == len(rows)
    assert got.filter("text is null").count() == sum(t is None for _, t in rows)
    assert lines.deduplicate(empty).count() == 0


def test_line_dedup_of_long_copies(spark):
    rng = np.random.default_rng(8)
    long = [prose(rng, 3) for _ in range(70)]
    rows = [(1, "\n".join(long)), (2, "\n".join(["new"] + long[3:60] + ["end"])), (3, "\n".join(long[:1] + long[20:22] * 3)), (4, "\n".join(long))]
    want = brute_lines(rows)
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), keep_emptied=True).collect()}
    assert got == {i: want[(i, t)][:2] for i, t in rows}
    assert 4 not in {r.doc_id for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def brute_cut(rows, n):
    data = [(t or "").encode() for _, t in rows]
    count = collections.Counter(t[a : a + n] for t in data for a in range(len(t) - n + 1))
    out = []
    for (i, _), t in zip(rows, data, strict=True):
        cover = [False] * len(t)
        for a in range(len(t) - n + 1):
            if count[t[a : a + n]] > 1:
                cover[a : a + n] = [True] * n
        kept = bytes(x for x, c in zip(t, cover, strict=True) if not c)
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("n", [400, 60])
def test_repeated_substrings(docs, rows, empty, n):
    got = substrings.remove_repeats(docs, n)
    found = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert found == brute_cut(rows, n)
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 5])
def test_repeated_substrings_of_hot_heads(spark, monkeypatch, hot):
    """Near copies of one passage at many places, split by bands."""
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = np.random.default_rng(14)
    base = prose(rng, 60)
    texts = [base, base * 2]
    for _ in range(40):
        a, w = int(rng.integers(0, 60)), list(base[: int(rng.integers(100, len(base)))])
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = "Z"
        texts.append(prose(rng, 3) + "".join(w)[a:] + prose(rng, 2))
    rows = list(enumerate(texts))
    for n in (48, 100):
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n)
        found = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
        assert found == brute_cut(rows, n)


def cut_of(df):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, with_text=False).collect())


def test_repeats_in_runs_of_different_sizes(spark):
    """Two places whose hashes agree in their first 43 bits: a short text and one of over 1 MB must choose the same."""
    rng = np.random.default_rng(1)
    first, second = "sngx qiwnfvimnaqwotw kcm", "dgwyfkvcdlst hquvgqhebjh"
    text = (prose(rng, 8)[:30] + first + prose(rng, 8)[:30] + second + prose(rng, 120))[:400]
    rows = [(1, text), (2, text + " " + " ".join(f"{i:06d}" for i in range(155000)))]
    got = cut_of(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(x[:4] for x in got) == [(1, 400, 400, 1), (2, len(rows[1][1]), 400, 1)]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_repeats_in_texts_of_one_id_and_checksum(spark, doc_id):
    """Rows that share an id and a crc32: only the one whose text repeats is cut."""
    assert zlib.crc32(b"vcfgfgpx") == zlib.crc32(b"fcnlycbw")
    rest = prose(np.random.default_rng(9), 120)[:392]
    rows = [(doc_id, "vcfgfgpx" + rest), (doc_id, "fcnlycbw" + rest), (3, "vcfgfgpx" + rest + " and more")]
    assert cut_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute_cut(rows, 400)


def test_repeats_in_broken_utf8(spark):
    rest = prose(np.random.default_rng(9), 120)[:400].encode()
    rows = [(1, b"\xff\xfe" + rest), (2, rest + b"\xc3"), (3, b"\xe9")]
    got = cut_of(spark.createDataFrame(rows, "doc_id long, text binary").withColumn("text", F.col("text").cast("string")))
    kept = [b"\xff\xfe", b"\xc3", b"\xe9"]
    assert got == collections.Counter((i, len(t), len(t) - len(k), int(len(t) > 400), hashlib.sha256(k).hexdigest()) for (i, t), k in zip(rows, kept, strict=True))


def test_loser_tree_merges_front_coded_runs():
    rng = np.random.default_rng(1)
    for n_runs in (1, 2, 3, 7):
        items = [bytes(rng.integers(97, 99, int(rng.integers(1, 12))).astype(np.uint8)) for _ in range(200)]
        runs = [sorted((x, b"", 0, 0, 1) for x in items[i::n_runs]) for i in range(n_runs)]
        merged = list(substrings.merge_runs([substrings.front_code(r) for r in runs]))
        assert [m[1] for m in merged] == sorted(items)
        for a, b in zip(merged, merged[1:], strict=False):
            assert b[0] == substrings.common_prefix(a[1], b[1], 0)


def test_language_model(docs, rows, empty):
    got = hmm.score_held_out(docs).collect()
    known = [(i, t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for _, t in known for w in [*word_list(t), None])
    n, v = sum(count.values()), len(count)
    want = {}
    for i, t in rows:
        w = [*word_list(t), None]
        want[i, len(w)] = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), sum(count[x] > 0 for x in w)
    assert len(got) == len(rows)
    for r in got:
        base, seen = want[r.doc_id, r.n_tokens]
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.n_known, r.train_tokens) == (seen, n)
        assert r.score < 0
    assert hmm.score_held_out(empty).count() == 0
    bare = hmm.score(docs, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in bare)


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(2)
    k, s = 3, 5
    model = hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T)
    sym, first = rng.integers(0, s, 9).astype(np.int32), np.array([0, 4, 5, 9])
    got = hmm.forward(model, sym, first)
    for d in range(3):
        seq, total = sym[first[d] : first[d + 1]], 0.0
        for path in np.ndindex(*[k] * len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, x in zip(path, path[1:], seq[1:], strict=False):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert math.isclose(got[d], math.log10(total), rel_tol=1e-12)


def test_decontamination(spark, docs, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    texts = [
        (1, f"before {item.upper()} after"),
        (2, " ".join(["x", *w[6:], "y", *w[:6]])),  # reordered
        (3, " ".join(w[:6])),  # half
        (4, " ".join(reversed(w))),
        (5, "a short\tone here"),
        (6, None),
        (7, " ".join(w[:5] + ["gap"] + w[5:10] + ["gap"])),  # 10 of 12 words
    ]
    found = decontamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench)
    got = {(r.doc_id, r.item_id): (r.n_tiles, r.covered) for r in found.collect()}
    assert got == {(1, 1): (1, 12), (2, 1): (2, 12), (5, 2): (1, 2), (7, 1): (2, 10)}
    left = decontamination.clean(spark.createDataFrame(texts, "doc_id long, text string"), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 6]
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == docs.count()


def test_tiles_take_the_longest_first():
    assert sorted(decontamination.greedy_tiles([1, 2, 3, 4, 5, 6], [4, 5, 6, 9, 1, 2, 3, 4], 2)) == [(0, 4, 4), (4, 1, 2)]


def test_licences(spark, docs, empty):
    mit = licences.TEMPLATES["MIT"][2]
    w = mit.split(" ")
    texts = [
        (1, "Some prose.\nReleased under the MIT License.\nMore of the same."),
        (2, "\n".join(" ".join(w[a : a + 12]) for a in range(0, len(w), 12))),  # over many lines
        (3, "the of the to the of software is"),
        (4, None),
        (5, ""),
        (6, "LICENSED under the apache license version 2 0\n" * 2),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.licence) for r in licences.scan(df).collect())
    assert got == {(1, "MIT"): 1, (2, "MIT"): 1, (6, "Apache-2.0"): 2}
    assert licences.scan(empty).count() == 0
    assert licences.scan(docs).count() == 0


def test_licence_windows_match_brute_force():
    rng = np.random.default_rng(6)
    templates = {"a": ("p q r s t u",), "b": ("p q r", "x y z p q")}
    m = licences.Matcher(templates, 0.8)
    hits = 0
    for _ in range(400):
        rows = [" ".join(rng.choice(list("pqrstuxyz"), int(rng.integers(0, 7)))) for _ in range(4)]
        if rng.random() < 0.5:
            rows[2] = "z " + str(rng.choice(["p q r s t u", "p q r", "x y z p q", "q r s t u", "p q s t u"])) + " p"
        w = " ".join(rows).split()
        best = max((licences.dice(licences.bigrams(w[a:b]), licences.bigrams(t.split())) for a in range(len(w)) for b in range(a + 2, len(w) + 1) for ts in templates.values() for t in ts), default=0)
        found = m.scan("\n".join(rows))
        hits += bool(found)
        assert bool(found) == (best >= 0.8)
        assert not found or math.isclose(max(f[1] for f in found), best)
    assert 50 < hits < 350


def test_licences_inside_of_lines(spark):
    texts = [
        (1, "Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0. All else is as it was."),
        (2, "x " * 300 + licences.TEMPLATES["AGPL-3.0"][0] + " y" * 300 + " " + licences.TEMPLATES["GPL-3.0"][1]),
        (3, licences.TEMPLATES["BSD-2-Clause"][0] + "\n\n" + licences.TEMPLATES["BSD-3-Clause"][0]),
    ]
    got = [(r.doc_id, r.licence) for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, "Apache-2.0"), (2, "AGPL-3.0"), (2, "GPL-3.0"), (3, "BSD-2-Clause"), (3, "BSD-3-Clause")]


def test_pieces_round_trip_and_best_score(docs, rows, empty):
    with open(pieces.MODEL, "rb") as f:
        coder = pieces.Pieces(f.read())

    def brute(unit):
        best = [0.0] + [-math.inf] * len(unit)
        index = {coder.pieces[i]: s for i, s in coder.scores.items()}
        for end in range(1, len(unit) + 1):
            best[end] = best[end - 1] + coder.fallback
            for a in range(end):
                if unit[a:end] in index:
                    best[end] = max(best[end], best[a] + index[unit[a:end]])
        return best[-1]

    for unit in ("▁hello", "▁▁▁word", "unbelievable", "é☃x", "▁", "aaaaaaa", "▁Straße—ok"):
        ids = coder.viterbi(unit)
        score, k = 0.0, 0
        while k < len(ids):
            if ids[k] in coder.scores:
                score, k = score + coder.scores[ids[k]], k + 1
            else:
                lead = coder.byte_ids.index(ids[k])
                score, k = score + coder.fallback, k + (1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4)
        assert math.isclose(score, brute(unit))
    out = pieces.encode(docs)
    assert {r.round_trip for r in out.collect()} == {True} and out.count() == len(rows)
    back = collections.Counter((r.doc_id, r.text) for r in pieces.decode(out).collect())
    assert back == collections.Counter((i, (t or "").replace("▁", " ")) for i, t in rows)
    assert pieces.encode(empty).count() == 0


def test_pieces_are_those_of_the_library(rows):
    """A model of merges: ids equal the library's own, for prose, repeated letters, odd characters and noise."""
    with open(pieces.MODEL, "rb") as f:
        proto = f.read()
    coder, library = pieces.Pieces(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    assert coder.by_merges
    rng = np.random.default_rng(17)
    texts = [t or "" for _, t in rows] + ["a" * n for n in range(1, 40)] + ["  two  spaces ", " lead", "trail ", "Unbelievable internationalisation, naïve façade; 12345 67.8%", "日本語 текст \U0001f600é"]
    for letters in ("ab", "thein ", "aeiounrst  ", "xyzzyXYZ .,-"):
        texts += ["".join(rng.choice(list(letters), int(rng.integers(1, 60)))) for _ in range(300)]
    for t in texts:
        t = t.replace("\x00", "")
        assert coder.encode(t).tolist() == library.encode(t), t


def test_shards(docs, rows, empty):
    got = sharding.hilbert_shards(docs, 7)
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.shard].append(r.slot)
    counts = [len(v) for v in by.values()]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got.collect()) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sharding.shard_ranges(got).count() == 7
    assert sharding.hilbert_shards(empty).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_hilbert_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = sharding.hilbert_index([cells[:, i] for i in range(dims)], bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_block_max_index_is_exact():
    rng = np.random.default_rng(9)
    vectors = []
    for _ in range(300):
        v = {int(t): float(w) for t, w in zip(rng.choice(40, 5, replace=False), rng.random(5) + 0.1, strict=True)}
        norm = math.sqrt(sum(w * w for w in v.values()))
        vectors.append({t: w / norm for t, w in v.items()})
    index = toxicity.BlockMaxIndex(vectors, block=16)
    for q in vectors[:50]:
        full = sorted(((sum(w * v.get(t, 0) for t, w in q.items()), i) for i, v in enumerate(vectors)), key=lambda x: (-round(x[0], 12), x[1]))
        want = [x for x in full[:10] if x[0] > 0]
        got = index.top(q, 10)
        assert [i for _, i in got] == [i for _, i in want]
        assert np.allclose([s for s, _ in got], [s for s, _ in want])


def test_toxicity(spark, docs, empty, rows):
    rng = np.random.default_rng(10)
    bad = ["grumble", "snarlish", "vilecry"]
    texts, marks = [], []
    for i in range(400):
        w = prose(rng, 30).split()
        toxic = i % 4 == 0
        if toxic:
            w += list(rng.choice(bad, 3))
        texts.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    labelled = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None), (9999, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(labelled, labels)
    got = {r.doc_id: r for r in toxicity.score(labelled, model).withColumn("held_out", toxicity.held_out()).collect()}
    for i, toxic in marks:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == toxic and 0 <= got[i].score <= 1
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(rows) and {r.predicted for r in odd} == {0}
    assert toxicity.clean(docs, model).columns == docs.columns and toxicity.clean(docs, model).count() == len(rows)
    assert toxicity.score(empty, model).count() == 0
    unlabelled = toxicity.fit(labelled, labels.limit(0))
    assert {r.predicted for r in toxicity.score(labelled, unlabelled).collect()} == {0}


def test_folds(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in df.withColumn("f", common.fold("doc_id", 5)).collect())
