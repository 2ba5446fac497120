"""Passages that stand as one line, runs of any length, and columns that clash."""

import numpy as np
import pytest

from threadwell.llm import lines


def passage(rng, n):
    return " ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(n))


def test_later_copies_of_one_long_line_go(spark):
    rng = np.random.default_rng(12)
    long, edge, other = passage(rng, lines.LONG_WORDS + 1), passage(rng, lines.LONG_WORDS), passage(rng, 80)
    rows = [
        (1, f"one\n{long}\ntwo\n{edge}\nthree"),
        (2, f"four\n{long}\nfive\n{edge}\nsix"),
        (3, long),
        (4, f"seven\n{other}\neight\n\n{other}\nnine"),
        (5, f"ten\n{long}\n{other}\neleven"),
        (None, f"twelve\n{long}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in lines.deduplicate(docs).collect()}
    assert got == {
        1: (rows[0][1], 0, 0),
        2: (f"four\nfive\n{edge}\nsix", 1, 1),
        4: (f"seven\n{other}\neight\n\nnine", 1, 1),
        5: ("ten\neleven", 2, 1),
        None: ("twelve", 1, 1),
    }
    assert {r.n_removed for r in lines.deduplicate(docs, 2, keep_emptied=True).collect()} == {0}


def test_a_line_in_both_kinds_of_run_is_removed_once(spark):
    rng = np.random.default_rng(13)
    long = passage(rng, 70)
    rows = [(1, f"a\n{long}\nb"), (2, f"a\n{long}\nb\nc")]
    got = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0, 0), 2: ("c", 3, 1)}


def brute(rows, m):
    """(doc, idx) of the lines in a window of m lines that occurred before, and the longest earlier match from each."""
    order = sorted((i, t.split("\n")) for i, t in rows)
    seen, gone = set(), set()
    for i, t in order:
        for a in range(len(t) - m + 1):
            w = tuple(t[a : a + m])
            if w in seen:
                gone |= {(i, a + j) for j in range(m)}
            seen.add(w)
    return gone


@pytest.mark.parametrize("m", [2, 3, 5, 6, 7])
def test_random_lines_against_brute_force(spark, m):
    rng = np.random.default_rng(m)
    rows = []
    base = ["abcdefgh"[k] for k in rng.integers(0, 8, 60)]
    for i in range(40):
        if i % 2:
            a = int(rng.integers(0, 50))
            t = base[a : a + int(rng.integers(1, 30))]
        else:
            t = list(rng.choice(list("abcd"), int(rng.integers(1, 20))))
        rows.append((i, "\n".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc, r.idx) for r in lines.removed_lines(docs, m).collect()}
    assert got == brute(rows, m)
    text = {i: t.split("\n") for i, t in rows}
    table = lines.line_table(docs)
    runs = lines.copied_runs(lines.suffix_array(table, m)).collect()
    for r in runs:  # each run is a maximal match with its original
        a, b = text[r.doc][r.idx :], text[r["first"].doc][r["first"].idx :]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert r.lines >= m and (r["first"].doc, r["first"].idx) < (r.doc, r.idx) and r.lines <= n
        # a run ends with the stretch of repeated lines, or where the texts differ
        assert r.lines == n or (r.doc, r.idx + r.lines) not in {(x.doc, x.idx) for x in runs}


def test_columns_that_clash_are_kept(spark):
    rows = [(1, "a\nb\nc", 5, 6, 7, 8, 9), (2, "x\na\nb", 15, 16, 17, 18, 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone long, doc long, tag long, runs long, n_lines long")
    got = {r.doc_id: r for r in lines.deduplicate(docs).collect()}
    assert (got[2].text, got[2].gone, got[2].doc, got[2].tag, got[2].runs, got[2].n_lines, got[2].n_removed) == ("x", 15, 16, 17, 18, 3, 2)
    assert (got[1].text, got[1].gone, got[1].n_removed, got[1].n_runs) == (rows[0][1], 5, 0, 0)
