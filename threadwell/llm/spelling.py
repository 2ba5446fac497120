"""Spelling variants by errata-trie merging: words that are one edit apart meet where their paths in a trie part.

Two words one edit apart share a prefix, a node of the trie, and go on by different edges. Heavy-path decomposition
calls the edge to the child with most words heavy and the others (the end of a word too) light, so of two edges at
least one is light, and a word has few light edges on its path: each halves the words below. Only light subtrees are
merged into their node's errata tree, small into large: below a light edge every word is moved with that edge's
character replaced, skipped, or preceded by the heavy one. Terminals that coincide are pairs one edit apart:

- replaced, light with light: the same node and the same rest below it;
- replaced, light with heavy: the word with the heavy character in its place;
- skipped: the word without the character (where a character repeats, only the last of the run is skipped);
- preceded: the word with the heavy character inserted before the light edge.

The last three are looked up among the words, which stand for the trie's terminals; so nothing of a heavy subtree is
moved, and every pair is found exactly once. Pairs are counted where they are found and never gathered by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threadwell.llm.common import saved

#: Fixed value: the letters of a word, a closed set; nodes up to this depth are therefore few enough to broadcast.
LETTERS, SHALLOW = "[A-Za-z\\u00C0-\\u00FF]+", 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the replaced character; no letter.
ANY = "*"


def runs(docs: DataFrame, slip: int = 97, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word: every maximal run of letters of every text, A-Z lower-cased, one for each place.

    Where slip divides the crc32 of `<key>:<run>`, one code point of the run is deleted, at crc32 modulo its length. A
    null text has no runs; a null key is written as nothing.
    """
    found = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("run"))
    low = found.select("k", F.translate("run", UPPER, LOWER).alias("w")).withColumn("h", F.crc32(F.concat("k", F.lit(":"), "w").cast("binary")))
    at = F.pmod("h", F.length("w").cast("long")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    return low.select(F.when(F.pmod("h", F.lit(slip)) == 0, cut).otherwise(F.col("w")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word and n of the words of at least least_length code points that occur least_count times."""
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _steps(words: DataFrame) -> DataFrame:
    """A row for each edge on a word's path: the node (by its depth `i` and prefix) and the edge's character, which is
    empty at the word's end."""
    path = words.select("*", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    return path.withColumns({"node": F.substring("word", F.lit(1), F.col("i")), "edge": F.substring("word", F.col("i") + 1, F.lit(1))})


def forks(words: DataFrame) -> DataFrame:
    """node and heavy: nodes with several edges, and the character of the edge with most words (of equals the smallest).
    The end of a word is never heavy."""
    edges = _steps(words.select("word")).groupBy("node", "edge").agg(F.count("*").alias("m"))
    heavy = F.min(F.when(F.col("edge") != "", F.struct((-F.col("m")).alias("m"), "edge")))["edge"]
    return edges.groupBy("node").agg(F.count("*").alias("edges"), heavy.alias("heavy")).filter("edges > 1").select("node", "heavy")


def light_edges(words: DataFrame) -> DataFrame:
    """word, n, i, edge and heavy: the light edges on each word's path, with the heavy one beside each.

    Nodes of depth 0 to SHALLOW are bounded by the alphabet, and their table is broadcast: there all words would meet
    at one key. Deeper nodes are joined.
    """
    table, steps = saved(forks(words), "errata-forks"), _steps(words)
    low = steps.filter(F.col("i") <= SHALLOW).join(F.broadcast(table.filter(F.length("node") <= SHALLOW)), "node")
    deep = steps.filter(F.col("i") > SHALLOW).join(table.filter(F.length("node") > SHALLOW), "node")
    columns = ("word", "n", "i", "edge", "heavy")
    return low.select(*columns).unionByName(deep.select(*columns)).filter(F.col("edge") != F.col("heavy"))


def _best(n: Column | str, word: Column | str) -> Column:
    """Orders near words: the larger n first, then the smaller word."""
    return F.struct((-(F.col(n) if isinstance(n, str) else n)).alias("m"), (F.col(word) if isinstance(word, str) else word).alias("w"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near (the words exactly one edit away) and best (the one of largest n, as -n and word; null without
    any). words (word, n) is a written table, each word once."""
    light = saved(light_edges(words), "errata-light")
    head, rest = F.substring("word", F.lit(1), F.col("i")), F.substring("word", F.col("i") + 2, F.length("word"))
    inner = F.col("edge") != ""  # a replaced or skipped character must be there
    # light with light: a group has a word for each letter at most
    tree = light.filter(inner).groupBy(F.concat(head, F.lit(ANY), rest).alias("key")).agg(F.array_sort(F.collect_list(_best("n", "word"))).alias("all")).filter(F.size("all") > 1)
    among = tree.select(F.posexplode("all").alias("at", "own"), "all").select(F.col("own.w").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), F.when(F.col("at") == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    below = F.substring("word", F.col("i") + 1, F.length("word"))
    probes = F.array_compact(
        F.array(
            F.when(inner, F.concat(head, "heavy", rest)),
            F.when(inner & (F.col("edge") != F.substring("word", F.col("i") + 2, F.lit(1))), F.concat(head, rest)),
            F.concat(head, "heavy", below),
        )
    )
    asked = light.select("word", "n", F.explode(probes).alias("other"))
    met = asked.join(words.select(F.col("word").alias("other"), F.col("n").alias("n_other")), "other")
    both = F.array(F.struct(F.col("word").alias("word"), _best("n_other", "other").alias("best")), F.struct(F.col("other").alias("word"), _best("n", "word").alias("best")))
    across = met.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("long").alias("n_near"), "x.best")
    found = among.unionByName(across).select("word", F.lit(None).cast("long").alias("n"), "n_near", "best")
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    return found.unionByName(own).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of a written vocabulary (word, n).

    form is the near word of largest n (of equals the first in code-point order) if its n is at least factor times the
    word's; root is where the forms of forms end, the word itself if it has none. n doubles along forms, so they end
    soon. An empty vocabulary gives no rows.
    """
    enough = -F.col("best.m") >= factor * F.col("n")
    near = near_words(words).select("word", F.when(enough, F.col("best.w")).alias("form"), "n", "n_near", F.when(enough, -F.col("best.m")).alias("form_n"))
    table = saved(near, "errata-forms")
    linked = table.filter("form IS NOT NULL").select("word", "form")
    goes_on = linked.join(linked.select(F.col("word").alias("form"), F.lit(True).alias("on")), "form", "left").select("word", "form", F.coalesce("on", F.lit(False)).alias("on"))
    return table.join(_roots(saved(goes_on, "errata-links")), "word", "left").select("word", "form", F.coalesce("root", "form", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word and root of words whose form has a form itself (`on`): each round follows the links of those that are not
    at a root yet, which are fewer every time."""
    done, now = [], links.filter("on").select("word", F.col("form").alias("at"))
    step = links.select(F.col("word").alias("at"), F.col("form").alias("next"), "on")
    while True:
        left = Observation()
        now = saved(now.join(step, "at").select("word", F.col("next").alias("at"), "on").observe(left, F.count_if("on").alias("n")), "errata-roots")
        done.append(now.filter("NOT on").select("word", F.col("at").alias("root")))
        if not left.get["n"]:
            return reduce(DataFrame.unionByName, done)
        now = now.filter("on").select("word", "at")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The vocabulary of all whole texts with each word's form and root; see `runs`, `vocabulary` and `variants`."""
    return variants(saved(vocabulary(runs(docs)), "errata-words"))


#: crc32 by its table, then every word's neighbours by wildcards and deletions.
ORACLE_SQL = r"""
WITH RECURSIVE steps(b, i, c) AS (SELECT b, 0, b::UBIGINT FROM range(256) t(b) UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE i < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM steps WHERE i = 8),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
d AS MATERIALIZED (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r GROUP BY doc_id, w),
h AS (SELECT w, n, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(0, len(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1)::UBIGINT * 16 + (strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::UBIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h FROM d, crc),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
k AS MATERIALIZED (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS wild, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM p),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT x.word AS a, y.word AS b FROM k x JOIN k y ON x.wild = y.wild AND x.word <> y.word UNION ALL SELECT k.word, v.word FROM k JOIN v ON k.less = v.word UNION ALL SELECT v.word, k.word FROM k JOIN v ON k.less = v.word)),
b AS (SELECT e.a AS word, e.b AS best, y.n AS m, count(*) OVER (PARTITION BY e.a) AS n_near, row_number() OVER (PARTITION BY e.a ORDER BY y.n DESC, encode(e.b)) AS k FROM e JOIN v y ON y.word = e.b),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * v.n THEN b.best END AS form, CASE WHEN b.m >= 2 * v.n THEN b.m END AS form_n FROM v LEFT JOIN b ON b.word = v.word AND b.k = 1),
w(word, place, form) AS (SELECT word, word, form FROM f UNION ALL SELECT w.word, f.word, f.form FROM w JOIN f ON f.word = w.form)
SELECT f.word, f.form, w.place AS root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word AND w.form IS NULL
"""
