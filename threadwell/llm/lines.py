"""Line de-duplication by a suffix array over line identities, built with distributed prefix doubling.

DataFrame operations only. A document is the sequence of its lines that are not blank; a line's identity is its MD5.
A suffix's rank is the pair (identity of its first line, place among the suffixes that begin with it), so ordering
by rank is the suffix array and no global numbering is needed. Places are byte strings that compare in order. A
doubling round with step s splits each group of suffixes that agree on s lines by the rank of the suffix s lines on:
the distinct next ranks are numbered in order and the number is appended to the place, after the first byte of what
it is numbered by, so that the followers of a common line are numbered in 256 parts. After it, equal ranks mean
agreement on 2 s lines: they are the intervals of the suffix array with a longest common prefix of 2 s at least. The intervals of
exactly m lines come from two ranks that overlap. A suffix that is not the first of its interval has the first of its
widest interval as its original; where originals do not run on in step, a copied run begins, and its length is the
common prefix of the two suffixes, counted line by line. These maximal runs are what is deleted.

Two exact reductions keep the array small: lines that occur once, and pairs of neighbouring lines that occur once,
can be in no repeated run (of two lines or more), so sequences are cut there; and a sequence leaves the doubling once
the step covers it.

A line of more than LONG_WORDS words is a run by itself. Its interval is the lines of its identity, so its first
member needs no doubling: it is the least of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadwell.llm.common import saved, unused

_NO_ID = (1 << 63) - 1
#: A single line of more words than this is a passage, and its later copies go whatever stands around them.
LONG_WORDS = 50
#: What makes a line more than blank.
VISIBLE = r"[^\x20\x09-\x0D]"


def _key() -> tuple[Column, Column]:
    """The key of a document: its id (null ids last) and a hash of its text, for ids that repeat."""
    return F.coalesce("doc_id", F.lit(_NO_ID)), F.xxhash64(F.coalesce("text", F.lit("")))


def _split(text: str | Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _is_long(line: Column) -> Column:
    """Whether a line has more than LONG_WORDS words; so many words take two characters each, but for the last."""
    return F.when(F.length(line) > 2 * LONG_WORDS, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) > LONG_WORDS).otherwise(F.lit(False))


def line_table(docs: DataFrame, with_long: bool = False) -> DataFrame:
    """doc, tag, idx (among lines that are not blank), pos (among all lines) and id of each line, documents once; and long."""
    numbered = F.transform(_split("text"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    seen = F.filter(numbered, lambda s: s["line"].rlike(VISIBLE))
    doc, tag = _key()
    lines = docs.select(doc.alias("doc"), tag.alias("tag"), F.posexplode(seen).alias("idx", "s"))
    long = [_is_long(F.col("s.line")).alias("long")] if with_long else []
    return lines.select("doc", "tag", "idx", F.col("s.pos").alias("pos"), F.unhex(F.md5(F.col("s.line").cast("binary"))).alias("id"), *long)


def _sequences(lines: DataFrame) -> DataFrame:
    """The stretches of lines in which every line and every pair of neighbours repeats: seq (first idx) and len."""
    twice = saved(lines.groupBy("id").agg(F.count("*").alias("m")).filter("m > 1").select("id"), "lines-twice")  # written, so that the join can split a common line
    own = lines.join(twice, "id")
    in_doc = Window.partitionBy("doc", "tag").orderBy("idx")
    pairs = own.withColumns({"after": F.lead("id").over(in_doc), "after_idx": F.lead("idx").over(in_doc)})
    pairs = saved(pairs.withColumn("after", F.when(F.col("after_idx") == F.col("idx") + 1, F.col("after"))).drop("after_idx"), "lines-pairs")
    repeated = pairs.filter("after is not null").groupBy("id", "after").agg(F.count("*").alias("m")).filter("m > 1").select("id", "after", F.lit(True).alias("joined"))
    repeated = saved(repeated, "lines-repeated")  # written, so that the join can split a common pair
    flagged = pairs.join(repeated, ["id", "after"], "left").withColumn("joined", F.coalesce("joined", F.lit(False)))
    begins = ~F.coalesce(F.lag("joined").over(in_doc), F.lit(False))
    # lines of a document that no repeated pair joins stand alone and go
    flagged = flagged.withColumn("begins", begins).withColumn("seq", F.max(F.when(F.col("begins"), F.col("idx"))).over(in_doc))
    sized = flagged.withColumn("len", F.count("*").over(Window.partitionBy("doc", "tag", "seq")))
    return sized.filter("len > 1").select("doc", "tag", "seq", "len", "idx", "pos", "id")


_PLACE = "struct<doc: bigint, tag: bigint, idx: int, seq: int>"


def suffix_array(lines: DataFrame, min_lines: int = 2) -> DataFrame:
    """Each suffix of a repeated stretch with its rank (id, off), and depth and first: the widest interval found with
    an earlier member, as the lines that all of it share (min_lines or a larger power of two; 1 if none), and that
    interval's first member."""
    me = F.struct("doc", "tag", "idx", "seq")
    in_seq = Window.partitionBy("doc", "tag", "seq").orderBy("idx")
    rows = saved(_sequences(lines).withColumns({"off": F.lit(b""), "depth": F.lit(1), "first": F.lit(None).cast(_PLACE)}), "lines-suffixes")
    longest = rows.agg(F.max("len")).first()[0] or 0
    done, step, left = None, 1, F.col("seq") + F.col("len") - F.col("idx")

    def ahead(df: DataFrame, n: int) -> DataFrame:
        after = F.lead(F.struct("id", "off"), n).over(in_seq)
        return df.withColumn("next", after).withColumns({"nid": F.coalesce("next.id", F.lit(b"")), "noff": F.coalesce("next.off", F.lit(b""))}).drop("next")

    def marked(df: DataFrame, depth: int) -> DataFrame:
        """With depth and first where `head`, the first member of an interval of so many lines, is another."""
        copy = (left >= depth) & (F.col("head") < me)
        return df.withColumns({"depth": F.when(copy, F.lit(depth)).otherwise(F.col("depth")), "first": F.when(copy, F.col("head")).otherwise(F.col("first"))}).drop("head")

    while step < longest:
        if step < min_lines < 2 * step:  # agreement on min_lines lines: on the first step of them and on the last
            keyed = ahead(rows, min_lines - step)
            heads = keyed.filter(left >= min_lines).groupBy("id", "off", "nid", "noff").agg(F.min(me).cast(_PLACE).alias("head"))
            rows = saved(marked(keyed.join(heads, ["id", "off", "nid", "noff"], "left"), min_lines).drop("nid", "noff"), "lines-suffixes")
        keyed = ahead(rows, step)
        classes = keyed.groupBy("id", "off", "nid", "noff").agg(F.min(me).cast(_PLACE).alias("head"))
        part = F.when(F.octet_length("nid") > 0, F.substring("nid", 1, 1)).otherwise(F.lit(b"\0"))
        classes = classes.withColumn("part", part)
        nth = F.row_number().over(Window.partitionBy("id", "off", "part").orderBy("nid", "noff"))
        classes = classes.withColumn("new_off", F.concat("off", "part", F.unhex(F.lpad(F.hex(nth), 8, "0")))).drop("part")
        rows = keyed.join(classes, ["id", "off", "nid", "noff"])
        if 2 * step >= min_lines:
            rows = marked(rows, 2 * step)
        rows = saved(rows.select("doc", "tag", "seq", "len", "idx", "pos", "id", F.col("new_off").alias("off"), "depth", "first"), "lines-suffixes")
        step *= 2
        ended = rows.filter(F.col("len") <= step)
        done = ended if done is None else done.unionByName(ended)
        rows = rows.filter(F.col("len") > step)
    return rows if done is None else done.unionByName(rows)


def copied_runs(suffixes: DataFrame) -> DataFrame:
    """The maximal runs that begin earlier elsewhere: doc, tag, idx, lines (in common with the original) and first.

    A run begins where the original is not the one before's, one line on. Its length is the common prefix of the two
    stretches from there.
    """
    in_doc = Window.partitionBy("doc", "tag").orderBy("idx")
    copies = suffixes.filter(F.col("first").isNotNull()).select("doc", "tag", "seq", "idx", "first")
    last, last_idx = F.lag("first").over(in_doc), F.lag("idx").over(in_doc)
    goes_on = (last_idx == F.col("idx") - 1) & (last["doc"] == F.col("first.doc")) & (last["tag"] == F.col("first.tag")) & (last["idx"] == F.col("first.idx") - 1)
    heads = copies.withColumn("on", F.coalesce(goes_on, F.lit(False))).filter("not on").drop("on")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda x: x["id"])
    stretches = suffixes.groupBy("doc", "tag", "seq").agg(ids.alias("ids"))
    wanted = heads.select("doc", "tag", "seq").unionByName(heads.select("first.doc", "first.tag", "first.seq")).distinct()
    stretches = saved(stretches.join(wanted, ["doc", "tag", "seq"], "left_semi"), "lines-stretches")
    origin = stretches.select(F.col("doc").alias("f_doc"), F.col("tag").alias("f_tag"), F.col("seq").alias("f_seq"), F.col("ids").alias("f_ids"))
    placed = heads.select("*", F.col("first.doc").alias("f_doc"), F.col("first.tag").alias("f_tag"), F.col("first.seq").alias("f_seq"))
    both = placed.join(stretches, ["doc", "tag", "seq"]).join(origin, ["f_doc", "f_tag", "f_seq"])
    rest = lambda ids, at: F.slice(ids, at + 1, F.greatest(F.size(ids) - at, F.lit(0)))
    same = F.zip_with(rest("ids", F.col("idx") - F.col("seq")), rest("f_ids", F.col("first.idx") - F.col("f_seq")), lambda x, y: F.coalesce(x == y, F.lit(False)))
    apart = F.array_position(same, F.lit(False))
    return both.select("doc", "tag", "idx", F.when(apart > 0, apart - 1).otherwise(F.size(same)).cast("int").alias("lines"), "first")


def _long_copies(lines: DataFrame) -> DataFrame:
    """The long lines that stand earlier elsewhere: doc, tag, idx, pos."""
    me, long = F.struct("doc", "tag", "idx"), lines.filter("long")
    first = long.groupBy("id").agg(F.min(me).alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    return long.join(first, "id").filter(F.col("first") < me).select("doc", "tag", "idx", "pos")


def removed_lines(docs: DataFrame, min_lines: int | None = None) -> DataFrame:
    """doc, tag, idx, pos of every line in a later copy of a run: of min_lines lines or more (2 at least), or, if it is
    not given, of two lines or more or of one long line."""
    by_words, min_lines = min_lines is None, 2 if min_lines is None else min_lines
    if min_lines < 2:
        raise ValueError("min_lines must be 2 at least")
    lines = saved(line_table(docs, by_words).dropDuplicates(["doc", "tag", "idx"]), "lines")
    suffixes = suffix_array(lines.drop("long"), min_lines)
    runs = copied_runs(suffixes).filter(F.col("lines") >= min_lines).select("doc", "tag", "idx", "lines")
    in_doc = Window.partitionBy("doc", "tag").orderBy("idx")
    covered = suffixes.select("doc", "tag", "idx", "pos").join(runs, ["doc", "tag", "idx"], "left").withColumn("reach", F.max(F.col("idx") + F.col("lines")).over(in_doc))
    gone = covered.filter("reach > idx").select("doc", "tag", "idx", "pos")
    return gone.unionByName(_long_copies(lines)).distinct() if by_words else gone


def deduplicate(docs: DataFrame, min_lines: int | None = None, keep_emptied: bool = False) -> DataFrame:
    """docs with the later copies of repeated line runs cut out of their texts, and n_lines, n_removed, n_runs.

    A run of two neighbouring lines or more (blank ones aside), or of one line of more than LONG_WORDS words, that
    begins earlier elsewhere, by document id and then position, is deleted; the earliest copy stays, within one
    document too. With min_lines, runs of so many lines or more are deleted and no others. n_lines counts the lines
    that are not blank, n_runs the stretches deleted. Blank lines stay. A document of which no visible line is left
    goes, unless keep_emptied. Null texts stay null and empty texts empty. Rows that repeat a doc_id with the same
    text are one document, and each of them keeps what it keeps; null doc_ids come last. Other columns are kept as
    they are; columns of docs named n_lines, n_removed or n_runs are replaced.
    """
    gone = removed_lines(docs, min_lines).withColumn("new", F.coalesce(F.col("idx") - F.lag("idx").over(Window.partitionBy("doc", "tag").orderBy("idx")), F.lit(2)) > 1)
    names = {x: unused(docs, x) for x in ("doc", "tag", "gone", "runs")}
    gone = gone.groupBy("doc", "tag").agg(F.collect_set("pos").alias("gone"), F.count_if("new").alias("runs")).withColumnsRenamed(names)
    doc, tag, cut, runs = names.values()
    joined = docs.withColumns(dict(zip((doc, tag), _key(), strict=True))).join(gone, [doc, tag], "left")
    left = F.array_join(F.filter(_split("text"), lambda x, i: ~F.array_contains(cut, i)), "\n")
    whole = F.col(cut).isNull()
    text = F.when(whole, F.col("text")).otherwise(left)
    extra = {
        "n_lines": F.size(F.filter(_split("text"), lambda x: x.rlike(VISIBLE))).cast("long"),
        "n_removed": F.when(whole, F.lit(0)).otherwise(F.size(cut)).cast("long"),
        "n_runs": F.coalesce(runs, F.lit(0)).cast("long"),
    }
    out = joined.select(*((text if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in extra), *(v.alias(k) for k, v in extra.items()), whole.alias(doc))
    if not keep_emptied:
        out = out.filter(F.col(doc) | F.col("text").rlike(VISIBLE))
    return out.drop(doc)


#: The same rows as op4_line_dedup, for DuckDB.
ORACLE_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
raw AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM parts),
seen AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
two AS (SELECT doc_id, idx, md5(line) AS l1, lead(md5(line)) OVER (PARTITION BY doc_id ORDER BY idx) AS l2 FROM seen),
dup AS (SELECT doc_id, idx FROM (SELECT doc_id, idx, row_number() OVER (PARTITION BY l1, l2 ORDER BY doc_id, idx) AS k FROM two WHERE l2 IS NOT NULL) WHERE k > 1),
gone AS (SELECT doc_id, idx FROM dup UNION SELECT doc_id, idx + 1 FROM dup),
marked AS (SELECT doc_id, idx, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM gone),
per AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT island) AS n_runs FROM marked GROUP BY doc_id),
kept AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) AS text
         FROM raw r LEFT JOIN seen s ON s.doc_id = r.doc_id AND s.pos = r.pos LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.idx = s.idx
         WHERE g.idx IS NULL GROUP BY r.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM seen GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(per.n_removed, 0) AS n_removed, coalesce(per.n_runs, 0) AS n_runs, md5(coalesce(kept.text, '')) AS kept_md5
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
