"""Registered queries of retrieval, search modes and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadwell import schema
from threadwell.operators import dml, filters, retrieval, search, storage
from threadwell.operators.snapshots import Tables
from threadwell.operators.text_index import TextIndex, TrigramIndex
from threadwell.operators.vector_index import VectorIndex
from threadwell.plans.stand_ins import LIVES_SQL, PROJECTS_SQL, TERMS_SQL, bm25_sql, chunks, knn_sql, lives, load, projects, query_vector, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BUILT: dict[tuple[str, str, str], TextIndex | VectorIndex] = {}


def _built(spark, d, kind):
    """The documents' index of a kind, written once for each application and folder."""
    at = spark.sparkContext.applicationId, d, kind.__name__
    if at not in _BUILT or not storage.exists(spark, _BUILT[at].root):
        _BUILT[at] = kind(spark, storage.scratch(spark, "text-index"), buckets=16).build(chunks(spark, d))
    return _BUILT[at]


def text_index(spark, d) -> TextIndex:
    return _built(spark, d, TextIndex)


def trigram_index(spark, d) -> TrigramIndex:
    return _built(spark, d, TrigramIndex)


def vector_index(spark, d) -> VectorIndex:
    """The embeddings, clustered, written once for each application and folder."""
    at = spark.sparkContext.applicationId, d, "vectors"
    if at not in _BUILT or not storage.exists(spark, _BUILT[at].root):
        _BUILT[at] = VectorIndex(spark, storage.scratch(spark, "vector-index")).build(vectors(spark, d))
    return _BUILT[at]


def rounded(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query(f"WITH {knn_sql(20)} SELECT doc_id AS vec_id, round(distance, 6) + 0.0 AS distance FROM knn")
def vector_topk(spark, d):
    return retrieval.vector_topk(load(spark, d, "embeddings"), query_vector(spark, d)).select("vec_id", rounded("distance"))


@query("SELECT vec_id, round(distance, 6) + 0.0 AS distance FROM (SELECT e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY 2, 1 LIMIT 20)")
def vector_topk_l2(spark, d):
    return retrieval.vector_topk(load(spark, d, "embeddings"), query_vector(spark, d), metric="l2").select("vec_id", rounded("distance"))


@query(SQL["vector_topk"])
def vector_topk_clustered(spark, d):
    return vector_index(spark, d).search(query_vector(spark, d)).select(F.col("chunk_id").alias("vec_id"), rounded("distance"))


@query(SQL["vector_topk_l2"])
def vector_topk_l2_clustered(spark, d):
    return vector_index(spark, d).search(query_vector(spark, d), metric="l2").select(F.col("chunk_id").alias("vec_id"), rounded("distance"))


@query("SELECT label, vec_id, round(distance, 6) + 0.0 AS distance FROM (SELECT label, vec_id, distance, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS k FROM (SELECT e.label, e.vec_id, 1 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)) WHERE k = 1")
def vector_per_label_best(spark, d):
    near = retrieval.vector_distance(load(spark, d, "embeddings"), query_vector(spark, d)).select("label", "vec_id", "distance")
    return retrieval.first_per_group(near, "label", "distance", "vec_id").select("label", "vec_id", rounded("distance"))


def _bm25(words: str, need: str):
    sql = f"WITH {bm25_sql(words.split(), need, 20)} SELECT doc_id, round(rank, 6) + 0.0 AS rank FROM fts"
    return sql, lambda spark, d: text_index(spark, d).search(words, match=need).select(F.col("chunk_id").alias("doc_id"), rounded("rank"))


for _name, _words, _need in (("fts_single", "idiot", "any"), ("fts_any", "idiot thinnt las", "any"), ("fts_all", "the from with", "all")):
    SQL[_name], QUERIES[_name] = _bm25(_words, _need)


@query(f"WITH {TERMS_SQL} SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avgdl FROM terms")
def bm25_stats(spark, d):
    return retrieval.corpus_stats(load(spark, d, "documents")).select("n_docs", rounded("avgdl"))


@query(SQL["fts_any"])
def fts_scan(spark, d):
    return retrieval.bm25(load(spark, d, "documents"), "idiot thinnt las").select("doc_id", rounded("rank"))


@query(SQL["fts_any"])
def fts_updated_index(spark, d):
    """Built with other texts in some sessions, which are then replaced; one of them twice."""
    own = chunks(spark, d)
    first = own.withColumn("combined_text", F.when(F.col("session_id").isin(_SOURCES), F.lit("idiot las las")).otherwise(F.col("combined_text")))
    index = TextIndex(spark, storage.scratch(spark, "text-index"), buckets=8).build(first)
    index.update(first.filter("session_id = 'src3'").withColumn("combined_text", F.lit("thinnt")))
    index.update(own.filter(F.col("session_id").isin(_SOURCES)))
    return index.search("idiot thinnt las").select(F.col("chunk_id").alias("doc_id"), rounded("rank"))


@query(SQL["fts_all"])
def fts_merged_index(spark, d):
    own = chunks(spark, d)
    index = TextIndex(spark, storage.scratch(spark, "text-index"), buckets=8).build(own.filter("session_id <> 'src1'"))
    index.update(own.filter("session_id = 'src1'"))
    return index.merge().search("the from with", match="all").select(F.col("chunk_id").alias("doc_id"), rounded("rank"))


@query(SQL["fts_any"])
def fts_compacted_index(spark, d):
    """Built without texts, which four updates bring, a quarter of the sessions each: the segments are merged twice."""
    own = chunks(spark, d)
    index = TextIndex(spark, storage.scratch(spark, "text-index"), buckets=8).build(own.withColumn("combined_text", F.lit("las thinnt")))
    for i in range(4):
        index.update(own.filter(F.pmod(F.xxhash64("session_id"), F.lit(4)) == i))
    return index.search("idiot thinnt las").select(F.col("chunk_id").alias("doc_id"), rounded("rank"))


def _phrased(text: str, units: list[str], need: str):
    """A search with phrases of two words, and its SQL, where a unit is looked for at each place."""
    at_each = "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = split_part(w, ' ', 1) AND (split_part(w, ' ', 2) = '' OR t[i + 1] = split_part(w, ' ', 2))))"
    sql = f"WITH {bm25_sql(units, need, 20).replace('len(list_filter(t, lambda x: x = w))', at_each)} SELECT doc_id, round(rank, 6) + 0.0 AS rank FROM fts"
    return sql, lambda spark, d: text_index(spark, d).search(text, match=need).select(F.col("chunk_id").alias("doc_id"), rounded("rank"))


for _name, _text, _units, _need in (
    ("fts_phrase", '"the of"', ["the of"], "any"),
    ("fts_phrase_repeated", "the-the", ["the the"], "any"),
    ("fts_phrase_mixed", "idiot attion_to (of-the)", ["idiot", "attion to", "of the"], "any"),
    ("fts_phrase_all", '"of the" attion "and of"', ["of the", "attion", "and of"], "all"),
):
    SQL[_name], QUERIES[_name] = _phrased(_text, _units, _need)


@query(SQL["fts_any"])
def fts_postings(spark, d):
    docs = load(spark, d, "documents")
    return retrieval.bm25_from_postings(retrieval.postings(docs), retrieval.corpus_stats(docs), "idiot thinnt las").select("doc_id", rounded("rank"))


_RANKED = """{0}r AS (SELECT doc_id, row_number() OVER (ORDER BY {1}, doc_id) - 1 AS pos FROM {0})"""
_FUSE = "fused AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + pos + 1)) AS score, min(list_no * 1000000 + pos) AS first FROM ({0}) GROUP BY doc_id)"
_LISTS = "SELECT doc_id, pos, 0 AS list_no FROM knnr UNION ALL SELECT doc_id, pos, 1 FROM ftsr"
_TWO = f"WITH {knn_sql(50)}, {bm25_sql(['idiot', 'the'], 'any', 50)}, {_RANKED.format('knn', 'distance')}, {_RANKED.format('fts', 'rank')}"


def _lists(spark, d, n=50):
    near = retrieval.ranked(retrieval.vector_topk(vectors(spark, d), query_vector(spark, d), n, "chunk_id"), "distance", "chunk_id")
    words = retrieval.ranked(text_index(spark, d).search("idiot the", n), "rank", "chunk_id")
    return near, words


@query(f"{_TWO}, {_FUSE.format(_LISTS)} SELECT doc_id AS chunk_id, round(score, 9) AS score FROM fused")
def rrf_two_lists(spark, d):
    return retrieval.reciprocal_rank_fusion(list(_lists(spark, d)), "chunk_id").select("chunk_id", rounded("score", 9))


@query(f"{_TWO}, {knn_sql(30, 11, 'knn2')}, {_RANKED.format('knn2', 'distance')}, {_FUSE.format(_LISTS + ' UNION ALL SELECT doc_id, pos, 2 FROM knn2r')} SELECT doc_id AS chunk_id, round(score, 9) AS score FROM fused ORDER BY score DESC, first, doc_id LIMIT 20")
def rrf_three_lists(spark, d):
    third = retrieval.ranked(retrieval.vector_topk(vectors(spark, d), query_vector(spark, d, 11), 30, "chunk_id"), "distance", "chunk_id")
    out = retrieval.reciprocal_rank_fusion([*_lists(spark, d), third], "chunk_id")
    return out.orderBy(F.desc(F.round("score", 12)), "list_no", "pos", "chunk_id").limit(20).select("chunk_id", rounded("score", 9))


def _hybrid_sql(where: str, knn: str | None = None, fts: str | None = None, more: str = "", lists: str = _LISTS, final: str | None = None) -> str:
    final = final or "SELECT doc_id AS chunk_id, source AS session_id, round(score, 9) AS score FROM placed WHERE k = 1 ORDER BY round(score, 12) DESC, first, doc_id LIMIT 10"
    return f"""WITH {knn or knn_sql(50)}, {fts or bm25_sql(['idiot', 'the'], 'any', 50)}, {_RANKED.format('knn', 'distance')}, {_RANKED.format('fts', 'rank')}{more}, {_FUSE.format(lists)},
capped AS (SELECT * FROM fused ORDER BY round(score, 12) DESC, first, doc_id LIMIT 100),
placed AS (SELECT c.*, d.source, row_number() OVER (PARTITION BY d.source ORDER BY round(score, 12) DESC, first, c.doc_id) AS k FROM capped c JOIN documents d USING (doc_id) WHERE {where})
{final}"""


def _hybrid(spark, d, **kw):
    return search.hybrid(chunks(spark, d), vectors(spark, d), "idiot the", query_vector(spark, d), index=text_index(spark, d), **kw).select("chunk_id", "session_id", rounded("score", 9))


_SOURCES = ["src1", "src3", "src5", "src7", "src11"]
_IN = "source IN (" + ", ".join(f"'{s}'" for s in _SOURCES) + ")"


def _allowed(spark, d):
    return load(spark, d, "documents").filter(F.col("source").isin(_SOURCES)).select(F.col("source").alias("session_id")).distinct()


@query(_hybrid_sql("true"))
def hybrid(spark, d):
    return _hybrid(spark, d)


@query(_hybrid_sql("true"))
def hybrid_clustered(spark, d):
    """Words from the inverted index, vectors from the clustered table."""
    return search.hybrid(chunks(spark, d), vector_index(spark, d), "idiot the", query_vector(spark, d), index=text_index(spark, d)).select("chunk_id", "session_id", rounded("score", 9))


@query(_hybrid_sql(_IN))
def hybrid_filtered_post(spark, d):
    return _hybrid(spark, d, allowed=_allowed(spark, d))


@query(_hybrid_sql("true", knn_sql(50).replace("FROM embeddings e,", f"FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE {_IN})) e,"), bm25_sql(["idiot", "the"], "any", 50).replace("FROM documents)", f"FROM documents WHERE {_IN})")))
def hybrid_filtered_pre(spark, d):
    return _hybrid(spark, d, allowed=_allowed(spark, d), filter_mode="pre")


_MORE = f", {bm25_sql(['worthless', 'trash'], 'any', 50, 'lex', '2')}, {knn_sql(50, 11, 'knn2')}, {_RANKED.format('lex', 'rank')}, {_RANKED.format('knn2', 'distance')}"


@query(_hybrid_sql("true", more=_MORE, lists=_LISTS + " UNION ALL SELECT doc_id, pos, 2 FROM lexr UNION ALL SELECT doc_id, pos, 3 FROM knn2r"))
def hybrid_expanded(spark, d):
    variants = search.expanded("idiot the", lambda _: [("lex", "worthless trash"), ("hyde", "x")], lambda _: query_vector(spark, d, 11))
    return _hybrid(spark, d, variants=variants)


@query(_hybrid_sql("true").replace("AS score, min(list_no", "+ 0.05 * count(*) FILTER (WHERE pos = 0) AS score, min(list_no"))
def hybrid_top_bonus(spark, d):
    return _hybrid(spark, d, bonus=0.05)


@query(f"SELECT session_id, round(score, 9) AS score FROM ({_hybrid_sql('true').replace('LIMIT 10', 'LIMIT 15').replace('LIMIT 50', 'LIMIT 75').replace('LIMIT 100', 'LIMIT 150')}) ORDER BY score DESC, session_id LIMIT 5")
def resume(spark, d):
    return search.resume(chunks(spark, d), vectors(spark, d), "idiot the", query_vector(spark, d), 5).select("session_id", rounded("score", 9))


_ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"SELECT doc_id AS chunk_id, source AS session_id FROM documents WHERE {_ASCII.format('text')} LIKE '%licensed under%' ORDER BY doc_id DESC LIMIT 50")
def grep_like(spark, d):
    return filters.grep(chunks(spark, d), "Licensed UNDER").select("chunk_id", "session_id")


@query(f"SELECT doc_id AS chunk_id, source AS session_id FROM documents WHERE {_ASCII.format('text')} LIKE '%th_n%idi_t%' ORDER BY doc_id DESC LIMIT 50")
def grep_wildcard(spark, d):
    return filters.grep(chunks(spark, d), "th_n%idi_t").select("chunk_id", "session_id")


@query(f"SELECT doc_id AS chunk_id, source AS session_id, 1.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM (SELECT doc_id, source FROM documents WHERE {_ASCII.format('text')} LIKE '%licensed%' ORDER BY doc_id DESC LIMIT 50)) WHERE k = 1 ORDER BY doc_id DESC LIMIT 10")
def grep_session_dedup(spark, d):
    return search.grep_search(chunks(spark, d), "licensed").select("chunk_id", "session_id", "score")


def _like_sql(pattern: str) -> str:
    return f"SELECT doc_id AS chunk_id, source AS session_id FROM documents WHERE {_ASCII.format('text')} LIKE '%{pattern}%' ORDER BY doc_id DESC LIMIT 50"


for _name, _part in (("grep_like_indexed", "Licensed UNDER"), ("grep_wildcard_indexed", "th_n%idi_t"), ("grep_indexed_common", "the "), ("grep_indexed_short", "x_"), ("grep_indexed_accent", "Éieran"), ("grep_indexed_nothing", "qqqzzz")):
    SQL[_name] = _like_sql(_part.translate({i: i + 32 for i in range(65, 91)}))
    QUERIES[_name] = lambda spark, d, part=_part: trigram_index(spark, d).grep(part).select("chunk_id", "session_id")


@query(SQL["grep_session_dedup"])
def grep_session_indexed(spark, d):
    return search.grep_search(chunks(spark, d), "licensed", index=trigram_index(spark, d)).select("chunk_id", "session_id", "score")


@query(f"WITH {LIVES_SQL} SELECT session_id, last_message_at, 1.0::DOUBLE AS score FROM lives WHERE to_json(files)::VARCHAR LIKE '%purch%' ORDER BY last_message_at DESC, session_id LIMIT 10")
def file_contains(spark, d):
    return search.file_search(lives(spark, d), "PURCH").select("session_id", "last_message_at", "score")


def _research(spark, d, names):
    """The embeddings as research entries; names gives the file of an id."""
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("/notes/"), names(F.col("vec_id"))).alias("source_file"), F.col("label").cast("string").alias("content"), "embedding")


def _cross_sql(name: str, limit: int) -> str:
    final = f"""SELECT source, pos, round(score, 9) AS score FROM m WHERE source = 'chat' OR NOT EXISTS (SELECT 1 FROM m c WHERE c.source = 'chat' AND c.pos < m.pos AND contains(c.content, m.content)) ORDER BY pos LIMIT {limit}"""
    more = f""", chat AS (SELECT p.doc_id, d.text AS content, row_number() OVER (ORDER BY round(score, 12) DESC, first, p.doc_id) - 1 AS own FROM placed p JOIN documents d USING (doc_id) WHERE k = 1),
named AS (SELECT {name} AS content, pos FROM knnr),
res AS (SELECT content, row_number() OVER (ORDER BY min(pos)) - 1 AS own FROM named GROUP BY content),
al AS (SELECT 'chat' AS source, content, own FROM chat UNION ALL SELECT 'research', content, own FROM res),
m AS (SELECT *, 1.0::DOUBLE / (61 + own) AS score, row_number() OVER (ORDER BY own, source) - 1 AS pos FROM al)
{final}"""
    return _hybrid_sql("true", final=more)


def _cross(spark, d, names, limit):
    return search.cross_search(chunks(spark, d), vectors(spark, d), _research(spark, d, names), "idiot the", query_vector(spark, d), limit, index=text_index(spark, d)).select("source", "pos", rounded("score", 9))


@query(_cross_sql("'zz-' || doc_id", 10))
def cross_interleave(spark, d):
    return _cross(spark, d, lambda i: F.concat(F.lit("zz-"), i.cast("string")), 10)


@query(_cross_sql("CASE doc_id % 4 WHEN 0 THEN 'the' WHEN 1 THEN 'and' ELSE 'n' || doc_id END", 10))
def cross_antidedup(spark, d):
    return _cross(spark, d, lambda i: F.when(i % 4 == 0, "the").when(i % 4 == 1, "and").otherwise(F.concat(F.lit("n"), i.cast("string"))), 10)


@query(f"WITH {LIVES_SQL} SELECT session_id FROM lives WHERE last_message_at >= '2024-01-02T00:00:00' AND first_message_at <= '2024-01-01T06:00:00'")
def interval_overlap(spark, d):
    return filters.session_filter(lives(spark, d), since="2024-01-02T00:00:00", before="2024-01-01T06:00:00")


@query(f"WITH {PROJECTS_SQL}, r AS (SELECT DISTINCT git_remote FROM projects WHERE project_path LIKE '%building/p3%' AND git_remote IS NOT NULL), p AS (SELECT DISTINCT project_path FROM projects WHERE git_remote IN (SELECT git_remote FROM r)) SELECT project_path FROM p WHERE (SELECT count(*) FROM p) > 1")
def project_expand(spark, d):
    return filters.expand_project(projects(spark, d), "BUILDING/p3")


@query(f"WITH {PROJECTS_SQL} SELECT session_id FROM projects WHERE project_path LIKE '%building/p5%'")
def project_filter_no_remote(spark, d):
    return filters.session_filter(projects(spark, d), project="building/p5")


@query("SELECT DISTINCT source AS session_id, 'found' AS verdict FROM documents WHERE source = 'src1'")
def prefix_resolve(spark, d):
    return filters.resolve_prefix(chunks(spark, d).select("session_id").distinct(), "session_id", "src1")


@query("SELECT DISTINCT source AS session_id, 'ambiguous' AS verdict FROM documents WHERE source LIKE 'src%'")
def prefix_ambiguous(spark, d):
    return filters.resolve_prefix(chunks(spark, d).select("session_id").distinct(), "session_id", "SRC")


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def unembedded_anti(spark, d):
    return filters.not_embedded(chunks(spark, d), vectors(spark, d)).select("chunk_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(spark, d):
    return dml.latest(load(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


_CUT = "2024-01-02T00:00:00"


@query(f"WITH {LIVES_SQL} SELECT session_id, CASE WHEN last_message_at >= '{_CUT}' THEN 'v2' ELSE 'v1' END AS slug, CASE WHEN first_message_at < '{_CUT}' THEN 'kept' END AS topic_summary FROM lives")
def upsert_sessions(spark, d):
    """Old rows are the sessions that began before a time, new ones those that ended after it."""
    own = lives(spark, d)
    old = own.filter(F.col("first_message_at") < _CUT).select("session_id", F.lit("v1").alias("slug"), F.lit("kept").alias("topic_summary"))
    return dml.upsert_sessions(old, own.filter(F.col("last_message_at") >= _CUT).select("session_id", F.lit("v2").alias("slug")))


@query("SELECT 'chunks' AS relation, count(*) AS n FROM documents WHERE source <> 'src1' UNION ALL SELECT 'sessions', count(DISTINCT source) FROM documents WHERE source <> 'src1' UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1') UNION ALL SELECT 'subagents', count(*) FROM conversations WHERE conv_id % 5 <> 1")
def delete_cascade(spark, d):
    own = chunks(spark, d)
    agents = load(spark, d, "conversations").select(F.concat(F.lit("src"), (F.col("conv_id") % 5).cast("string")).alias("parent_session_id"))
    left = dml.delete_sessions(own.filter("session_id = 'src1'").select("session_id").distinct(), own.select("session_id").distinct(), own, vectors(spark, d), agents)
    parts = [df.agg(F.lit(n).alias("relation"), F.count("*").alias("n")) for n, df in zip(("sessions", "chunks", "vectors", "subagents"), left, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {LIVES_SQL} SELECT session_id, last_message_at AS mtime FROM lives WHERE message_count <= 15 OR last_message_at > '2024-01-02T12:00:00'")
def incremental_skip(spark, d):
    """Sessions of over 15 events were indexed at noon."""
    own = lives(spark, d)
    indexed = own.filter("message_count > 15").select("session_id", F.lit("2024-01-02T12:00:00").alias("indexed_at"))
    return filters.stale(own.select("session_id", F.col("last_message_at").alias("mtime")), indexed)


@query(f"WITH {PROJECTS_SQL}, nw AS (SELECT project_path, 'org/new' AS r FROM projects WHERE project_path LIKE '%/p3' GROUP BY 1) SELECT session_id, coalesce(nw.r, git_remote) AS git_remote FROM projects LEFT JOIN nw USING (project_path)")
def remote_backfill(spark, d):
    own = projects(spark, d)
    fresh = own.filter(F.endswith("project_path", F.lit("/p3"))).select("project_path").distinct().withColumn("git_remote", F.lit("org/new"))
    return dml.set_remotes(own, fresh)[0].select("session_id", "git_remote")


@query("SELECT (SELECT count(DISTINCT source) FROM documents) AS sessions, (SELECT count(DISTINCT source) FROM documents WHERE source LIKE 'src1%') AS summarised, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS embedded")
def stats(spark, d):
    own = chunks(spark, d)
    sessions = own.select("session_id").distinct().withColumn("topic_summary", F.when(F.startswith("session_id", F.lit("src1")), F.lit("x")))
    return filters.stats(sessions, own, vectors(spark, d))


_NEW = "(SELECT DISTINCT project_path, 'org/new' AS r FROM projects WHERE project_path LIKE '%/p3')"


@query(f"WITH {PROJECTS_SQL} SELECT count(*) AS changed FROM projects JOIN {_NEW} nw USING (project_path) WHERE git_remote IS DISTINCT FROM nw.r")
def remote_backfill_changed(spark, d):
    own = projects(spark, d)
    fresh = own.filter(F.endswith("project_path", F.lit("/p3"))).select("project_path").distinct().withColumn("git_remote", F.lit("org/new"))
    return dml.set_remotes(own, fresh)[1]


@query("SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM documents WHERE source = 'src4'")
def session_chunks_ordered(spark, d):
    own = chunks(spark, d).join(load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("turn_number")), "chunk_id")
    return retrieval.ranked(filters.session_chunks(own, "src4"), "turn_number", "chunk_id").select("chunk_id", (F.col("pos") + 1).alias("place"))


def _agents(spark, d):
    """Turns as subagents of their conversation."""
    return load(spark, d, "conversations").select(F.concat(F.lit("A"), F.col("turn").cast("string"), F.lit("x"), F.col("conv_id").cast("string")).alias("agent_id"), F.col("conv_id").cast("string").alias("parent_session_id"), F.length("text").alias("file_size"))


@query("SELECT 'A' || turn || 'x' || conv_id AS agent_id, conv_id::VARCHAR AS parent_session_id FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) ORDER BY agent_id LIMIT 1")
def subagent_prefix(spark, d):
    parent = load(spark, d, "conversations").agg(F.min("conv_id")).first()[0]
    return filters.resolve_subagent(_agents(spark, d), str(parent), "a").select("agent_id", "parent_session_id")


@query("WITH s AS (SELECT DISTINCT conv_id FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id::VARCHAR AS session_id, coalesce(n, 0) AS subagents FROM s LEFT JOIN n USING (conv_id)")
def subagent_count(spark, d):
    own = load(spark, d, "conversations")
    agents = own.filter("role = 'assistant'").select(F.col("conv_id").cast("string").alias("parent_session_id"))
    return filters.subagent_counts(own.select(F.col("conv_id").cast("string").alias("session_id")), agents)


def _summed(spark, d):
    return chunks(spark, d).select("session_id").distinct().withColumn("topic_summary", F.when(F.startswith("session_id", F.lit("src1")), F.concat(F.lit("about "), "session_id")))


@query(f"SELECT h.*, CASE WHEN session_id LIKE 'src1%' THEN 'about ' || session_id END AS topic_summary FROM ({_hybrid_sql('true')}) h")
def hits_with_summaries(spark, d):
    return search.with_summaries(_hybrid(spark, d), _summed(spark, d)).select("chunk_id", "session_id", "score", "topic_summary")


@query("SELECT 'sessions' AS relation, 0 AS n UNION ALL SELECT 'chunks', 0 UNION ALL SELECT 'vectors', 0 UNION ALL SELECT 'marked', count(*) FROM documents UNION ALL SELECT 'reset', 0")
def full_wipe(spark, d):
    own, vec = chunks(spark, d), vectors(spark, d)
    left = dml.wipe(own.select("session_id").distinct(), own, vec)
    empty, marked = dml.reset_vectors(own, vec)
    parts = [df.agg(F.lit(n).alias("relation"), F.count("*").alias("n")) for n, df in zip(("sessions", "chunks", "vectors", "reset"), (*left, empty), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(marked.select(F.lit("marked").alias("relation"), F.col("marked").alias("n")))


@query(f"WITH h AS ({_hybrid_sql('true')}) SELECT 'idiot the' AS query, 'hybrid' AS mode, count(*) AS results, string_agg(session_id || ':' || round(score, 4), ',' ORDER BY score DESC, session_id) AS hits FROM h")
def search_log(spark, d):
    path = storage.scratch(spark, "search-log")
    search.log_search(_hybrid(spark, d), "idiot the", "hybrid", 1.0, path)
    row = spark.read.schema("query string, mode string, results long, hits array<struct<session: string, score: double>>").json(path)
    return row.select("query", "mode", "results", F.array_join(F.transform("hits", lambda h: F.concat(h["session"], F.lit(":"), h["score"].cast("string"))), ",").alias("hits"))


@query("SELECT '/' || c_mktsegment || '/x' AS project_path, min('-' || c_mktsegment || '-x') AS folder FROM customer GROUP BY c_mktsegment")
def project_folder(spark, d):
    names = load(spark, d, "customer").select("c_mktsegment").distinct()
    folders = names.select(F.concat(F.lit("-"), "c_mktsegment", F.lit("-x")).alias("folder")).unionByName(names.select(F.concat(F.lit("/"), "c_mktsegment", F.lit("-x")).alias("folder")))
    return _folders(folders, names.select(F.concat(F.lit("/"), "c_mktsegment", F.lit("/x")).alias("project_path")))


def _folders(folders, paths):
    from threadwell.sources.transcripts import project_folders

    return project_folders(folders, paths).select("project_path", "folder")


@query("SELECT user_id AS session_id, count(*) AS n, sum(event_id)::BIGINT AS total FROM events WHERE event_type <> 'view' OR user_id % 2 = 0 GROUP BY user_id")
def replace_sessions_in_buckets(spark, d):
    """All events are stored; then the odd users' are replaced by those that are no views."""
    path = storage.scratch(spark, "events")
    rows = load(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", "event_type")
    dml.replace_sessions(rows, path, buckets=8)
    odd = rows.filter("session_id % 2 = 1")
    dml.replace_sessions(odd.filter("event_type <> 'view'"), path, changed=odd, buckets=8)
    return spark.read.parquet(path).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("SELECT c_custkey::VARCHAR AS session_id, NULL::VARCHAR AS topic_summary, 15 AS n_columns FROM customer")
def migrated_columns(spark, d):
    old = load(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("dropped"))
    new = dml.migrated(old, schema.SESSIONS)
    return new.select("session_id", "topic_summary", F.lit(len(new.columns)).alias("n_columns"))


_AFTER = f"SELECT * FROM events WHERE event_type <> 'view' OR user_id NOT IN (SELECT session_id FROM lives WHERE first_message_at < '{_CUT}')"


@query(f"WITH {LIVES_SQL}, after AS ({_AFTER}) SELECT 'before' AS reader, count(*) AS events, count(DISTINCT user_id) AS sessions, count(*)::BIGINT AS counted FROM events UNION ALL SELECT 'after', count(*), count(DISTINCT user_id), count(*)::BIGINT FROM after")
def snapshot_readers(spark, d):
    """Events and their counts by user are stored by one commit; another takes the views of early users out of both. A
    reader of the first snapshot sees neither change, one of the second sees both."""
    events = load(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", "event_type")
    rollup = lambda df: df.groupBy("session_id").agg(F.count("*").alias("n"))
    tables = Tables(spark, storage.scratch(spark, "snapshots"), {"events": events.schema, "sessions": rollup(events).schema}, buckets=8)
    first = tables.change()
    first.append("events", events)
    first.append("sessions", rollup(events))
    before = first.commit()
    early = lives(spark, d).filter(F.col("first_message_at") < _CUT).select("session_id")
    left = events.filter("event_type <> 'view'").join(early, "session_id", "left_semi")
    second = tables.change()
    second.replace("events", left, early)
    second.replace("sessions", rollup(left), early)
    second.commit()

    def seen(reader, at):
        sessions = tables.read("sessions", at).agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
        return tables.read("events", at).agg(F.lit(reader).alias("reader"), F.count("*").alias("events")).join(sessions)  # a row each

    return seen("before", before).unionByName(seen("after", tables.latest()))


@query(f"WITH {LIVES_SQL} SELECT session_id, message_count FROM lives WHERE first_message_at >= '{_CUT}' AND message_count > 2 ORDER BY first_message_at DESC, session_id LIMIT 50")
def unsummarised(spark, d):
    own = lives(spark, d).withColumn("topic_summary", F.when(F.col("first_message_at") < _CUT, "kept"))
    return filters.without_summary(own).select("session_id", "message_count")


@query(f"WITH {LIVES_SQL} SELECT session_id, coalesce(c_name, CASE WHEN first_message_at < '{_CUT}' THEN 'kept' END) AS topic_summary FROM lives LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = session_id")
def summaries_set(spark, d):
    """Summaries replace those that were there; sessions without one keep theirs."""
    own = lives(spark, d).withColumn("topic_summary", F.when(F.col("first_message_at") < _CUT, "kept"))
    made = load(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("summary"))
    return dml.set_summary(own, made).select("session_id", "topic_summary")


@query(f"""WITH {LIVES_SQL}, {PROJECTS_SQL}, h AS (SELECT session_id::VARCHAR AS s, round_even(message_count / 7.0, 4) AS score, 'p' || split_part(project_path, '/p', 2) AS project, message_count AS turn FROM lives JOIN projects USING (session_id) ORDER BY message_count DESC, session_id LIMIT 20)
SELECT 'busy' AS query, 'file' AS mode, count(*) AS results, '2024' AS since, string_agg(s || ':' || project || ':' || turn || ':' || round(score * 10000)::BIGINT, ',' ORDER BY turn DESC, s) AS hits FROM h""")
def search_log_fields(spark, d):
    """The log of a search by filters: hits with project, turn and score, and the filters given."""
    both = lives(spark, d).join(projects(spark, d), "session_id").orderBy(F.desc("message_count"), "session_id").limit(20)
    hits = both.select("session_id", (F.col("message_count") / 7).alias("score"), "project_path", F.col("message_count").alias("turn_number"))
    path = storage.scratch(spark, "search-log")
    search.log_search(hits, "busy", "file", 1.0, path, filters={"since": "2024"})
    row = spark.read.schema("query string, mode string, results long, filters map<string, string>, hits array<struct<session: string, score: double, project: string, turn: long>>").json(path)
    listed = F.transform("hits", lambda h: F.concat_ws(":", h["session"], h["project"], h["turn"].cast("string"), F.round(h["score"] * 10000).cast("long").cast("string")))
    return row.select("query", "mode", "results", F.col("filters")["since"].alias("since"), F.array_join(listed, ",").alias("hits"))
