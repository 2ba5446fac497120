"""Retrieval: BM25 over terms, exact vector search, and rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadwell.functions.text import query_terms, terms

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n documents and their mean length in terms."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(terms(F.coalesce(text, F.lit(""))))).alias("avgdl"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, tf and dl: the inverted index, to be written bucketed by term."""
    split = docs.select(key, terms(F.coalesce(text, F.lit(""))).alias("terms"))
    return split.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def idf(n_docs: Column, df: Column) -> Column:
    """What a term that is in df of n_docs documents counts."""
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What tf occurrences in a document of dl terms count: more for a larger tf or a smaller dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _times(term: str) -> Column:
    """How often a term stands in the array `terms`."""
    return F.size(F.filter("terms", lambda x: x == F.lit(term)))


def bm25(docs: DataFrame, query: str, limit: int | None = 20, key: str = "doc_id", text: str = "text", match: str = "any") -> DataFrame:
    """key and rank (negative; less is better) of the documents that hold any (or all) of the query's terms.

    For texts without an index: they are split twice, for the corpus figures (one row, broadcast) and for the counts.
    The row number keeps the filter from being moved below the split, which would repeat it for each term. A query
    without terms gives nothing.
    """
    wanted = query_terms(query)
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("rank")).limit(0)
    split = docs.select(key, terms(F.coalesce(text, F.lit(""))).alias("terms"), F.monotonically_increasing_id().alias("_row"))
    counted = split.select(key, F.size("terms").alias("dl"), *(_times(t).alias(f"tf{i}") for i, t in enumerate(wanted)))
    tf = [F.col(f"tf{i}") for i in range(len(wanted))]
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *(F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(tf)))
    hits = counted.filter(reduce(lambda a, b: a | b if match == "any" else a & b, [c > 0 for c in tf]))
    scored = hits.crossJoin(F.broadcast(stats))
    rank = reduce(lambda a, b: a + b, [idf(F.col("n_docs"), F.col(f"df{i}")) * weight(c, F.col("dl"), F.col("avgdl")) for i, c in enumerate(tf)])
    out = scored.select(key, (-rank).alias("rank"))
    return out if limit is None else out.orderBy("rank", key).limit(limit)


def bm25_of_hits(hits: DataFrame, n_docs: Column, avgdl: Column, key: str = "doc_id", least: int = 1, allowed: DataFrame | None = None) -> DataFrame:
    """key and rank of the documents that at least `least` of the hits' terms are in, from postings of a query's terms.

    Document frequencies count all hits; allowed (owner) then leaves some documents out. The figures of the corpus are
    literals, or columns of the hits.
    """
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of a query
    if allowed is not None:
        hits = hits.join(allowed, "owner", "left_semi")
    rank = F.sum(idf(n_docs, F.col("df")) * weight(F.col("tf"), F.col("dl"), avgdl))
    return hits.join(F.broadcast(df), "term").groupBy(key).agg((-rank).alias("rank"), F.count("*").alias("found")).filter(F.col("found") >= least).select(key, "rank")


def bm25_from_postings(index: DataFrame, stats: DataFrame, query: str, limit: int = 20, key: str = "doc_id") -> DataFrame:
    """BM25 from a table of postings: only those of the query's terms are read."""
    hits = index.filter(F.col("term").isin(query_terms(query))).crossJoin(F.broadcast(stats))
    return bm25_of_hits(hits, F.col("n_docs"), F.col("avgdl"), key).orderBy("rank", key).limit(limit)


def dot(a: str, b: str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_distance(vectors: DataFrame, query: DataFrame, metric: str = "cosine", embedding: str = "embedding") -> DataFrame:
    """vectors with their distance from the one vector of `query` (column q); cosine for unit vectors, or l2."""
    both = vectors.crossJoin(F.broadcast(query.select("q")))
    if metric == "l2":
        gap = F.aggregate(F.zip_with(embedding, "q", lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
        return both.withColumn("distance", F.sqrt(gap)).drop("q")
    return both.withColumn("distance", 1 - dot(embedding, "q")).drop("q")


def vector_topk(vectors: DataFrame, query: DataFrame, limit: int = 20, key: str = "vec_id", metric: str = "cosine") -> DataFrame:
    """key and distance of the nearest vectors: exact, one pass, a top-k in each task."""
    return vector_distance(vectors, query, metric).select(key, "distance").orderBy("distance", key).limit(limit)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """A short result list with its rank from 0."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int = RRF_K, bonus: float = 0.0) -> DataFrame:
    """key, score and where the key came first (list_no, pos), from lists with a rank from 0 in `pos`.

    Order by score descending, then list_no, then pos. bonus is added once for each first place.
    """
    tagged = reduce(DataFrame.unionByName, [x.select(key, "pos", F.lit(i).alias("list_no")) for i, x in enumerate(lists)])
    score = F.sum(1.0 / (k + F.col("pos") + 1)) + bonus * F.count_if(F.col("pos") == 0)
    return tagged.groupBy(key).agg(score.alias("score"), F.min(F.struct("list_no", "pos")).alias("first")).select(key, "score", "first.list_no", "first.pos")


def first_per_group(df: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """The best row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_n = 1").drop("_n")
