"""The engine's relations over the driver's tables, and the same as SQL.

Documents stand in for chunks (source for the session, lang for the branch), embeddings for vectors, events of a user
for a session's life, conversations for messages, customers for sessions with a project and a remote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwell.functions.text import ACCENTS


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("session_id"), F.col("lang").alias("git_branch"), F.col("text").alias("combined_text"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def query_vector(spark: SparkSession, d: str, vec_id: int = 7) -> DataFrame:
    return load(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").filter(F.col("role").isin("user", "assistant"))


def lives(spark: SparkSession, d: str) -> DataFrame:
    """session_id, first_message_at, last_message_at (as text), message_count and files of each user's events."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return load(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.min(ts).alias("first_message_at"), F.max(ts).alias("last_message_at"), F.count("*").alias("message_count"), F.array_sort(F.collect_set("event_type")).alias("files_touched"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    """session_id, project_path and git_remote (null for some) of customers."""
    path = F.concat(F.lit("/home/"), F.lower("c_mktsegment"), F.lit("/p"), F.col("c_nationkey").cast("string"))
    remote = F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("org/r"), (F.col("c_nationkey") % 7).cast("string")))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), path.alias("project_path"), remote.alias("git_remote"))


LIVES_SQL = "lives AS (SELECT user_id AS session_id, min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS first_message_at, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last_message_at, count(*) AS message_count, list_sort(list(DISTINCT event_type)) AS files FROM events GROUP BY user_id)"
PROJECTS_SQL = "projects AS (SELECT c_custkey AS session_id, '/home/' || lower(c_mktsegment) || '/p' || c_nationkey::VARCHAR AS project_path, CASE WHEN c_nationkey % 5 <> 0 THEN 'org/r' || (c_nationkey % 7)::VARCHAR END AS git_remote FROM customer)"
MESSAGES_SQL = "msgs AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant'))"
TERMS_SQL = f"terms AS (SELECT doc_id, regexp_extract_all(translate(lower(text), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents)"


def bm25_sql(words: list[str], need: str, limit: int, name: str = "fts", tag: str = "") -> str:
    """CTEs that end in `name` (doc_id, rank): BM25 of the words, any or all needed. With a tag the CTEs before carry
    it, and terms and corpus are those of another use."""
    listed = ", ".join(f"('{w}')" for w in words)
    least = 1 if need == "any" else len(words)
    shared = "" if tag else f"{TERMS_SQL},\ncorpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM terms),\n"
    return f"""{shared}q{tag}(w) AS (VALUES {listed}),
tf{tag} AS (SELECT doc_id, w, len(t) AS dl, len(list_filter(t, lambda x: x = w)) AS tf FROM terms, q{tag}),
hit{tag} AS (SELECT * FROM tf{tag} WHERE tf > 0),
df{tag} AS (SELECT w, count(*) AS df FROM hit{tag} GROUP BY w),
idf{tag} AS (SELECT w, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df{tag}, corpus),
{name} AS (SELECT doc_id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank FROM hit{tag} JOIN idf{tag} USING (w), corpus GROUP BY doc_id HAVING count(*) >= {least} ORDER BY rank, doc_id LIMIT {limit})"""


def knn_sql(limit: int, vec_id: int = 7, name: str = "knn") -> str:
    return f"{name} AS (SELECT e.vec_id AS doc_id, 1 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q ORDER BY distance, doc_id LIMIT {limit})"
