"""Upserts, deletes and table maintenance as DataFrame rewrites; writes replace partitions or swap whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from threadwell.operators import storage

#: Columns of a session that re-indexing leaves alone.
KEPT = ("topic_summary", "git_remote")


def upsert_sessions(old: DataFrame, new: DataFrame, key: str = "session_id", kept: tuple[str, ...] = KEPT) -> DataFrame:
    """New rows replace old ones, but for the columns in kept, which stay as they were."""
    o = old.select(F.col(key), *(F.col(c).alias(f"_old_{c}") for c in old.columns if c != key), F.lit(True).alias("_old"))
    n = new.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != key), F.lit(True).alias("_new"))
    both = o.join(n, key, "full")

    def pick(c: str):
        if c == key:
            return F.col(key)
        if c not in new.columns or c in kept:
            fresh = F.col(f"_new_{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
            return F.when(F.col("_old"), F.col(f"_old_{c}")).otherwise(fresh).alias(c)
        return F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c)

    return both.select(*(pick(c) for c in old.columns))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: insert or replace."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(o) for o in order)))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def delete_sessions(gone: DataFrame, sessions: DataFrame, chunks: DataFrame, vectors: DataFrame, subagents: DataFrame, key: str = "session_id", chunk: str = "chunk_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is left of the four tables without the sessions in gone."""
    lost = chunks.join(gone, key, "left_semi").select(chunk)
    return (
        sessions.join(gone, key, "left_anti"),
        chunks.join(gone, key, "left_anti"),
        vectors.join(lost, chunk, "left_anti"),
        subagents.join(gone.withColumnRenamed(key, "parent_session_id"), "parent_session_id", "left_anti"),
    )


def set_summary(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """sessions with topic_summary from (session_id, summary) where there is one."""
    return sessions.join(summaries.select("session_id", "summary"), "session_id", "left").withColumn("topic_summary", F.coalesce("summary", "topic_summary")).drop("summary")


def set_remotes(sessions: DataFrame, remotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sessions with git_remote by project_path, and one row with the number that changed."""
    joined = sessions.join(remotes.select("project_path", F.col("git_remote").alias("_new")), "project_path", "left")
    changed = F.col("_new").isNotNull() & ~F.col("git_remote").eqNullSafe(F.col("_new"))
    return joined.withColumn("git_remote", F.coalesce("_new", "git_remote")).drop("_new"), joined.agg(F.count_if(changed).alias("changed"))


#: Folders that a table is dealt to by a hash of its session.
BUCKETS = 256


def replace_sessions(new: DataFrame, path: str, key: str = "session_id", changed: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Replace the rows of the changed sessions (default: those in new) by new; only their buckets are written again.

    A bucket that is left without rows goes.
    """
    spark, bucket = new.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = new.withColumn("bucket", bucket)
    if storage.exists(spark, path):
        gone = (new.select(key) if changed is None else changed.select(key)).distinct()
        touched = sorted(r[0] for r in gone.select(bucket).distinct().collect())  # at most `buckets`
        kept = spark.read.schema(rows.schema).parquet(path).filter(F.col("bucket").isin(touched)).join(gone, key, "left_anti")
        rows = rows.unionByName(kept.select(*rows.columns))
        left = {r[0] for r in rows.select("bucket").distinct().collect()}
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        for b in set(touched) - left:
            storage.delete(spark, f"{path}/bucket={b}")
    else:
        rows.repartition("bucket").write.partitionBy("bucket").parquet(path)


def wipe(sessions: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without rows, for a whole new index; subagents stay."""
    return sessions.limit(0), chunks.limit(0), vectors.limit(0)


def reset_vectors(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty table of vectors, and one row with the number of chunks that are to be embedded anew."""
    return vectors.limit(0), chunks.agg(F.count("*").alias("marked"))


def migrated(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the columns of schema, in that order: missing ones are null, others go."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
