"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadwell.llm import chat, decontamination, hmm, jaccard, lattice, licences, lines, pieces, sharding, spelling, substrings, toxicity, yinyang
from threadwell.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).withColumn("held_out", toxicity.held_out())


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_held_out(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate(table(spark, sf_dir, "documents"), min_lines=2, keep_emptied=True)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.hilbert_shards(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.clusters(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = chat.row_log(chat.with_hostile(table(spark, sf_dir, "conversations")))
    return chat.digests(chat.render(chat.fold(log))).withColumnRenamed("conv", "conv_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_jaccard_join, op3_language_model, op4_line_dedup, op5_decontamination, op6_licence_scans, op7_suffix_dedup, op8_embedding_dedup, op9_sentencepiece, op10_sharding, op11_centroid_clustering, op12_spelling_variants, op13_chat_formatting)}


#: Shingle sets by a join of all pairs, and reach by a recursive walk: for small tables.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY d) m USING (doc_id)
"""

LATTICE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(d, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d)
SELECT m.vec_id, coalesce(k.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM (SELECT d AS vec_id, min(c) AS component_id FROM r GROUP BY d) m LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = m.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": JACCARD_SQL,
        "op4_line_dedup": lines.ORACLE_SQL,
        "op8_embedding_dedup": LATTICE_SQL,
        "op11_centroid_clustering": yinyang.oracle_sql(),
        "op12_spelling_variants": spelling.ORACLE_SQL,
        "op13_chat_formatting": chat.ORACLE_SQL,
    }
