"""Pluggable parts with offline defaults: embedding, re-ranking, query expansion, summarising.

Each default is deterministic. A model goes in as a plain Python function over a batch; Spark runs it in each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 384
Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedding(texts: list[str]) -> np.ndarray:
    """Unit vectors of signed, hashed word counts."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        words = pd.Series((text or "").lower().split(), dtype=object)
        if len(words):
            h = pd.util.hash_array(words.to_numpy(dtype=object))
            np.add.at(out[i], (h % DIM).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(chunks: DataFrame, embedder: Embedder = hashed_embedding, key: str = "chunk_id", text: str = "combined_text", batch: int = 256) -> DataFrame:
    """key and unit embedding of each text, a batch at a time."""
    kind = dict(chunks.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                yield pd.DataFrame({key: some[key], "embedding": list(embedder(some[text].fillna("").tolist()).astype("float32"))})

    return chunks.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def embed_backlog(chunks: DataFrame, vectors: DataFrame, embedder: Embedder = hashed_embedding, key: str = "chunk_id") -> DataFrame:
    """vectors and those of the chunks that had none."""
    return vectors.unionByName(embed(chunks.join(vectors.select(key), key, "left_anti"), embedder, key))


def overlap_scorer(query: str) -> Callable[[DataFrame], DataFrame]:
    """Default re-ranker: the share of the query's words that a hit's user and assistant text hold."""
    words = sorted(set(query.lower().split()))

    def rerank(hits: DataFrame) -> DataFrame:
        text = F.lower(F.concat_ws("\n", "user_content", "assistant_content"))
        found = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
        return hits.withColumn("score", found / F.lit(max(len(words), 1)))

    return rerank


def expand_query(query: str) -> list[tuple[str, str]]:
    """Default query expansion: the query's longer words as one more text query."""
    long = [w for w in query.split() if len(w) > 3]
    return [("lex", " ".join(long))] if long and " ".join(long) != query else []


def first_sentence(text: str) -> str | None:
    """Default summariser."""
    line = next((x for x in text.removeprefix("User: ").splitlines() if x.strip()), "")
    return line[:120] or None


def summarise(texts: DataFrame, call: Callable[[str], str | None] = first_sentence, key: str = "session_id", least: int = 100) -> DataFrame:
    """session_id and summary of session texts of 100 characters or more; failures give no row."""
    kind = dict(texts.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = part.assign(summary=[call(t) for t in part["session_text"]])
            yield got[got["summary"].notna()][[key, "summary"]]

    return texts.filter(F.length("session_text") >= least).select(key, "session_text").mapInPandas(run, f"{key} {kind}, summary string")
