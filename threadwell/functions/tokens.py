"""Byte-pair token counts, from a file of ranks that is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how texts are cut before merges, in the widely used encoding of 100,000 tokens.
PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})


class TokenCounter:
    """Counts a text's tokens; what `turns.create_chunks` and `turns.merged_turns` take as `count`.

    It carries the bytes of the ranks file (a line has a token in base64 and its rank), some megabytes, to the tasks,
    each of which builds the encoding once. Strings that name special tokens are ordinary text.
    """

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def of(cls, spark: SparkSession, path: str, pattern: str = PATTERN) -> TokenCounter:
        """From a file in any store that Spark reads."""
        return cls(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), pattern)

    def __call__(self, text: str) -> int:
        return len(_encoding(self.ranks, self.pattern).encode_ordinary(text))

    def column(self, text: Column | str) -> Column:
        """The counts of a column, a batch at a time; null for null."""

        @F.pandas_udf("long")
        def counts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield part.map(lambda t: None if t is None else self(t)).astype("Int64")

        return counts(text)
