"""Ordered folds: what depends on all that came before it in its key, such as a merge of neighbours or a cooldown."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Rows of a batch that a fold gives back.
OUT_ROWS = 2000


def ordered_fold(rows: DataFrame, key: str, order: list[str], fold: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, clean: Column | None = None) -> DataFrame:
    """fold's rows for each key, from that key's rows (without the key) in order; the key stands before each of them.

    Rows are dealt to tasks by key and sorted there, and one pass runs through all keys of a task: fold gets an
    iterator that reads on, over batches, as it is asked, so what is held is the fold's own state, not the key.

    clean says, in terms of the row before (`F.lag` over a window of the key is written by `before`), that nothing
    earlier can matter from this row on. There a key is cut into stretches, which are dealt apart, so that a key with
    very many rows is spread over tasks.
    """
    names = [c for c in rows.columns if c != key]
    dealt, head = rows, [key]
    if clean is not None:
        w = Window.partitionBy(key).orderBy(*order)
        dealt = rows.withColumn("_clean", F.coalesce(clean, F.lit(False)).cast("long")).withColumn("_stretch", F.sum("_clean").over(w)).drop("_clean")
        head = [key, "_stretch"]
    sorted_ = dealt.repartition(*head).sortWithinPartitions(*head, *order).select(*head, *names)
    kind = rows.schema[key].dataType.simpleString()
    whole = StructType.fromDDL(f"`{key}` {kind}, {schema}")
    arrow = to_arrow_schema(whole)
    own, rest = len(head), itemgetter(slice(len(head), None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for k, mine in groupby(stream, itemgetter(slice(0, own))):
            for made in fold(map(rest, mine)):
                out.append((k[0], *made))
                if len(out) == OUT_ROWS:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    return sorted_.mapInArrow(run, whole)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def before(column: Column | str, key: str, order: list[str]) -> Column:
    """A column of the row before, for `clean`."""
    return F.lag(column).over(Window.partitionBy(key).orderBy(*order))
