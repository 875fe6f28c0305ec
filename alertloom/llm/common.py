"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"


def narrow(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only, so that no further column can clash with ours."""
    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].alias("text"))


def keyed(documents: DataFrame) -> DataFrame:
    """``narrow`` with ``text_key``; rows equal in both keys are repeats of one row."""
    return narrow(documents).withColumn("text_key", F.xxhash64("text"))


def whole(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold_of(doc_id: str | Column = "doc_id") -> Column:
    """The fold of a document: crc32 of its id as text, modulo 4; ids that are null are in fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4, F.lit(0))


def batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str,
            setup: Callable[[], Callable] | None = None) -> DataFrame:
    """Apply ``work`` to every Arrow batch inside tasks; ``setup`` makes it once for each task."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = setup() if setup else work
        for batch in incoming:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def text_function(setup: Callable[[], Callable], kind: str) -> Callable[[Column], Column]:
    """A column function over texts that runs in tasks in Arrow batches; ``setup`` makes it once for each task."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        step = setup()
        for part in parts:
            yield pd.Series([step(value) for value in part], dtype=object if "<" in kind else None)

    return F.pandas_udf(run, kind)
