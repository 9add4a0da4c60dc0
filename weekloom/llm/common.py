"""Helpers of the text operators: batches of texts, bounded word caches, stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# A worker's word cache is emptied at this many words, which bounds its memory whatever the vocabulary.
CACHED_WORDS = 400_000


class WordCache(dict):
    """Remembers ``fn(word)``; emptied when full, so results never depend on what it holds."""

    def __init__(self, fn: Callable, limit: int = CACHED_WORDS):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.fn(word)
        return value


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


# Rows turned into Python objects at once; batches of long texts are taken in slices of this size.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on slices of every Arrow batch; the batches of a partition are never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield fn(part)

    return df.mapInArrow(run, schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
