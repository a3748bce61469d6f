"""Tables written on the way, and bounded batches of text inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; below the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    above = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{above.rstrip('/')}/tablewright-llm/{label}-{uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, its lineage cut.

    What was written survives lost executors, and every later read sees the same rows.
    The folder stays until its owner clears the checkpoint directory.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """Remainder of the checksum of the id as text; NULL ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        first, before = 0, 0
        while first < batch.num_rows:
            last = max(int(np.searchsorted(ends, before + limit, "right")), first + 1)
            yield batch.slice(first, last - first)
            first, before = last, int(ends[last - 1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` of every i, one after the other."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def bounds(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums of ``lengths``."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def schema_of(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
