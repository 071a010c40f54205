"""Small helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """Partitions that a scan of ``df`` has."""
    return max(1, df.rdd.getNumPartitions())


def u64(column: pa.Array) -> np.ndarray:
    """A long column's bits as unsigned numbers."""
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)


def i64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).astype(np.uint64, copy=False).view(np.int64))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
        for f in schema for c in [columns[f.name]]], schema=schema)


def by_group(df: DataFrame, key: str | list[str], function, schema: str) -> DataFrame:
    """``function(key, table) -> table`` on the Arrow table of every group."""
    return df.groupBy(key).applyInArrow(lambda k, t: function(k, t), schema)


def pieces(b: pa.RecordBatch, column: str = "text", most: int = 2 << 20):
    """The batch in slices of at most ``most`` bytes of the text column; a longer row makes a slice of its own."""
    text = b.column(column)
    sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(text).to_numpy(zero_copy_only=False), float))
    ends = np.cumsum(sizes)
    lo = 0
    while lo < b.num_rows:
        before = ends[lo - 1] if lo else 0.0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi
