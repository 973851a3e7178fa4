"""Shared helpers: tables written to the shared folder, Arrow batches in
slices, and the bucketed as-of lookup."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of an Arrow batch handled at once inside a Python task.
SLICE_ROWS = 512
#: Bytes of text handled at once where a slice is cut by size.
SLICE_BYTES = 12_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage
    is cut, the copy survives lost executors, and it is compressed and
    column-pruned when read again."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have; names are told apart without
    regard to case, as Spark does."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, also where ``body``
    uses it inside the lambda of a higher-order function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grown(df: DataFrame) -> DataFrame:
    """A written table that grows with the input, as a join's side: never
    broadcast for the sake of its small, compressed files."""
    return df.hint("merge")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterator[pa.RecordBatch], name: str,
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of the text column ``name``; a longer
    text is a slice of its own."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0)).astype(np.int64)
        ends, at, done = np.cumsum(size), 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at, done = stop, int(ends[stop - 1])


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The text column with null read as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def latest_earlier(events: DataFrame, keys: list[str], order: str, value: str,
                   out: str, bucket: int = 4096) -> DataFrame:
    """``events`` with ``out``: the ``value`` of the last row of the same
    ``keys`` that has a value and a strictly smaller ``order``; null where
    there is none.  ``keys`` and ``order`` (an integer) are not null.

    The as-of lookup runs on two levels, so that a key holding a third of all
    rows isn't sorted in one task: windows inside (keys, order // bucket), and
    windows over the one row that partial aggregation leaves of each such
    bucket.  Rows of equal ``order`` don't see each other; where several rows
    with a value share an ``order``, the largest value counts.
    """
    part = F.floor(F.col(order) / F.lit(bucket)).cast("bigint").alias("_part")
    mark = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    inside = (Window.partitionBy(*keys, "_part").orderBy(order)
              .rangeBetween(Window.unboundedPreceding, -1))
    seen = events.select("*", part).withColumn("_own", F.max(mark).over(inside))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (events.groupBy(*keys, part).agg(F.max(mark).alias("_top"))
             .select(*keys, "_part", F.max("_top").over(before).alias("_earlier")))
    return (seen.join(parts, [*keys, "_part"])
            .select(*events.columns, F.coalesce("_own", "_earlier")["v"].alias(out)))


def rank_in_key(rows: DataFrame, keys: list[str], order: str, out: str, bucket: int = 4096) -> DataFrame:
    """``rows`` with ``out``: how many rows of the same ``keys`` have a smaller
    ``order`` (no nulls), on the same two levels."""
    part = F.floor(F.col(order) / F.lit(bucket)).cast("bigint").alias("_part")
    inside = Window.partitionBy(*keys, "_part").orderBy(order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (rows.groupBy(*keys, part).agg(F.count("*").alias("_n"))
             .select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (rows.select("*", part).withColumn("_in", F.rank().over(inside) - 1)
            .join(parts, [*keys, "_part"])
            .select(*rows.columns, (F.col("_before") + F.col("_in")).cast("bigint").alias(out)))
