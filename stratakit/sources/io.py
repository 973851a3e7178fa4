"""Sources and sinks.

Schemas are declared, never inferred, on the read path; writes go through
Spark's parallel writers.  Small fitted parameters (quantile edges, lambda,
copula model) are stored as tiny JSON tables next to MLlib models."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK_SCHEMA = T.StructType([
    T.StructField("arrival", T.DoubleType()),
    T.StructField("processing", T.DoubleType()),
    T.StructField("deadline", T.DoubleType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """A1: CSV scan with a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def read_task_sets(spark: SparkSession, path: str, order_col: str | None = None, fmt: str = "csv",
                   schema: T.StructType = TASK_SCHEMA) -> DataFrame:
    """A2: a folder of task-set files, one file = one instance.

    ``instance_id`` is the file name, ``task_no`` the place of a row in its
    file, or its rank in ``order_col`` (a number that the files carry; added
    to the schema if it isn't there).  One global sort ranks all files, not a
    window a file.  A file may be read in several splits."""
    from stratakit.operators.queues import number_tasks
    if order_col is not None and order_col not in schema.names:
        schema = T.StructType([T.StructField(order_col, T.LongType()), *schema.fields])
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    df = with_file_order(df, fmt).withColumn("instance_id", F.element_at(F.split("_file_path", "/"), -1))
    own = [order_col] if order_col is not None else ["_file_at", "_file_row"]
    return number_tasks(df, "instance_id", own).drop("_file_path", "_file_at", "_file_row")


def with_file_order(df: DataFrame, fmt: str) -> DataFrame:
    """Columns ``_file_path``, ``_file_at``, ``_file_row`` of a fresh scan:
    rows of a file are in the order of the last two.  Parquet knows the row's
    number; of a text file it is the split's first byte and the row's place
    among those that the task reads (tasks read a split from front to back)."""
    if fmt == "parquet":
        at, row = F.lit(0).cast("long"), F.col("_metadata.row_index")
    else:
        at, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    return df.select("*", F.col("_metadata.file_path").alias("_file_path"), at.alias("_file_at"), row.alias("_file_row"))


def from_pandas(spark: SparkSession, pdf, schema: T.StructType | None = None) -> DataFrame:
    """A3: local frame -> table; rejects non-frames and empty frames."""
    if not isinstance(pdf, pd.DataFrame):
        raise TypeError("expected a pandas DataFrame")
    if pdf.empty:
        raise ValueError("the frame is empty")
    return spark.createDataFrame(pdf, schema) if schema is not None else spark.createDataFrame(pdf)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """A5/A6 sinks: a report or comparison table written by Spark."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def save_params(spark: SparkSession, params: dict, path: str) -> None:
    """Persist small fitted parameters (JSON-able) as a one-row table."""
    spark.createDataFrame([(json.dumps(params, default=_jsonable),)], "params string") \
        .coalesce(1).write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str) -> dict:
    """Read back what :func:`save_params` wrote."""
    return json.loads(spark.read.json(path).first()["params"])


def _jsonable(o):
    if hasattr(o, "tolist"):
        return o.tolist()
    if hasattr(o, "__dict__"):
        return o.__dict__
    raise TypeError(type(o))
