"""Contiguous row indexes (E1) and dense re-coding of ids.

Rows are sorted globally (range-partitioned on the whole order, so that a key
with many rows is still split by what follows it), materialised in the shared
checkpoint folder so that partition ids and positions are fixed, and numbered by
per-partition counts and offsets.  No window holds more than one row a
partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakit.session import checkpointed, written


def _offsets(counts: DataFrame, bucket: str) -> DataFrame:
    # one row a partition: one small window
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(bucket, (F.sum("n").over(w) - F.col("n")).alias("_offset"))


def row_index(df: DataFrame, key: str, index_col: str = "index",
              tiebreak: list[str] | None = None) -> DataFrame:
    """0-based contiguous index in ascending ``key`` order, nulls first.

    Rows of one key are ordered by ``tiebreak``, by default all other columns
    that have an order, so only rows that are equal throughout can swap."""
    if tiebreak is None:
        tiebreak = [f.name for f in df.schema.fields
                    if f.name != key and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return row_index_sorted(df, [F.col(key).asc_nulls_first()] + [F.col(c) for c in tiebreak], index_col)


def row_index_sorted(df: DataFrame, order: list, index_col: str = "index") -> DataFrame:
    """0-based contiguous index for an arbitrary (composite) order.

    The sorted table is checkpointed so that partition ids and positions are
    fixed; the per-partition count table is bounded by the partition count.
    """
    sorted_df = checkpointed(df.orderBy(*order))
    mid = F.monotonically_increasing_id()
    pos = sorted_df.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_pos", mid - F.shiftleft(F.col("_pid").cast("long"), 33))
    counts = pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"))
    offs = F.broadcast(_offsets(counts, "_pid"))
    return (pos.join(offs, "_pid")
            .withColumn(index_col, (F.col("_offset") + F.col("_pos")).cast("long"))
            .drop("_pid", "_pos", "_offset"))


def dense_codes(ids: DataFrame, id_col: str, code_col: str = "code") -> DataFrame:
    """Code table ``(id, code)``: distinct non-null ids numbered 0..n-1
    ascending (E2).  The distinct ids are computed once."""
    distinct = checkpointed(ids.select(id_col).where(F.col(id_col).isNotNull()).distinct())
    return row_index(distinct, id_col, code_col)


def numbered_blocks(df: DataFrame, key: str, code_col: str = "code") -> DataFrame:
    """``df``, one row a key and without null keys, with the codes that
    ``dense_codes`` gives its keys.  ``_block`` holds ascending ranges of the
    key, each in one partition: a key's place in its block and the sizes of the
    blocks before make its code, so rows are not joined to codes.  The table is
    written, for its blocks are read for their sizes first."""
    place = F.row_number().over(Window.partitionBy("_block").orderBy(key)) - 1
    table = written(df.withColumn("_pos", place), "numbered")
    offs = F.broadcast(_offsets(table.groupBy("_block").agg(F.count(F.lit(1)).alias("n")), "_block"))
    return (table.join(offs, "_block").withColumn(code_col, (F.col("_offset") + F.col("_pos")).cast("long"))
            .drop("_block", "_pos", "_offset"))


def recode(df: DataFrame, id_col: str, codes: DataFrame, code_col: str = "code",
           out_col: str | None = None, dropped: Observation | None = None) -> DataFrame:
    """Replace ``id_col`` by its dense code (C10); rows whose id has no code
    are dropped (inner join, quirk Q17).  ``dropped`` counts them in the same
    pass: after an action ``dropped.get`` has ``without_code``."""
    out = out_col or id_col
    c = codes.select(F.col(id_col).alias("_rid"), F.col(code_col).alias("_code"))
    j = df.join(c, df[id_col] == c["_rid"], "inner" if dropped is None else "left")
    if dropped is not None:
        j = j.observe(dropped, F.count_if(F.col("_code").isNull()).alias("without_code")).where(F.col("_code").isNotNull())
    return j.drop("_rid").drop(id_col).withColumnRenamed("_code", out)


def explode_range(df: DataFrame, count_col: str, out_col: str, block: int = 4096,
                  spread_cols: list[str] | None = None) -> DataFrame:
    """Rows ``0..count-1`` for every input row, generated in two levels.

    A row with a huge count would otherwise emit all its rows from one task;
    here it first emits ``ceil(count / block)`` block rows, which are spread
    over a fixed number of partitions (not coalesced by AQE), and each block
    then emits at most ``block`` ids."""
    spark = df.sparkSession
    n_part = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n = F.col(count_col).cast("long")
    blocks = (df.where(n > 0)
              .withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.floor((n - 1) / F.lit(block)).cast("long")))))
    keys = [F.col(c) for c in (spread_cols or [])] + [F.col("_blk")]
    blocks = blocks.repartition(n_part, *keys)
    lo = F.col("_blk") * F.lit(block)
    hi = F.least(lo + F.lit(block), n) - 1
    return (blocks.withColumn(out_col, F.explode(F.sequence(lo, hi)))
            .drop("_blk"))
