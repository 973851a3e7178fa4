"""Population pools: real rows plus generated rows under shifted keys
(I1 B1 B3 D1 D2 G1), and the empty typed log (A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYNTH = "__is_synth"
CLUSTER = "__cluster"
STRATUM = "__stratum"
GEN_INDEX = "row_index"


def next_key(df: DataFrame | None, key: str) -> Column:
    """``max(key) + 1``, 0 for an empty or missing table, as a scalar
    subquery (evaluated once inside the plan, no driver collect)."""
    if df is None:
        return F.lit(0).cast("long")
    return df.select(F.coalesce(F.max(key) + 1, F.lit(0)).cast("long")).scalar()


def tag_origin(df: DataFrame, synth: int, cluster: int | None, stratum: str | None) -> DataFrame:
    """B1: constant bookkeeping columns."""
    cols = {SYNTH: F.lit(synth).cast("int")}
    if cluster is not None:
        cols[CLUSTER] = F.lit(cluster).cast("int")
    if stratum is not None:
        cols[STRATUM] = F.lit(stratum)
    return df.withColumns(cols)


def augment_pool(real: DataFrame | None, generated: dict, key: str, with_cluster: bool = True,
                 fill_missing: bool = False, spark: SparkSession | None = None) -> DataFrame:
    """Real rows (flag 0, stratum 0) followed by the rows of every named
    generator (flag 1, stratum i in dict order) under contiguous new keys.

    Each generated frame carries a contiguous 0-based ``row_index`` (what
    ``spark.range`` or :func:`stratakit.operators.index.row_index` give);
    its keys become ``offset_i + row_index`` with ``offset_1 = max(real key)+1``
    and ``offset_{i+1} = offset_i + max(row_index_i) + 1``.  Columns have to be
    the same throughout, unless ``fill_missing`` lets a missing one be null.

    An entry may also be ``(generator, n)``, see
    :mod:`stratakit.operators.generators`; ``spark`` is then needed where
    there is no real table.
    """
    parts = []
    if spark is None and real is not None:
        spark = real.sparkSession
    made = {name: g[0].generate(spark, g[1]) if isinstance(g, tuple) else g for name, g in generated.items()}
    if real is not None:
        parts.append(tag_origin(real, 0, 0 if with_cluster else None,
                                "real" if with_cluster else None))
    offset = next_key(real, key)
    for i, (name, gen) in enumerate(made.items(), start=1):
        if GEN_INDEX not in gen.columns:
            raise ValueError(f"generated frame {name!r} needs a {GEN_INDEX!r} column")
        g = (gen.withColumn(key, (offset + F.col(GEN_INDEX)).cast("long"))
             .drop(GEN_INDEX))
        parts.append(tag_origin(g, 1, i if with_cluster else None,
                                name if with_cluster else None))
        offset = offset + gen.select(F.coalesce(F.max(GEN_INDEX) + 1, F.lit(0)).cast("long")).scalar()
    if not parts:
        raise ValueError("pool is empty: no real table and no generator")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=fill_missing)
    return out


def pool_counts(pool: DataFrame) -> DataFrame:
    """Row counts per origin and stratum in one aggregate."""
    keys = [c for c in (STRATUM, SYNTH, CLUSTER) if c in pool.columns]
    return pool.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


def origin_filter(pool: DataFrame, use_synth: bool, use_real: bool) -> DataFrame:
    """Synthetic only / real only / both."""
    allowed = ([1] if use_synth else []) + ([0] if use_real else [])
    if not allowed:
        raise ValueError("at least one of use_synth / use_real must be true")
    if len(allowed) == 2:
        return pool
    return pool.where(F.col(SYNTH) == F.lit(allowed[0]))


def empty_log(spark, user_key: str = "user_id", item_key: str = "item_id",
              value_col: str = "relevance") -> DataFrame:
    """A4: empty typed history, key names taken from the configuration (Q3)."""
    schema = T.StructType([
        T.StructField(user_key, T.LongType(), True),
        T.StructField(item_key, T.LongType(), True),
        T.StructField(value_col, T.DoubleType(), True),
        T.StructField("timestamp", T.LongType(), True),
    ])
    return spark.createDataFrame([], schema)
