"""Random ordering, exact-size stratified samples, candidates and splits
(F1-F4, F6, F8, E4, G2).

Exact-size sampling without replacement picks, per stratum, the ``n`` rows with
the smallest ``(hash32(seed, key), key)``.  Instead of sorting a stratum (a hot
stratum would land in one task) it works in two passes:

1. a histogram of ``bin = hash32 >> (32 - bits)`` per stratum (partial
   aggregation, at most ``strata * 2**bits`` rows after the shuffle);
2. a running count over the bins of each stratum finds the bin where the quota
   is reached.  Rows in lower bins are taken with no shuffle at all; only the
   rows of that one boundary bin (about ``N_s / 2**bits``) are ranked.

The result equals ``row_number() OVER (PARTITION BY stratum ORDER BY hash32,
key) <= quota``, which is also the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakit.functions.rand import U, draw_index, hash32
from stratakit.session import local_table, parameter_broadcast

ALL = -1


def random_order(df: DataFrame, key_cols: list[str], seed: int) -> DataFrame:
    """shuffle rows repeatably (global sort on (U, key)). Use only where an
    order is really needed."""
    return df.orderBy(U(seed, *key_cols), *key_cols)


def _quota_table(spark, stratum_col, quotas: dict, stype) -> DataFrame:
    schema = T.StructType([T.StructField(stratum_col, stype, True),
                           T.StructField("_quota", T.LongType(), True)])
    rows = [(s, None if q == ALL else int(q)) for s, q in quotas.items()]
    return local_table(spark, rows, schema)


def exact_sample(df: DataFrame, quotas: dict, key_cols: list[str], seed: int,
                 stratum_col: str | None = None, bits: int = 16,
                 validate: bool = True) -> DataFrame:
    """Exactly ``quotas[s]`` rows of every stratum ``s`` (``-1`` = all).

    Strata missing from ``quotas`` contribute nothing.  With ``validate`` a
    quota larger than its stratum raises at run time (B10).
    """
    for s, q in quotas.items():
        if q != ALL and q < 0:
            raise ValueError(f"quota for {s!r} must be >= 0 or -1")
    cols = df.columns
    spark = df.sparkSession
    single = stratum_col is None
    if single:
        stratum_col = "_stratum"
        df = df.withColumn(stratum_col, F.lit(0))
        quotas = {0: list(quotas.values())[0]}
    stype = df.schema[stratum_col].dataType
    qt = parameter_broadcast(_quota_table(spark, stratum_col, quotas, stype), len(quotas))

    h = hash32(seed, *key_cols)
    tagged = (df.join(qt, stratum_col)
              .withColumn("_h", h)
              .withColumn("_bin", F.shiftright(F.col("_h"), 32 - bits)))

    hist = tagged.groupBy(stratum_col, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy(stratum_col).orderBy("_bin")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = (hist.withColumn("_incl", F.sum("_n").over(w))
           .withColumn("_excl", F.col("_incl") - F.col("_n")))
    totals = cum.groupBy(stratum_col).agg(F.max("_incl").alias("_total"))
    checked = qt.join(totals, stratum_col, "left").fillna(0, ["_total"])
    if validate:
        checked = checked.where(
            F.when(F.col("_quota") > F.col("_total"),
                   F.raise_error(F.concat(F.lit("quota larger than stratum "),
                                          F.col(stratum_col).cast("string"))))
            .otherwise(F.lit(True)))
    checked = checked.drop("_quota")
    cut = (cum.join(qt, stratum_col)
           .where((F.col("_excl") < F.col("_quota")) & (F.col("_incl") >= F.col("_quota")))
           .select(stratum_col, F.col("_bin").alias("_cut"),
                   (F.col("_quota") - F.col("_excl")).alias("_need")))
    cut = checked.join(cut, stratum_col, "left").select(stratum_col, "_cut", "_need", "_total")
    # one row per quota entry: a proven bound
    cut = parameter_broadcast(cut, len(quotas))

    j = tagged.join(cut, stratum_col)
    take_all = F.col("_quota").isNull() | (F.col("_quota") >= F.col("_total"))
    below = j.where(take_all | (F.col("_bin") < F.col("_cut")))
    edge = j.where(~take_all & (F.col("_bin") == F.col("_cut")))
    rank_w = Window.partitionBy(stratum_col).orderBy("_h", *key_cols)
    edge = edge.withColumn("_rn", F.row_number().over(rank_w)).where(F.col("_rn") <= F.col("_need"))
    out = below.select(*cols).unionByName(edge.select(*cols))
    return out


def top_random(df: DataFrame, k: int, key_cols: list[str], seed: int) -> DataFrame:
    """``k`` random rows shared by everyone, as an exact sample (hash bins,
    one ranked boundary bin) for any ``k``; all rows if there are no more."""
    if k == ALL:
        return df
    return exact_sample(df, {0: k}, key_cols, seed, validate=False)


def stratum_sample(pool: DataFrame, num_synth: dict, num_real: int, key: str, seed: int,
                   cluster_col: str = "__cluster", synth_col: str = "__is_synth",
                   name_col: str = "__stratum") -> DataFrame:
    """F2 as in the reference's ``sample_users``: ``num_real`` real rows
    (stratum 0) plus ``num_synth[name]`` rows of each generator; ``-1`` means
    all.  Bookkeeping columns are dropped (B2)."""
    quotas = {"real": num_real}
    quotas.update(num_synth)
    out = exact_sample(pool, quotas, [key], seed, stratum_col=name_col)
    return out.drop(synth_col, cluster_col, name_col)


def candidate_items(items: DataFrame, num_synth: int, num_real: int, key: str, seed: int,
                    synth_col: str = "__is_synth") -> DataFrame:
    """``num_synth`` generated plus ``num_real`` real items (-1 = all)."""
    quotas = {1: num_synth, 0: num_real}
    return exact_sample(items, quotas, [key], seed, stratum_col=synth_col).drop(synth_col)


def split_train_test(df: DataFrame, key_cols: list[str], seed: int,
                     train_share: float = 0.75, col: str = "split") -> DataFrame:
    """repeatable random split (``train`` / ``test`` flag, no shuffle)."""
    return df.withColumn(col, F.when(U(seed, *key_cols) < F.lit(train_share), F.lit("train"))
                         .otherwise(F.lit("test")))


def random_pairs(draws: DataFrame, draw_col: str, users: DataFrame, user_key: str,
                 items: DataFrame, item_key: str, seed: int) -> DataFrame:
    """F8: one random (user, item, score) triple per draw, with replacement.

    Users and items get contiguous indexes (E1); a draw picks
    ``floor(U * n)`` on each side (52-bit draws, so every row of any table can
    come) and is resolved by an equi-join."""
    from stratakit.operators.index import row_index
    ui = row_index(users.select(user_key), user_key, "_uidx")
    ii = row_index(items.select(item_key), item_key, "_iidx")
    n_u = users.select(F.count(F.lit(1))).scalar()
    n_i = items.select(F.count(F.lit(1))).scalar()
    d = draws.select(
        F.col(draw_col),
        draw_index(n_u, seed, F.lit("u"), draw_col).alias("_uidx"),
        draw_index(n_i, seed, F.lit("i"), draw_col).alias("_iidx"),
        U(seed, F.lit("s"), draw_col).alias("score"))
    return (d.join(ui, "_uidx").join(ii, "_iidx")
            .select(draw_col, user_key, item_key, "score"))
