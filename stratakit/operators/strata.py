"""Strata: exact quantiles, quantile buckets, standardisation, and subsets of
users chosen by strata (D15 D16 H10 I11 I12 I13)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakit.operators.index import dense_codes, recode
from stratakit.session import local_table


def _check_quantiles(qs):
    if any(q < 0 or q > 1 for q in qs):
        raise ValueError("quantiles must lie in [0, 1]")
    if len(set(qs)) != len(qs):
        raise ValueError("quantiles must be unique")


#: Bins of a refinement round, and rows of a bin that one task sorts.
QUANTILE_BINS, BIN_ROWS = 256, 1_000_000


def exact_quantiles(df: DataFrame, col: str, qs: list[float], buckets: int = QUANTILE_BINS,
                    bin_rows: int = BIN_ROWS) -> DataFrame:
    """Linear-interpolation quantiles (numpy's default, DuckDB's
    ``quantile_cont``), exactly, without sorting the column; nulls and NaN are
    left out.

    The two order statistics around each ``(n-1)q`` are closed in on by
    rounds.  A round reads the bins that still hold a wanted rank (at first
    one bin, everything), takes ``buckets`` approximate quantiles of each,
    cuts the bins there and counts the new ones, which says where each rank
    lies.  A bin of a single value is an answer; a bin of at most
    ``bin_rows`` rows is read as distinct-value counts and finished by a
    running count; any other goes into the next round.  Values that many rows
    share are cut off as bins of their own, so every round gets ahead.

    Returns ``(q, value)`` rows."""
    from pyspark.ml.feature import Bucketizer
    _check_quantiles(qs)
    spark = df.sparkSession
    schema = T.StructType([T.StructField("q", T.DoubleType()), T.StructField("value", T.DoubleType())])
    vals = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    inf = float("inf")

    def binned(edges: list[float]) -> DataFrame:
        if len(edges) == 2:
            return vals.withColumn("_b", F.lit(0).cast("long"))
        return (Bucketizer(splits=edges, inputCol="_v", outputCol="_b").transform(vals)
                .withColumn("_b", F.col("_b").cast("long")))

    def cut(edges: list[float], targets: list[int], aggs: list):
        got = binned(edges).where(F.col("_b").isin(targets)).groupBy("_b").agg(*aggs).collect()
        return {r["_b"]: r for r in got}

    probs = [i / buckets for i in range(1, buckets)]
    stats = [F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
             F.percentile_approx("_v", probs, 10_000).alias("p")]
    # where each wanted rank lies: (from, to) of its bin and the rows below it
    first = vals.agg(*stats).first()
    n = first["n"]
    if not n:
        return local_table(spark, [(float(q), None) for q in qs], schema)
    plan = [(q, (n - 1) * q, math.floor((n - 1) * q), math.ceil((n - 1) * q)) for q in qs]
    open_ranks = {r: (-inf, inf, 0) for _, _, lo, hi in plan for r in (lo, hi)}
    known, small = {}, {}
    seen = {(-inf, inf): first}
    while open_ranks:
        # close what one value or few rows answer; split the rest
        splits = set()
        for rank, (lo, hi, below) in list(open_ranks.items()):
            r = seen[lo, hi]
            if r["lo"] == r["hi"]:
                known[rank] = r["lo"]
                del open_ranks[rank]
            elif r["n"] <= bin_rows:
                small[rank] = (lo, hi, below)
                del open_ranks[rank]
            else:
                p = [r["lo"], *r["p"], r["hi"]]
                splits |= {lo, hi, *p}
                splits |= {math.nextafter(x, inf) for x, y in zip(p, p[1:]) if x == y}
                splits |= {math.nextafter(r["lo"], inf)}
        if not open_ranks:
            break
        edges = sorted(splits | {-inf, inf})
        at = {e: i for i, e in enumerate(edges)}
        wanted = sorted({b for lo, hi, _ in open_ranks.values() for b in range(at[lo], at[hi])})
        counts = cut(edges, wanted, [F.count(F.lit(1)).alias("n")])
        for rank, (lo, hi, below) in open_ranks.items():
            for b in range(at[lo], at[hi]):
                here = counts[b]["n"] if b in counts else 0
                if rank < below + here:
                    open_ranks[rank] = (edges[b], edges[b + 1], below)
                    break
                below += here
        bins = sorted({(lo, hi) for lo, hi, _ in open_ranks.values()})
        got = cut(edges, [at[lo] for lo, _ in bins], stats)
        seen = {(lo, hi): got[at[lo]] for lo, hi in bins}
    if small:
        edges = sorted({-inf, inf, *(e for lo, hi, _ in small.values() for e in (lo, hi))})
        at = {e: i for i, e in enumerate(edges)}
        want = local_table(spark, [(at[lo], rank - below, rank) for rank, (lo, _, below) in small.items()],
                           T.StructType([T.StructField("_b", T.LongType()), T.StructField("_r", T.LongType()),
                                         T.StructField("_rank", T.LongType())]))
        w = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        vc = (binned(edges).where(F.col("_b").isin(sorted({at[lo] for lo, _, _ in small.values()})))
              .groupBy("_b", "_v").agg(F.count(F.lit(1)).alias("c")).withColumn("_incl", F.sum("c").over(w)))
        hit = (vc.join(F.broadcast(want), "_b")                 # two ranks a quantile
               .where((F.col("_incl") - F.col("c") <= F.col("_r")) & (F.col("_r") < F.col("_incl")))
               .select("_rank", "_v").collect())
        known.update((r["_rank"], r["_v"]) for r in hit)
    rows = [(float(q), known[lo] + (h - lo) * (known[hi] - known[lo])) for q, h, lo, hi in plan]
    return local_table(spark, rows, schema)


def quantile_edges(df: DataFrame, col: str, qs: list[float], exact: bool = True,
                   accuracy: int = 100_000) -> list[float]:
    """Interior bucket edges for quantiles ``qs`` (a list of ``len(qs)`` numbers
    on the driver: a proven-size result).  ``exact=False`` uses
    ``percentile_approx`` in one aggregate pass instead of a sort."""
    qs = sorted(q for q in qs if 0.0 < q < 1.0)
    if not qs:
        return []
    if exact:
        rows = exact_quantiles(df, col, qs).collect()
        by_q = {r["q"]: r["value"] for r in rows}
        return [by_q[q] for q in qs]
    r = df.select(F.percentile_approx(F.col(col).cast("double"), qs, accuracy)).first()[0]
    return list(r)


def bucket_of(x: Column, edges: list[float]) -> Column:
    """Number of interior edges <= x.  A value on an edge goes to the
    upper bucket, the maximum to the last one; repeated edges are fine."""
    if not edges:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [(x >= F.lit(float(e))).cast("int") for e in edges]).cast("int")


def quantile_strata(df: DataFrame, col: str, quantiles: list[float] | None = None,
                    out_col: str = "stratum", exact: bool = True) -> DataFrame:
    """Bucket of ``col`` between its quantiles (default .25/.5/.75;
    Q11).  Standardising first cannot change buckets, so it is skipped."""
    qs = quantiles if quantiles is not None else [0.25, 0.5, 0.75]
    _check_quantiles(qs)
    edges = quantile_edges(df, col, qs, exact)
    return df.withColumn(out_col, bucket_of(F.col(col), edges))


def standardise(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population std; a zero std divides by 1 (as
    scikit-learn's scaler).  Moments come from one aggregate (scalar
    subqueries), the scaling is a projection."""
    stats = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)])
    out = {}
    for i, c in enumerate(cols):
        m = stats.select(f"m_{i}").scalar()
        s = stats.select(f"s_{i}").scalar()
        s = F.when((s.isNull()) | (s == 0), F.lit(1.0)).otherwise(s)
        out[c + suffix] = (F.col(c) - m) / s
    return df.withColumns(out)


def subset_by_strata(frame: DataFrame, ratings: DataFrame, key: str,
                     conditions: dict[str, list[int]]) -> tuple[DataFrame, DataFrame]:
    """I12/I13 tail: keep frame rows whose stratum columns take the chosen
    values (conjunctive, B9), keep their ratings (left-semi, C8), and re-code
    the key densely in both (E2/C10)."""
    cond = reduce(lambda a, b: a & b, [F.col(c).isin(*v) for c, v in conditions.items()])
    chosen = frame.where(cond).drop(*conditions.keys())
    r = ratings.join(chosen.select(key), key, "left_semi")
    codes = dense_codes(chosen, key)
    return recode(chosen, key, codes), recode(r, key, codes)
