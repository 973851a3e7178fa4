"""Gaussian-copula table generator fitted and sampled on Spark.

fit:    per numeric column a quantile grid (one ``percentile_approx`` pass),
        per categorical column its cumulative frequencies (one ``groupBy``);
        rows -> normal scores -> correlation matrix (MLlib ``Correlation``).
sample: ``spark.range(n)``; independent normals from the seeded uniform,
        mixed by the Cholesky factor, mapped back through the marginals.
Grids and the d x d matrix live on the driver; frequencies stay a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.functions.rand import inv_norm_cdf, norm_cdf, normal

EPS = 1e-6
#: Cells that the unit interval is cut into to find a drawn value's category.
SPAN_CELLS = 4096


@dataclass
class CopulaModel:
    numeric: dict[str, list[float]] = field(default_factory=dict)     # column -> grid
    categorical: dict[str, DataFrame] = field(default_factory=dict)   # column -> (value, lo, hi)
    columns: list[str] = field(default_factory=list)
    chol: list[list[float]] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)


def _grid_u(x: Column, grid: list[float]) -> Column:
    """Empirical CDF by linear interpolation on the quantile grid."""
    g = F.array(*[F.lit(float(v)) for v in grid])
    m = len(grid) - 1
    k = F.size(F.filter(g, lambda v: v <= x))  # 0..m+1
    lo = F.element_at(g, F.greatest(k, F.lit(1)))
    hi = F.element_at(g, F.least(k + 1, F.lit(m + 1)))
    frac = F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.5))
    u = (F.greatest(k - 1, F.lit(0)).cast("double") + frac) / F.lit(float(m))
    return F.when(k == 0, F.lit(EPS)).when(k > m, F.lit(1 - EPS)).otherwise(u)


def _grid_inverse(u: Column, grid: list[float]) -> Column:
    g = F.array(*[F.lit(float(v)) for v in grid])
    m = len(grid) - 1
    pos = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * F.lit(float(m))
    k = F.least(F.floor(pos).cast("int"), F.lit(m - 1))
    frac = pos - k
    lo = F.element_at(g, k + 1)
    hi = F.element_at(g, k + 2)
    return lo + frac * (hi - lo)


def frequency_spans(df: DataFrame, col: str) -> DataFrame:
    """(value, lo, hi): each value's stretch of the unit interval, in the
    values' order, as long as its frequency.  A table of any size, written to
    the shared folder; offsets come from the sorted table's partitions."""
    from stratakit.operators.index import row_index_sorted
    from stratakit.session import checkpointed
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    indexed = row_index_sorted(counts, [F.col("value").asc_nulls_first()], "i")
    # running sums on two levels, by blocks of the index
    block = F.floor(F.col("i") / F.lit(100_000)).cast("long")
    run = Window.partitionBy("_b").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = indexed.withColumn("_b", block).withColumn("_s", F.sum("n").over(run))
    sums = inside.groupBy("_b").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    total = counts.select(F.sum("n").cast("double")).scalar()
    end = (F.col("_before") + F.col("_s")).cast("double")
    return checkpointed(inside.join(sums, "_b").select(
        "value", ((end - F.col("n")) / total).alias("lo"), (end / total).alias("hi")))


def _clip(u: Column) -> Column:
    return F.least(F.greatest(u, F.lit(EPS)), F.lit(1 - EPS))


def fit_copula(df: DataFrame, numeric: list[str], categorical: list[str] | None = None,
               grid_points: int = 101, accuracy: int = 100_000, exact: bool = False) -> CopulaModel:
    """Fit marginals and the normal-score correlation.  ``exact`` takes the
    quantile grid from a distributed sort per column (exact, repeatable);
    the default is one ``percentile_approx`` pass for all columns."""
    categorical = categorical or []
    model = CopulaModel(columns=list(numeric) + list(categorical))
    probs = [i / (grid_points - 1) for i in range(grid_points)]
    if numeric and exact:
        from stratakit.operators.strata import exact_quantiles
        for c in numeric:
            rows = exact_quantiles(df, c, probs).collect()
            by_q = {r["q"]: r["value"] for r in rows}
            model.numeric[c] = [float(by_q[q]) for q in probs]
            model.types[c] = df.schema[c].dataType.simpleString()
    elif numeric:
        row = df.select(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c)
                          for c in numeric]).first()
        for c in numeric:
            model.numeric[c] = [float(v) for v in row[c]]
            model.types[c] = df.schema[c].dataType.simpleString()
    for c in categorical:
        model.categorical[c] = frequency_spans(df, c)
        model.types[c] = df.schema[c].dataType.simpleString()
    scores = []
    for c in numeric:
        scores.append(inv_norm_cdf(_clip(_grid_u(F.col(c).cast("double"), model.numeric[c]))).alias(f"_z_{c}"))
    rows = df
    for c in categorical:
        spans = model.categorical[c].select(F.col("value").alias(f"_v_{c}"),
                                            ((F.col("lo") + F.col("hi")) / 2.0).alias(f"_m_{c}"))
        rows = rows.join(spans, F.col(c).eqNullSafe(F.col(f"_v_{c}")))
        scores.append(inv_norm_cdf(_clip(F.col(f"_m_{c}"))).alias(f"_z_{c}"))
    z = rows.select(*scores).na.drop()
    d = len(model.columns)
    if d == 1:
        corr = np.ones((1, 1))
    else:
        vec = VectorAssembler(inputCols=[f"_z_{c}" for c in model.columns], outputCol="_zv").transform(z)
        corr = Correlation.corr(vec, "_zv").first()[0].toArray()
        corr = np.nan_to_num(corr, nan=0.0)
        np.fill_diagonal(corr, 1.0)
    # nearest positive-definite repair, only when an eigenvalue is (nearly)
    # non-positive
    w, v = np.linalg.eigh(corr)
    if w.min() < 1e-9:
        corr = (v * np.clip(w, 1e-9, None)) @ v.T
    model.chol = np.linalg.cholesky(corr).tolist()
    return model


def sample_copula(spark: SparkSession, model: CopulaModel, n: int, seed: int,
                  index_col: str = "row_index", num_partitions: int | None = None) -> DataFrame:
    """``n`` generated rows with a contiguous 0-based ``row_index`` (ready for
    :func:`stratakit.operators.pools.augment_pool`)."""
    if n < 1:
        raise ValueError(f"the number of rows to generate has to be 1 or more, not {n}")
    base = spark.range(0, n, numPartitions=num_partitions).withColumnRenamed("id", index_col)
    d = len(model.columns)
    zs = [normal(seed, F.col(index_col), F.lit(j)) for j in range(d)]
    out, looked_up = [], []
    for i, c in enumerate(model.columns):
        mixed = F.lit(0.0)
        for j in range(i + 1):
            if model.chol[i][j] != 0.0:
                mixed = mixed + F.lit(model.chol[i][j]) * zs[j]
        u = norm_cdf(mixed)
        if c in model.numeric:
            val = _grid_inverse(u, model.numeric[c])
            if model.types[c] in ("int", "bigint", "smallint", "tinyint"):
                val = F.round(val).cast(model.types[c])
            out.append(val.alias(c))
        else:
            looked_up.append(c)
            out.append(u.alias(f"_u_{c}"))
    rows = base.select(index_col, *out)
    cell = lambda u: F.least(F.floor(u * SPAN_CELLS), F.lit(SPAN_CELLS - 1)).cast("int")     # noqa: E731
    for c in looked_up:
        # A range join as an equality join on cells: a stretch goes to every
        # cell it touches, of which the long ones have many and the short ones
        # one or two, so the table grows by SPAN_CELLS rows at most.
        spans = model.categorical[c]
        top = spans.select(F.max("hi")).scalar()
        spans = (spans.select(F.col("value").alias(c), "lo", F.when(F.col("hi") >= top, F.lit(2.0)).otherwise(F.col("hi")).alias("hi"))
                 .withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.least(F.col("hi"), F.lit(1.0)))))))
        u = F.col(f"_u_{c}")
        rows = (rows.withColumn("_cell", cell(u)).join(spans, "_cell")
                .where((u >= F.col("lo")) & (u < F.col("hi"))).drop("_cell", "lo", "hi", f"_u_{c}"))
    return rows.select(index_col, *model.columns)
