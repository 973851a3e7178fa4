"""Generators of rows: objects with ``fit`` and ``generate``.

``fit(df)`` learns from real rows and returns the generator; ``generate(spark,
n)`` gives ``n`` rows with a contiguous 0-based ``row_index``.
:func:`stratakit.operators.pools.augment_pool` takes such an object with the
number of rows to make, ``{"name": (generator, n)}``, beside finished tables.
A generator of one's own only needs ``generate``."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.functions.rand import draw_index
from stratakit.operators.copula import CopulaModel, fit_copula, sample_copula
from stratakit.operators.index import row_index_sorted
from stratakit.session import checkpointed


class Generator(Protocol):
    def generate(self, spark: SparkSession, n: int) -> DataFrame: ...


@dataclass
class CopulaGenerator:
    """I7 as a generator."""
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    seed: int = 42
    grid_points: int = 101
    exact: bool = False
    model: CopulaModel | None = None

    def fit(self, df: DataFrame) -> "CopulaGenerator":
        self.model = fit_copula(df, self.numeric, self.categorical, self.grid_points, exact=self.exact)
        return self

    def generate(self, spark: SparkSession, n: int) -> DataFrame:
        if self.model is None:
            raise ValueError("the generator has not been fitted")
        return sample_copula(spark, self.model, n, self.seed)


@dataclass
class ResamplingGenerator:
    """Rows drawn from the real ones with replacement (a bootstrap), by a
    keyed draw of a place in the order of ``keys``: an equi-join on the place,
    so no task holds more than its share."""
    keys: list[str]
    columns: list[str]
    seed: int = 42
    rows: DataFrame | None = None

    def fit(self, df: DataFrame) -> "ResamplingGenerator":
        self.rows = checkpointed(row_index_sorted(df.select(*dict.fromkeys([*self.keys, *self.columns])), self.keys, "_place")
                                 .select("_place", *self.columns))
        return self

    def generate(self, spark: SparkSession, n: int) -> DataFrame:
        if self.rows is None or self.rows.isEmpty():
            raise ValueError("the generator has not been fitted, or on no rows")
        size = self.rows.select(F.count(F.lit(1)).alias("_size")).scalar()
        drawn = spark.range(n).withColumnRenamed("id", "row_index").withColumn("_size", size)
        drawn = drawn.withColumn("_place", draw_index(F.col("_size"), self.seed, F.lit("g"), "row_index")).drop("_size")
        return drawn.join(self.rows, "_place").select("row_index", *self.columns)
