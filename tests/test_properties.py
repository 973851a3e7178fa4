"""Hypothesis property tests: the distributed operators equal their simple
definitions on random inputs (few examples; each runs Spark jobs)."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakit.functions.rand import hash32
from stratakit.operators.sampling import exact_sample
from stratakit.operators.strata import exact_quantiles
from stratakit.session import local_table

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@SLOW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10**6)), min_size=1, max_size=300, unique_by=lambda x: x[1]),
       st.dictionaries(st.integers(0, 3), st.integers(-1, 40), min_size=1, max_size=4),
       st.integers(1, 6))
def test_exact_sample_equals_window_definition(spark, rows, quotas, bits):
    df = spark.createDataFrame(rows, "s int, k long")
    sizes = {}
    for s, _ in rows:
        sizes[s] = sizes.get(s, 0) + 1
    quotas = {s: (q if q == -1 else min(q, sizes.get(s, 0))) for s, q in quotas.items()}
    got = sorted(r["k"] for r in exact_sample(df, quotas, ["k"], 7, stratum_col="s", bits=bits).collect())
    w = Window.partitionBy("s").orderBy(hash32(7, "k"), "k")
    ranked = df.withColumn("rn", F.row_number().over(w)).collect()
    want = sorted(r["k"] for r in ranked if r["s"] in quotas and (quotas[r["s"]] == -1 or r["rn"] <= quotas[r["s"]]))
    assert got == want


@SLOW
@given(st.lists(st.one_of(st.floats(-1e6, 1e6, allow_nan=False), st.sampled_from([0.0, 5.0, 5.0, 5.0])),
                min_size=1, max_size=400),
       st.lists(st.floats(0, 1), min_size=1, max_size=6, unique=True))
def test_exact_quantiles_equal_numpy(spark, values, qs):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = {r["q"]: r["value"] for r in exact_quantiles(df, "x", qs, buckets=8, bin_rows=20).collect()}
    for q, w in zip(qs, np.quantile(np.array(values), qs)):
        assert math.isclose(got[q], w, rel_tol=1e-12, abs_tol=1e-9), (q, got[q], w)


def test_local_table_literals(spark):
    sch = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType()),
                        T.StructField("c", T.DoubleType())])
    rows = [("it's", 5, 1e-05), ("back\\slash", None, 0.1), (None, -3, float("inf")), ("x", 2**62, 1234567.123456789)]
    assert [tuple(r) for r in local_table(spark, rows, sch).collect()] == rows
