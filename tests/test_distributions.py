"""Distribution and property tests for the random and scaling operators."""

from pyspark.sql import functions as F

from stratakit.functions.rand import bernoulli, normal
from stratakit.operators.copula import fit_copula, sample_copula
from stratakit.operators.index import dense_codes
from stratakit.operators.responses import weighted_ensemble
from stratakit.operators.strata import standardise
from stratakit.sources import tables as t
from tests.conftest import SF01


def test_bernoulli_share_is_one_minus_theta(spark):
    df = spark.range(200_000)
    for theta in (0.0, 0.8, 1.0):
        share = df.select(F.avg(bernoulli(9, theta, "id"))).first()[0]
        assert abs(share - (1 - theta)) < 0.005, (theta, share)


def test_normal_moments(spark):
    m = spark.range(200_000).select(normal(5, "id").alias("z")).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(m[0]) < 0.01 and abs(m[1] - 1) < 0.01


def test_ensemble_golden(spark):
    df = spark.range(1)
    comps = [F.lit(1.0), F.lit(0.0), F.lit(4.0)]
    assert df.select(weighted_ensemble(comps, [0, 0, 1])).first()[0] == 4.0
    assert df.select(weighted_ensemble(comps, [1, 1, 2])).first()[0] == 2.25


def test_standardise_moments(spark):
    c = t.read(spark, SF01, "customer").select("c_acctbal", "c_nationkey")
    z = standardise(c, ["c_acctbal", "c_nationkey"])
    r = z.agg(F.avg("c_acctbal"), F.stddev_pop("c_acctbal"), F.avg("c_nationkey"), F.stddev_pop("c_nationkey")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9 and abs(r[2]) < 1e-9 and abs(r[3] - 1) < 1e-9
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [row[0] for row in standardise(const, ["x"]).collect()] == [0.0, 0.0]


def test_recode_is_bijection(spark):
    h = t.history(spark, SF01)
    codes = dense_codes(h, "user_id")
    n = h.select("user_id").distinct().count()
    agg = codes.agg(F.min("code"), F.max("code"), F.countDistinct("code"), F.countDistinct("user_id")).first()
    assert (agg[0], agg[1], agg[2], agg[3]) == (0, n - 1, n, n)


def test_copula_marginals_and_correlation(spark):
    users = t.users(spark, SF01)
    model = fit_copula(users, ["acctbal", "nationkey"], ["segment"])
    gen = sample_copula(spark, model, 20_000, 3)
    real_q = users.select(F.percentile_approx("acctbal", [0.1, 0.5, 0.9], 10_000)).first()[0]
    gen_q = gen.select(F.percentile_approx("acctbal", [0.1, 0.5, 0.9], 10_000)).first()[0]
    spread = real_q[2] - real_q[0]
    assert all(abs(a - b) < 0.05 * spread for a, b in zip(real_q, gen_q)), (real_q, gen_q)
    shares_real = {r[0]: r[1] for r in users.groupBy("segment").count().collect()}
    n_real = sum(shares_real.values())
    shares_gen = {r[0]: r[1] for r in gen.groupBy("segment").count().collect()}
    for s, c in shares_real.items():
        assert abs(shares_gen.get(s, 0) / 20_000 - c / n_real) < 0.02
    assert gen.select(F.min("nationkey"), F.max("nationkey")).first() == \
        users.select(F.min("nationkey"), F.max("nationkey")).first()


def test_exact_quantiles_match_numpy_with_a_hot_value(spark):
    import numpy as np
    from stratakit.operators.strata import exact_quantiles
    rng = np.random.default_rng(1)
    vals = np.concatenate([np.full(3000, 7.0), rng.normal(0, 10, 6000), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    qs = [0.0, 0.01, 0.25, 0.3333, 0.5, 0.75, 0.999, 1.0]
    got = {r["q"]: r["value"] for r in exact_quantiles(df, "x", qs, buckets=64, bin_rows=100).collect()}
    want = np.quantile(vals, qs)
    for q, w in zip(qs, want):
        assert abs(got[q] - w) <= 1e-9 * max(1.0, abs(w)), (q, got[q], w)
