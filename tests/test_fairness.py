"""Parity relabelling properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakit.operators.fairness import fit_parity, parity_relabel
from tests.conftest import SF01


def test_equal_groups_identical_probs_keep_argmax(spark):
    rows = [(g, [0.5, 0.3, 0.2]) for g in (0, 1) for _ in range(5)] + \
           [(g, [0.1, 0.7, 0.2]) for g in (0, 1) for _ in range(5)]
    df = spark.createDataFrame(rows, "grp int, probs array<double>")
    fit = fit_parity(df, "probs", "grp", 3)
    assert fit["gap"] == 0.0 and fit["lambda"] == [0.0, 0.0, 0.0]


def test_parity_gap_shrinks(spark):
    from stratakit.plans.fairness import customers_with_probs
    c = customers_with_probs(spark, SF01)
    # make group 1 favour class 0 so the plain argmax is unfair
    c = c.withColumn("probs", F.when(F.col("grp") == 1,
                                     F.array(F.col("probs")[0] + 0.3, F.col("probs")[1], F.col("probs")[2]))
                     .otherwise(F.col("probs")))
    out, fit = parity_relabel(c, "probs", "grp", 3)
    rates = out.groupBy("grp", "pred_fair").count().collect()
    n = {g: sum(r["count"] for r in rates if r["grp"] == g) for g in (0, 1)}
    share = {(r["grp"], r["pred_fair"]): r["count"] / n[r["grp"]] for r in rates}
    gap = max(abs(share.get((1, k), 0) - share.get((0, k), 0)) for k in range(3))
    assert gap <= 0.005 and abs(gap - fit["gap"]) < 1e-12, (gap, fit)


def test_unreachable_parity_is_an_error(spark):
    rows = [(1, [0.9, 0.1])] * 40 + [(0, [0.1, 0.9])] * 40       # one atom a group
    df = spark.createDataFrame(rows, "grp int, probs array<double>")
    with pytest.raises(RuntimeError, match="class rates differ"):
        fit_parity(df, "probs", "grp", 2)
    assert fit_parity(df, "probs", "grp", 2, strict=False)["gap"] == 1.0


def test_null_group_keeps_argmax_and_counts_for_no_rate(spark):
    c = [(1, [0.6, 0.4])] * 10 + [(0, [0.6, 0.4])] * 10 + [(None, [0.2, 0.8])] * 30
    out, fit = parity_relabel(spark.createDataFrame(c, "grp int, probs array<double>"), "probs", "grp", 2)
    assert fit["gap"] == 0 and {r["pred_fair"] for r in out.where("grp is null").collect()} == {1}


def test_parity_fit_starts_few_jobs(spark):
    from stratakit.plans.fairness import customers_with_probs
    c = customers_with_probs(spark, SF01)
    spark.sparkContext.setJobGroup("parity", "fit")
    try:
        fit_parity(c, "probs", "grp", 3)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("parity")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert 0 < len(jobs) <= 5


def test_replicate_samples_sizes_and_uniformity(spark):
    from stratakit.operators.fairness import replicate_samples
    df = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("int").alias("g"))
    rows = replicate_samples(df, "id", "g", None, 5).collect()
    by = {}
    for r in rows:
        by.setdefault((r["rep"], r["g"]), []).append(r["id"])
    assert len(by) == 2 * 50 * 20 and all(len(v) == len(set(v)) == (5 if g else 15) for (_, g), v in by.items())
    hits = [0] * 400
    for r in rows:
        hits[r["id"]] += 1
    assert all(abs(n - 50) < 6 * 50 ** 0.5 for n in hits)        # each row is in 1 of 20 replicates


def _rates(rows, col):
    n = {g: sum(r["grp"] == g for r in rows) for g in (0, 1)}
    return {g: [sum(r["grp"] == g and r[col] == c for r in rows) / n[g] for c in range(3)] for g in (0, 1)}


@pytest.mark.parametrize("sizes", [(40, 40), (101, 37), (1, 5)])
def test_tied_rows_are_split_until_rates_agree(spark, sizes):
    from stratakit.operators.fairness import apply_primal, exact_parity
    rows = [(i, 1, [0.9, 0.06, 0.04]) for i in range(sizes[0])] + [(1000 + i, 0, [0.1, 0.5, 0.4]) for i in range(sizes[1])]
    df = spark.createDataFrame(rows + [(5000, None, [0.2, 0.1, 0.7])], "id long, grp int, probs array<double>")
    out, fit = exact_parity(df, "probs", "grp", 3, ["id"], 7)
    got = out.collect()
    rates = _rates(got, "pred_fair")
    gap = max(abs(a - b) for a, b in zip(*rates.values()))
    assert gap <= 2 / min(sizes) + 1e-12 and abs(gap - fit["gap"]) < 1e-9
    assert [r["pred_fair"] for r in got if r["grp"] is None] == [2] and out.columns == df.columns + ["pred_fair"]
    again = apply_primal(df.repartition(7), fit, "probs", "grp", 3, ["id"], 7).collect()
    assert {tuple(r[:2]) + (r["pred_fair"],) for r in again} == {tuple(r[:2]) + (r["pred_fair"],) for r in got}


def test_flows_and_targets():
    from stratakit.operators.fairness import parity_flows, parity_targets
    assert parity_targets({True: [7, 0, 0], False: [0, 2, 1]}) == {True: [5, 1, 1], False: [2, 1, 0]}
    assert parity_flows([5, 0, 4], [2, 6, 1]) == [(0, 1, 3), (2, 1, 3)]
    assert parity_flows([9, 0, 0], [4, 3, 2]) == [(0, 1, 3), (0, 2, 2)] and parity_flows([1, 2], [1, 2]) == []


def test_empty_group_moves_nothing(spark):
    from stratakit.operators.fairness import exact_parity
    df = spark.createDataFrame([(i, 1, [0.3, 0.7]) for i in range(5)], "id long, grp int, probs array<double>")
    out, fit = exact_parity(df, "probs", "grp", 2, ["id"])
    assert fit["moves"] == [] and {r["pred_fair"] for r in out.collect()} == {1}


def test_unfinished_replicate_is_an_error(spark):
    from stratakit.operators.fairness import replicate_rules
    rows = [(0, 1, i, [0.9, 0.1]) for i in range(40)] + [(0, 0, 40 + i, [0.1, 0.9]) for i in range(40)]
    df = spark.createDataFrame(rows, "rep long, grp int, id long, probs array<double>")
    with pytest.raises(Exception, match="class rates differ"):
        replicate_rules(df.select("rep", "grp", "id"), df.select("id", "grp", "probs"), "id", "grp", "probs", 2).collect()


def test_replicate_draws_are_not_sorted(spark):
    """A replicate draws inside its row; only the chosen rows are shuffled, and no task sorts them."""
    from stratakit.operators.fairness import draw_index, replicate_samples
    df = spark.range(30).select("id", F.when(F.col("id") < 20, F.col("id") % 2).cast("int").alias("g"))
    out = replicate_samples(df, "id", "g", 40, 5, per_replicate=20)            # 6 of 10 rows: draws repeat often
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "strategy=shuffle_hash" in plan
    draws = spark.range(40).selectExpr("id AS rep", "explode(sequence(0, 75)) AS j", "array(0, 1) AS gs").selectExpr(
        "rep", "j", "explode(gs) AS g").select("rep", "g", "j", draw_index(F.lit(10), 5, F.lit("d"), "rep", "g", F.col("j").cast("long")).alias("i"))
    want = {}
    for r in sorted(draws.collect(), key=lambda r: r["j"]):
        own = want.setdefault((r["rep"], r["g"]), [])
        if len(own) < 6 and r["i"] not in own:
            own.append(r["i"])
    got = {}
    for r in out.collect():
        got.setdefault((r["rep"], r["g"]), set()).add((r["id"] - r["g"]) // 2)
    assert got == {k: set(v) for k, v in want.items()}


def test_votes_equal_each_rule_by_itself():
    """All rules' votes, also for rows on a border, where classes tie, and for odd numbers."""
    from stratakit.operators import fairness as f
    rng = np.random.default_rng(3)
    for k, n in ((2, 10), (3, 1000), (4, 300)):
        p = np.round(rng.dirichlet(np.ones(k), 500), 1)
        p[3, 0], p[4] = np.nan, -np.inf
        lam, pi = np.round(rng.normal(0, 0.1, (n, k)), 1), rng.choice([0.5, 0.25], n)
        lam[5:9] = lam[5]
        for in_a in (True, False):
            shifts = (-lam if in_a else lam) / pi[:, None]
            cls = np.argmax(p[:, None, :] + shifts[None], axis=2)
            want = np.stack([(cls == c).sum(axis=1) for c in range(k)], axis=1)
            assert (f._votes(p, lam, in_a, pi) == want).all()


def test_vote_takes_chunks_and_keys_as_they_come(spark, monkeypatch):
    """Rows without a group or probabilities, repeated keys and several blocks."""
    from stratakit.operators import fairness as f
    monkeypatch.setattr(f, "RULES_A_BLOCK", 3)
    rules = spark.createDataFrame([(i, [0.1 * i, -0.05 * i], 0.5, 0.5) for i in range(8)],
                                  "rep long, lam array<double>, pi_a double, pi_b double")
    rows = [("a", 1, [0.7, 0.3]), ("b", 0, [0.3, 0.7]), ("c", None, [0.4, 0.6]), ("d", 1, [0.9, 0.1]), ("d", 1, [0.1, 0.9]),
            ("e", 0, None), (None, 1, [0.5, 0.5]), ("f", 1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "id string, g int, p array<double>")
    got = f.vote_relabel(df, "id", "p", "g", rules, 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and got.columns == ["id", "g", "p", "pred_vote"]
    votes = {}
    for key, g, p in rows:
        own = votes.setdefault(key, [0, 0])
        for i in range(8):
            s = {1: -2.0, 0: 2.0, None: 0.0}[g]
            a, b = (x + s * y for x, y in zip(p or [-math.inf] * 2, (0.1 * i, -0.05 * i)))
            own[int(b > a)] += 1
    assert sorted((r["id"], r["pred_vote"]) for r in got.collect()) == sorted(
        (key, int(votes[key][1] > votes[key][0])) for key, _, _ in rows if key is not None)
