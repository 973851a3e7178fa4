"""Accuracy by group and parity-constrained relabelling.

Relabelling solves the Lagrangian dual of the reference's linear program
(choose one class per row, maximise summed probability, equal class rates in
both groups).  The rule for a row of group g with probabilities p is

    class = argmax_c ( p_c - s_g * lambda_c / pi_g ),  s_A = +1, s_B = -1.

One aggregate reduces the table to counts and mean probabilities on a grid of
bounded size; lambda is found by subgradient steps on these cells, and one more
pass measures the class rates of the real rows under the rule.  Replicate
ensembles solve the same dual on small subsamples and vote.  Rows without a
group keep the plain argmax and count for no rate."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakit.functions.arrays import argmax, once
from stratakit.functions.rand import U, draw_index
from stratakit.session import checkpointed, local_table


def baseline_accuracy(df: DataFrame, label: str) -> DataFrame:
    """Share of the most frequent class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.agg((F.max("n") / F.sum("n")).alias("baseline_accuracy"))


def group_accuracy(df: DataFrame, pred: str, label: str, group: str,
                   groups: tuple = (0, 1)) -> DataFrame:
    """D8 + D9: overall accuracy, accuracy per group and the gap, in one
    aggregate with conditional averages."""
    hit = (F.col(pred) == F.col(label)).cast("double")
    a, b = groups
    acc_a = F.avg(F.when(F.col(group) == F.lit(a), hit))
    acc_b = F.avg(F.when(F.col(group) == F.lit(b), hit))
    return df.agg(F.count(F.lit(1)).cast("long").alias("n"), F.avg(hit).alias("accuracy"),
                  acc_a.alias(f"acc_group{a}"), acc_b.alias(f"acc_group{b}"),
                  F.abs(acc_a - acc_b).alias("gap"))


def metric_frame(df: DataFrame, pred: str, label: str, group: str) -> DataFrame:
    """Accuracy by group, then min, max, difference, ratio and the
    overall accuracy (one row)."""
    hit = (F.col(pred) == F.col(label)).cast("double")
    by = df.groupBy(group).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.min("accuracy").alias("acc_min"), F.max("accuracy").alias("acc_max"),
                  (F.max("accuracy") - F.min("accuracy")).alias("acc_difference"),
                  F.try_divide(F.min("accuracy"), F.max("accuracy")).alias("acc_ratio"),
                  (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("acc_overall"))


def fairness_metrics(test: DataFrame, baseline: Column, group: str = "grp", label: str = "label",
                     before: str = "before", after: str = "after") -> DataFrame:
    """One-row report - baseline accuracy, accuracy overall and per
    group before and after relabelling, the gaps, the gap improvement and
    the accuracy lost per group (one aggregate over the test rows)."""
    hit_b = (F.col(before) == F.col(label)).cast("double")
    hit_a = (F.col(after) == F.col(label)).cast("double")

    def by(g, h):
        return F.avg(F.when(F.col(group) == g, h))
    m = test.agg(F.avg(hit_b).alias("accuracy_before"), F.avg(hit_a).alias("accuracy_after"),
                 by(0, hit_b).alias("acc0_before"), by(1, hit_b).alias("acc1_before"),
                 by(0, hit_a).alias("acc0_after"), by(1, hit_a).alias("acc1_after"))
    gap_b = F.abs(F.col("acc0_before") - F.col("acc1_before"))
    gap_a = F.abs(F.col("acc0_after") - F.col("acc1_after"))
    return m.select(
        baseline.alias("baseline_accuracy"), "accuracy_before", "accuracy_after",
        "acc0_before", "acc1_before", "acc0_after", "acc1_after",
        gap_b.alias("gap_before"), gap_a.alias("gap_after"), (gap_b - gap_a).alias("gap_improvement"),
        (F.col("acc0_before") - F.col("acc0_after")).alias("loss_group0"),
        (F.col("acc1_before") - F.col("acc1_after")).alias("loss_group1"))


def relabel_expr(probs: Column, group: Column, lam, pi_a, pi_b, k: int | None = None, group_a=1) -> Column:
    """The dual rule as an expression (H7 argmax, lowest class on ties).
    ``lam`` is a list of numbers or an array column."""
    if isinstance(lam, Column):
        lam_at = lambda c: F.element_at(lam, c + 1)                           # noqa: E731
    else:
        k = len(lam)
        fixed = F.array(*[F.lit(float(v)) for v in lam])
        lam_at = lambda c: F.element_at(fixed, c + 1)                         # noqa: E731
    pi_a, pi_b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (pi_a, pi_b))
    adj = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.when(
        group.isNull(), probs[c]).otherwise(probs[c] + F.when(group == F.lit(group_a), -lam_at(c) / pi_a)
                                            .otherwise(lam_at(c) / pi_b)))
    return argmax(adj)


def _solve_dual(p: np.ndarray, in_a: np.ndarray, n: np.ndarray, k: int, max_iter: int, step: float,
                tol: float) -> dict:
    """Subgradient steps on rows ``p`` that stand for ``n`` rows each, until
    the largest rate gap is below ``tol`` or what single rows can move; the
    first best lambda."""
    n_a, n_b = float(n[in_a].sum()), float(n[~in_a].sum())
    if not n_a or not n_b:
        return {"lambda": [0.0] * k, "pi_a": 1.0, "pi_b": 1.0, "gap": 0.0, "iterations": 0}
    total = n_a + n_b
    pi_a, pi_b = n_a / total, n_b / total
    tol = max(tol, (k - 1) / min(n_a, n_b))
    lam, best, it = np.zeros(k), (math.inf, np.zeros(k)), 0
    for it in range(1, max_iter + 1):
        cls = np.argmax(p + np.where(in_a[:, None], -lam / pi_a, lam / pi_b), axis=1)
        rate_a = np.bincount(cls[in_a], weights=n[in_a], minlength=k) / n_a
        rate_b = np.bincount(cls[~in_a], weights=n[~in_a], minlength=k) / n_b
        diff = rate_a - rate_b
        gap = float(np.abs(diff).max())
        if gap < best[0]:
            best = (gap, lam)
        if gap < tol:
            break
        lam = lam + (step / math.sqrt(it)) * diff
    return {"lambda": best[1].tolist(), "pi_a": pi_a, "pi_b": pi_b, "gap": best[0], "iterations": it}


#: Cells of the grid, by all classes together.
GRID_CELLS = 1 << 20


def grid_side(k: int) -> int:
    """Grid steps per class, so that the cells of normalised probabilities
    stay in proportion to ``GRID_CELLS``."""
    return max(2, int(GRID_CELLS ** (1 / max(1, k - 1)) + 1e-9))


def fit_parity(df: DataFrame, probs: str, group: str, num_classes: int, group_a=1,
               max_iter: int = 2000, step: float = 0.1, tol: float = 0.005, strict: bool = True) -> dict:
    """Lambda for equal class rates between the two groups.

    Two passes over the rows: the grid aggregate, and the rates of the rule
    found.  Returns ``{"lambda", "pi_a", "pi_b", "gap", "iterations"}`` with
    the gap of the real rows.  ``strict``: a gap above ``tol`` (or above what
    ``num_classes - 1`` rows of the smaller group make, if that is more) is
    an error, not a result."""
    k, side = num_classes, grid_side(num_classes)
    p = F.col(probs).cast("array<double>")
    in_a = F.col(group) == F.lit(group_a)
    data = df.where(F.col(group).isNotNull()).select(in_a.alias("a"), *[p[c].alias(f"p{c}") for c in range(k)])
    cells = (data.groupBy("a", *[F.floor(F.col(f"p{c}") * side).alias(f"g{c}") for c in range(k)])
             .agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"p{c}").alias(f"p{c}") for c in range(k)])
             .select("a", "n", *[f"p{c}" for c in range(k)]).toPandas())       # the grid bounds its rows
    fit = _solve_dual(cells[[f"p{c}" for c in range(k)]].to_numpy(dtype=float).reshape(-1, k),
                      cells["a"].to_numpy(dtype=bool), cells["n"].to_numpy(dtype=float), k, max_iter, step, tol)
    if not fit["iterations"]:
        return fit
    cls = relabel_expr(F.array(*[f"p{c}" for c in range(k)]), F.col("a"), fit["lambda"], fit["pi_a"], fit["pi_b"],
                       group_a=True)
    rates = data.select("a", cls.alias("c")).agg(
        F.count_if("a").alias("n_a"), F.count_if(~F.col("a")).alias("n_b"),
        *[F.count_if(F.col("a") & (F.col("c") == c)).alias(f"a{c}") for c in range(k)],
        *[F.count_if(~F.col("a") & (F.col("c") == c)).alias(f"b{c}") for c in range(k)]).first()
    fit["gap"] = max(abs(rates[f"a{c}"] / rates["n_a"] - rates[f"b{c}"] / rates["n_b"]) for c in range(k))
    least = max(tol, (k - 1) / min(rates["n_a"], rates["n_b"]))
    if strict and fit["gap"] > least:
        raise RuntimeError(f"class rates differ by {fit['gap']:.4g}, more than {least:.4g}: many rows share their "
                           "probabilities, or max_iter is too small")
    return fit


def parity_relabel(df: DataFrame, probs: str, group: str, num_classes: int, group_a=1,
                   out_col: str = "pred_fair", **kw) -> tuple[DataFrame, dict]:
    fit = fit_parity(df, probs, group, num_classes, group_a, **kw)
    return (df.withColumn(out_col, relabel_expr(F.col(probs), F.col(group), fit["lambda"],
                                                fit["pi_a"], fit["pi_b"], group_a=group_a)), fit)


# ------------------------------------------------------------ primal recovery
def parity_targets(counts: dict[bool, list[int]]) -> dict[bool, list[int]]:
    """Rows a (group, class) so that both groups have the classes at the rates
    of all rows together, rounded to whole rows by largest remainders (ties to
    the lowest class): a rate is off by less than one row of its group."""
    k, total = len(next(iter(counts.values()))), sum(map(sum, counts.values()))
    both = [sum(c[i] for c in counts.values()) for i in range(k)]
    out = {}
    for g, own in counts.items():
        n = sum(own)
        floors = [n * b // total for b in both]
        left = n - sum(floors)
        up = sorted(range(k), key=lambda i: (-(n * both[i] % total), i))[:left]
        out[g] = [f + (i in up) for i, f in enumerate(floors)]
    return out


def parity_flows(have: list[int], want: list[int]) -> list[tuple[int, int, int]]:
    """(source class, target class, rows): classes with too many rows give to
    those with too few, both in ascending order."""
    more = [[i, h - w] for i, (h, w) in enumerate(zip(have, want)) if h > w]
    less = [[i, w - h] for i, (h, w) in enumerate(zip(have, want)) if w > h]
    out = []
    while more and less:
        n = min(more[0][1], less[0][1])
        out.append((more[0][0], less[0][0], n))
        for side in (more, less):
            side[0][1] -= n
            if not side[0][1]:
                side.pop(0)
    return out


def shifted_scores(probs: Column, group: Column, fit: dict, k: int, group_a=1) -> Column:
    """The scores whose argmax the dual rule takes."""
    lam = fit["lambda"]
    a, b = F.lit(float(fit["pi_a"])), F.lit(float(fit["pi_b"]))
    return F.array(*[probs[c] + F.when(group == F.lit(group_a), F.lit(-float(lam[c])) / a)
                     .otherwise(F.lit(float(lam[c])) / b) for c in range(k)])


def _moved(move: dict) -> Column:
    """Rows (_a, _c, _s, _u) that a move takes: those of the smallest regret,
    of equal regret those of the smallest draw."""
    regret = F.col("_s")[move["source"]] - F.col("_s")[move["target"]]
    return ((F.col("_a") == F.lit(move["in_a"])) & (F.col("_c") == move["source"])
            & ((regret < move["regret"]) | ((regret == move["regret"]) & (F.col("_u") <= move["draw"]))))


def recover_primal(df: DataFrame, fit: dict, probs: str, group: str, num_classes: int, keys: list[str],
                   seed: int = 0, group_a=1) -> dict:
    """``fit`` with ``moves`` and the gap that they leave: the labels of the
    linear program behind the dual.

    Where many rows share their probabilities the dual's rule can only give
    all of them one class.  The program splits them; so the rows that cost
    least (by shifted score, then by a seeded draw of ``keys``) move from
    classes that a group has too often to those it has too rarely, an exact
    count each, until both groups agree to a row.  A move is two numbers, so
    it also applies to rows that were not fitted on.

    One aggregate counts classes; each of at most 2 (classes - 1) moves sorts
    the rows of its class once to read one row."""
    from stratakit.operators.index import row_index_sorted
    k = num_classes
    rows = checkpointed(parity_rows(df.where(F.col(group).isNotNull()), fit, probs, group, k, keys, seed, group_a)
                        .select("_a", "_s", "_c", "_u"))
    found = rows.groupBy("_a", "_c").agg(F.count(F.lit(1)).alias("n")).collect()       # 2 k rows
    counts = {g: [sum(r["n"] for r in found if r["_a"] == g and r["_c"] == c) for c in range(k)] for g in (True, False)}
    moves: list[dict] = []
    if sum(counts[True]) and sum(counts[False]):
        targets = parity_targets(counts)
        for g in (True, False):
            for source, target, n in parity_flows(counts[g], targets[g]):
                mine = [m for m in moves if m["in_a"] == g and m["source"] == source]
                left = rows.where((F.col("_a") == F.lit(g)) & (F.col("_c") == source))
                for m in mine:
                    left = left.where(~_moved(m))
                ranked = row_index_sorted(left.select((F.col("_s")[source] - F.col("_s")[target]).alias("_r"), "_u"),
                                          ["_r", "_u"], "_i")
                last = ranked.where(F.col("_i") == n - 1).first()
                moves.append({"in_a": g, "source": source, "target": target, "rows": n,
                              "regret": float(last["_r"]), "draw": float(last["_u"])})
        sizes = {g: sum(c) for g, c in counts.items()}
        gap = max(abs(targets[True][c] / sizes[True] - targets[False][c] / sizes[False]) for c in range(k))
    else:
        gap = 0.0
    return {**fit, "moves": moves, "gap": gap}


def parity_rows(df: DataFrame, fit: dict, probs: str, group: str, k: int, keys: list[str], seed: int,
                group_a=1) -> DataFrame:
    """``df`` with the rule's working columns: group, scores, class, draw."""
    p = F.col(probs).cast("array<double>")
    return (df.withColumn("_a", F.col(group) == F.lit(group_a))
            .withColumn("_s", F.when(F.col(group).isNull(), p).otherwise(shifted_scores(p, F.col(group), fit, k, group_a)))
            .withColumn("_c", argmax(F.col("_s"))).withColumn("_u", U(seed, F.lit("t"), *keys)))


def apply_primal(df: DataFrame, fit: dict, probs: str, group: str, num_classes: int, keys: list[str], seed: int = 0,
                 group_a=1, out_col: str = "pred_fair") -> DataFrame:
    """``df`` with the class of the rule and its moves; rows without a group
    keep the plain argmax."""
    rows = parity_rows(df, fit, probs, group, num_classes, keys, seed, group_a)
    cls = F.col("_c")
    for m in reversed(fit["moves"]):                     # an earlier move of a class goes first
        cls = F.when(_moved(m), m["target"]).otherwise(cls)
    return rows.withColumn(out_col, cls.cast("int")).drop("_a", "_s", "_c", "_u")


def exact_parity(df: DataFrame, probs: str, group: str, num_classes: int, keys: list[str], seed: int = 0, group_a=1,
                 out_col: str = "pred_fair", **kw) -> tuple[DataFrame, dict]:
    """I18 with ties split: (``df`` with classes, fit).  The groups' rates agree
    to what whole rows allow; anything else is an error."""
    fit = recover_primal(df, fit_parity(df, probs, group, num_classes, group_a, strict=False, **kw), probs, group,
                         num_classes, keys, seed, group_a)
    sizes = df.where(F.col(group).isNotNull()).agg(F.count_if(F.col(group) == F.lit(group_a)).alias("a"),
                                                   F.count(F.lit(1)).alias("n")).first()
    least = min(sizes["a"], sizes["n"] - sizes["a"])
    if least and fit["gap"] > (num_classes - 1) / least + 1e-12:
        raise RuntimeError(f"class rates differ by {fit['gap']:.4g}")
    return apply_primal(df, fit, probs, group, num_classes, keys, seed, group_a, out_col), fit


# ---------------------------------------------------------------- replicates
#: Draws of a replicate's group above what it needs, before it draws them all;
#: rows that one task draws.
SPARE_DRAWS, SAMPLE_ROWS = 16, 2_000_000


def replicate_sizes(n: int) -> tuple[int, int]:
    """Rows of a replicate and number of replicates: m = floor(sqrt(n)), 50 m."""
    m = math.isqrt(n)
    return m, 50 * m


def replicate_samples(df: DataFrame, key: str, group: str, replicates: int | None,
                      seed: int, per_replicate: int | None = None) -> DataFrame:
    """R replicate subsamples without replacement; in each, group g gets
    floor(share_g * m) rows where m = floor(sqrt(n)) by default and
    R = 50 * m by default (the reference's sizes).

    Rows of each group are indexed 0..N_g-1; a replicate draws indexes at
    random (52-bit draws) and keeps the first different ones, n_g of them.  It
    draws up to 2 n_g + 64, far more than repeats can use up as n_g is at most
    N_g / sqrt(n); running short is an error.  Work is R * m rows, not R * n.

    A (replicate, group) draws inside its own row: of the sequence of draws it
    works out ``SPARE_DRAWS`` more than it needs, and the rest only where these
    repeat too often.  So draws are neither sorted nor grouped; the chosen
    indexes are shuffled once, to meet the index table, whose part of a
    partition is hashed."""
    from stratakit.operators.index import row_index
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_N")).collect()  # one row per group
    n = sum(r["_N"] for r in sizes)
    m, reps = replicate_sizes(n)
    m, reps = per_replicate or m, reps if replicates is None else replicates
    spark = df.sparkSession
    plan = local_table(spark,
        [(r[group], int(r["_N"]), int(math.floor(r["_N"] / n * m))) for r in sizes],
        T.StructType([T.StructField(group, df.schema[group].dataType),
                      T.StructField("_N", T.LongType()), T.StructField("_take", T.LongType())]))
    idx = None
    for r in sizes:
        part = row_index(df.where(F.col(group).eqNullSafe(F.lit(r[group]))).select(key, group), key, "_idx")
        idx = part if idx is None else idx.unionByName(part)
    parts = max(spark.sparkContext.defaultParallelism, -(-reps * m // SAMPLE_ROWS))
    reps_df = spark.range(0, reps, 1, min(parts, max(1, reps))).withColumnRenamed("id", "rep")
    rg = reps_df.withColumn("_g", F.explode(F.array(*[F.lit(r[group]) for r in sizes])))
    rg = rg.withColumnRenamed("_g", group).join(F.broadcast(plan), group).where(F.col("_take") > 0)

    def drawn(last: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda j: draw_index(
            F.col("_N"), seed, F.lit("d"), "rep", group, j)))

    def first_ones(found: Column) -> Column:
        whole = once(drawn(2 * F.col("_take") + 63), lambda d: F.when(F.size(d) < F.col("_take"), F.raise_error(
            F.lit("a replicate drew too few different rows")).cast("array<bigint>")).otherwise(d))
        return F.when(F.size(found) < F.col("_take"), whole).otherwise(found)

    few = F.least(F.col("_take") + SPARE_DRAWS, 2 * F.col("_take") + 64) - 1
    kept = F.slice(once(drawn(few), first_ones), F.lit(1), F.col("_take").cast("int"))
    chosen = rg.select("rep", group, F.explode(kept).alias("_idx"))
    return chosen.join(idx.hint("shuffle_hash"), [group, "_idx"]).select("rep", group, key)


def replicate_rules(samples: DataFrame, data: DataFrame, key: str, group: str, probs: str,
                    k: int, group_a=1, max_iter: int = 400, step: float = 0.1,
                    tol: float = 0.005) -> DataFrame:
    """I19 (solve part): (rep, lam, pi_a, pi_b, gap), one small dual per
    replicate, in parallel; a replicate holds about sqrt(n) rows.  One whose
    gap stays above ``tol``, or above what ``k - 1`` rows of its smaller group
    make, is an error: an unfinished rule doesn't vote."""
    p = F.col(probs).cast("array<double>")
    j = samples.join(data.select(key, *[p[c].alias(f"_p{c}") for c in range(k)]).hint("shuffle_hash"), key)
    j = j.withColumn("_ga", F.coalesce(F.col(group) == F.lit(group_a), F.lit(False)))
    arrow = pa.schema([("rep", pa.int64()), ("lam", pa.list_(pa.float64())), ("pi_a", pa.float64()),
                       ("pi_b", pa.float64()), ("gap", pa.float64())])

    def solve(rows: pa.Table) -> pa.Table:
        p = np.column_stack([rows.column(f"_p{c}").to_numpy() for c in range(k)])
        g, rep = rows.column("_ga").to_numpy(), rows.column("rep")[0].as_py()
        fit = _solve_dual(p, g, np.ones(len(p)), k, max_iter, step, tol)
        least = max(tol, (k - 1) / max(1, min(g.sum(), (~g).sum())))
        if fit["gap"] > least:
            raise RuntimeError(f"replicate {rep}: class rates differ by {fit['gap']:.4g}, more than {least:.4g}")
        return pa.Table.from_pylist([{"rep": rep, "lam": fit["lambda"], "pi_a": fit["pi_a"], "pi_b": fit["pi_b"],
                                      "gap": fit["gap"]}], schema=arrow)

    schema = "rep long, lam array<double>, pi_a double, pi_b double, gap double"
    return j.select("rep", "_ga", *[f"_p{c}" for c in range(k)]).groupBy("rep").applyInArrow(solve, schema)


#: Rules of a block, and of the boxes it is cut into; rows of a chunk.
RULES_A_BLOCK, RULES_A_BOX, ROWS_A_CHUNK = 4096, 64, 4096


def _boxed(lam: np.ndarray) -> list[np.ndarray]:
    """Indexes of rules whose lambdas are near each other: strips by the first
    coordinate, cut by the second."""
    n, strip = len(lam), max(RULES_A_BOX, int(math.sqrt(len(lam) * RULES_A_BOX)))
    order = np.argsort(lam[:, 0], kind="stable")
    out = []
    for at in range(0, n, strip):
        own = order[at:at + strip]
        own = own[np.argsort(lam[own, min(1, lam.shape[1] - 1)], kind="stable")]
        out += [own[i:i + RULES_A_BOX] for i in range(0, len(own), RULES_A_BOX)]
    return out


def _agreed(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The class that every shift between ``low`` and ``high`` gives a row
    (argmax, lowest class on ties); -1 where they may differ.  Exact, as the
    rounded sum p + shift never falls when the shift grows."""
    least, most = p + low, p + high
    out = np.full(len(p), -1, dtype=np.int64)
    for c in range(p.shape[1]):
        sure = np.ones(len(p), dtype=bool)
        for other in range(p.shape[1]):
            if other != c:
                sure &= (least[:, c] > most[:, other]) if other < c else (least[:, c] >= most[:, other])
        out[sure] = c
    return out


def _votes(p: np.ndarray, lam: np.ndarray, in_a: bool, pi: np.ndarray) -> np.ndarray:
    """Votes of all rules for each class, of one group's rows."""
    k = p.shape[1]
    shifts = (-lam if in_a else lam) / pi[:, None]
    out = np.zeros((len(p), k), dtype=np.int64)

    def count(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Counts the votes of rows on whose class the rules ``own`` agree; the other rows."""
        if not len(rows):
            return rows
        cls = _agreed(p[rows], shifts[own].min(axis=0), shifts[own].max(axis=0))
        sure = cls >= 0
        out[rows[sure], cls[sure]] += len(own)
        return rows[~sure]

    left = count(np.arange(len(p)), np.arange(len(lam)))
    for own in _boxed(lam) if len(left) else []:
        rows = count(left, own)
        if not len(rows):
            continue
        best = p[rows, :1] + shifts[own, 0]
        cls = np.zeros(best.shape, dtype=np.int8)
        for c in range(1, k):
            value = p[rows, c:c + 1] + shifts[own, c]
            # as argmax has it: not a number counts as greatest
            more = (value > best) | (np.isnan(value) & ~np.isnan(best))
            cls[more] = c
            best = np.where(more, value, best)
        for c in range(k):
            out[rows, c] += (cls == c).sum(axis=1)
    return out


def vote_relabel(df: DataFrame, key: str, probs: str, group: str, rules: DataFrame, k: int,
                 group_a=1, out_col: str = "pred_vote") -> DataFrame:
    """I19 (apply part): every rule votes on every row, majority wins (D11,
    lowest class on ties).  Rules and rows stay tables: rules are packed into
    blocks, rows into chunks, and each chunk meets each block in a row of its
    own.  There the rules vote by arrays: first all at once where the whole
    block, then where a box of similar rules gives a row the same class for
    certain, one by one only for rows near the border between classes.  The
    blocks' counts are summed by ``key`` (unique)."""
    spark = df.sparkSession
    blocks = checkpointed(rules.groupBy(F.floor(F.col("rep") / F.lit(RULES_A_BLOCK)).cast("long").alias("_b")).agg(
        F.flatten(F.collect_list("lam")).alias("_lam"), F.collect_list(F.struct("pi_a", "pi_b")).alias("_pi"))
        .select("_b", "_lam", F.col("_pi.pi_a").alias("_pi_a"), F.col("_pi.pi_b").alias("_pi_b")))
    ids = blocks.agg(F.sort_array(F.collect_list("_b")).alias("i")).select("i").scalar()      # R / 4096 numbers
    p = F.col(probs).cast("array<double>")
    # a missing probability never wins
    rows = df.select(F.col(key).alias("_key"), (F.col(group) == F.lit(group_a)).alias("_ga"),
                     *[F.coalesce(F.get(p, F.lit(c)), F.lit(-math.inf)).alias(f"_p{c}") for c in range(k)])
    in_key = df.schema[key].dataType
    chunk = T.StructType([T.StructField("_keys", T.ArrayType(in_key)), T.StructField("_ga", T.ArrayType(T.BooleanType())),
                          *[T.StructField(f"_p{c}", T.ArrayType(T.DoubleType())) for c in range(k)]])

    def chunks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_CHUNK):
                own = batch.slice(at, ROWS_A_CHUNK)
                cols = [pa.concat_arrays([col]) for col in own.columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), col) for col in cols],
                    names=chunk.names)

    counts = T.StructType([T.StructField(key, in_key), *[T.StructField(f"_n{c}", T.LongType()) for c in range(k)]])

    def vote(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                def values(name, i=i, batch=batch):
                    return batch.column(name)[i].values
                pi_a, pi_b = (values(c).to_numpy() for c in ("_pi_a", "_pi_b"))
                lam = values("_lam").to_numpy().reshape(len(pi_a), -1)
                ps = np.column_stack([values(f"_p{c}").to_numpy() for c in range(k)])
                side = values("_ga").cast(pa.int8()).fill_null(2).to_numpy()
                out = np.zeros(ps.shape, dtype=np.int64)
                for in_a, pi in ((1, pi_a), (0, pi_b)):
                    own = np.flatnonzero(side == in_a)
                    out[own] = _votes(ps[own], lam, bool(in_a), pi)
                own = np.flatnonzero(side == 2)                  # no group: the plain argmax
                out[own, np.argmax(ps[own], axis=1)] = len(lam)
                yield pa.RecordBatch.from_arrays([values("_keys"), *[pa.array(out[:, c]) for c in range(k)]],
                                                 names=counts.names)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = (rows.mapInArrow(chunks, chunk).withColumn("_c", F.monotonically_increasing_id()).withColumn("_ids", ids)
           .withColumn("_b", F.explode("_ids")).drop("_ids").join(blocks, "_b").repartition(n, "_c", "_b"))
    counted = met.drop("_c", "_b").mapInArrow(vote, counts)
    sums = counted.groupBy(key).agg(*[F.sum(f"_n{c}").alias(f"_n{c}") for c in range(k)])
    voted = sums.select(key, argmax(F.array(*[f"_n{c}" for c in range(k)])).alias(out_col))
    return df.join(voted, key)
