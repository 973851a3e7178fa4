"""Fairness queries: labelled documents (group = English or not, 3 classes
from quality + toxic) and customers with seeded class probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratakit.functions.arrays import argmax, majority_vote
from stratakit.functions.rand import U, draw_index_sql, u_sql
from stratakit.operators.fairness import (apply_primal, baseline_accuracy, exact_parity, fairness_metrics, fit_parity,
                                          grid_side, group_accuracy, metric_frame, parity_relabel, relabel_expr,
                                          replicate_rules, replicate_samples, vote_relabel)
from stratakit.operators.sampling import split_train_test
from stratakit.operators.trees import POISSON_POINTS, fit_forest
from stratakit.plans.registry import SEED, query
from stratakit.session import checkpointed
from stratakit.sources import tables as t

K = 3
VOTES = 7
FEATURES = ["n_chars", "n_lines", "n_words"]


def labelled(spark, d):
    docs = t.read(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    lab = t.read(spark, d, "labels")
    j = docs.join(lab, "doc_id")
    return j.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                    F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
                    F.size(F.split("text", " ")).cast("double").alias("n_words"),
                    (F.col("lang") == "en").cast("int").alias("grp"),
                    (F.col("quality") + F.col("toxic")).cast("int").alias("label"))


LABELLED_SQL = """
SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars,
       CAST(len(string_split(d.text, chr(10))) AS DOUBLE) AS n_lines,
       CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS n_words,
       CAST(d.lang = 'en' AS INTEGER) AS grp, CAST(l.quality + l.toxic AS INTEGER) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


@query("baseline_accuracy", f"""
SELECT round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS baseline_accuracy
FROM (SELECT label, count(*) AS n FROM ({LABELLED_SQL}) GROUP BY label)""")
def q_baseline(spark, d):
    """Majority-class accuracy over the full labelled table."""
    return baseline_accuracy(labelled(spark, d), "label").select(
        F.round("baseline_accuracy", 6).alias("baseline_accuracy"))


def _seeded_probs(key: str):
    return F.array(*[U(SEED, F.lit(f"p{c}"), key) for c in range(K)])


_P = [u_sql(SEED, f"'p{c}'", "doc_id") for c in range(K)]
ARGMAX_SQL = (f"CASE WHEN {_P[0]} >= {_P[1]} AND {_P[0]} >= {_P[2]} THEN 0 "
              f"WHEN {_P[1]} >= {_P[2]} THEN 1 ELSE 2 END")


@query("group_accuracy", f"""
WITH x AS (SELECT *, {ARGMAX_SQL} AS pred FROM ({LABELLED_SQL})
           WHERE {u_sql(SEED, 'doc_id')} >= 0.75)
SELECT CAST(count(*) AS BIGINT) AS n,
       round(avg(CAST(pred = label AS DOUBLE)), 6) AS accuracy,
       round(avg(CASE WHEN grp = 0 THEN CAST(pred = label AS DOUBLE) END), 6) AS acc_group0,
       round(avg(CASE WHEN grp = 1 THEN CAST(pred = label AS DOUBLE) END), 6) AS acc_group1,
       round(abs(avg(CASE WHEN grp = 0 THEN CAST(pred = label AS DOUBLE) END)
               - avg(CASE WHEN grp = 1 THEN CAST(pred = label AS DOUBLE) END)), 6) AS gap
FROM x""")
def q_group_accuracy(spark, d):
    """Accuracy of argmax predictions on the test split,
    overall and per group, and the gap."""
    x = split_train_test(labelled(spark, d), ["doc_id"], SEED).where(F.col("split") == "test")
    x = x.withColumn("pred", argmax(_seeded_probs("doc_id")))
    g = group_accuracy(x, "pred", "label", "grp")
    return g.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "acc_group0", "acc_group1", "gap")])


@query("metric_frame", f"""
WITH x AS (SELECT *, {ARGMAX_SQL} AS pred FROM ({LABELLED_SQL}) WHERE {u_sql(SEED, 'doc_id')} >= 0.75),
g AS (SELECT grp, avg(CAST(pred = label AS DOUBLE)) AS acc, count(*) AS n FROM x GROUP BY grp)
SELECT round(min(acc), 6) AS acc_min, round(max(acc), 6) AS acc_max,
       round(max(acc) - min(acc), 6) AS acc_difference,
       round(CASE WHEN max(acc) = 0 THEN NULL ELSE min(acc) / max(acc) END, 6) AS acc_ratio,
       round(sum(acc * n) / sum(n), 6) AS acc_overall
FROM g""")
def q_metric_frame(spark, d):
    """Accuracy by group with min, max, difference, ratio and overall."""
    x = split_train_test(labelled(spark, d), ["doc_id"], SEED).where(F.col("split") == "test")
    x = x.withColumn("pred", argmax(_seeded_probs("doc_id")))
    m = metric_frame(x, "pred", "label", "grp")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


_V = [f"CAST(floor(3 * {u_sql(SEED, chr(39) + 'v' + chr(39), 'c_custkey', str(r))}) AS INTEGER)"
      for r in range(VOTES)]
_CNT = [" + ".join(f"CAST({v} = {c} AS INTEGER)" for v in _V) for c in range(K)]


@query("vote", f"""
WITH x AS (SELECT c_custkey, {', '.join(f'({c}) AS n{i}' for i, c in enumerate(_CNT))} FROM customer)
SELECT c_custkey AS user_id,
       CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS vote
FROM x""")
def q_vote(spark, d):
    """Majority of seven seeded class predictions, ties to the lowest."""
    c = t.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    preds = F.array(*[F.floor(F.lit(3) * U(SEED, F.lit("v"), "user_id", F.lit(r))).cast("int")
                      for r in range(VOTES)])
    return c.select("user_id", majority_vote(preds, K).alias("vote"))


def customers_with_probs(spark, d):
    c = t.users(spark, d)
    raw = _seeded_probs("user_id")
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return c.select("user_id", F.col("segment").isin("AUTOMOBILE", "BUILDING").cast("int").alias("grp"),
                    F.transform(raw, lambda x: x / total).alias("probs"))


# Oracle for the dual: the same grid cells and the same subgradient iteration as
# a recursive CTE (same IEEE operations in the same order), stopping at the
# first gap below the tolerance and keeping the earliest best lambda.
PARITY_ITER, PARITY_STEP, PARITY_TOL = 2000, 0.1, 0.005
SIDE = grid_side(K)
_PU = [u_sql(SEED, f"'p{c}'", "c_custkey") for c in range(K)]


def _argmax_sql(v):
    return (f"CASE WHEN {v[0]} >= {v[1]} AND {v[0]} >= {v[2]} THEN 0 "
            f"WHEN {v[1]} >= {v[2]} THEN 1 ELSE 2 END")


def _shifted_sql(lam):
    return [f"(p{c} + CASE WHEN grp = 1 THEN (-{lam[c]}) / pi_a ELSE {lam[c]} / pi_b END)" for c in range(K)]


def _eval_sql(lam):
    cnt = lambda g, c: f"CAST(coalesce(sum(w) FILTER (grp = {g} AND c = {c}), 0) AS DOUBLE)"
    diffs = ", ".join(f"{cnt(1, c)} / max(da) - {cnt(0, c)} / max(db) AS d{c}" for c in range(K))
    return (f"(SELECT {diffs} FROM (SELECT cl.grp, cl.w, pi.da, pi.db, {_argmax_sql(_shifted_sql(lam))} AS c "
            f"FROM cl, pi))")


def _dual_ctes() -> str:
    """CTEs ``cl, cn, pi, it, best`` over a ``pr(grp, p0, p1, p2)`` CTE."""
    return f"""cl AS (SELECT grp, count(*) AS w, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM pr
       GROUP BY grp, floor(p0 * {SIDE}), floor(p1 * {SIDE}), floor(p2 * {SIDE})),
cn AS (SELECT count_if(grp = 1) AS na, count(*) AS n FROM pr),
pi AS (SELECT CAST(na AS DOUBLE) / n AS pi_a, CAST(n - na AS DOUBLE) / n AS pi_b,
              CAST(na AS DOUBLE) AS da, CAST(n - na AS DOUBLE) AS db,
              greatest({PARITY_TOL!r}, {K - 1}.0 / least(na, n - na)) AS tol FROM cn),
it(i, l0, l1, l2, d0, d1, d2) AS (
  SELECT 1, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), e.d0, e.d1, e.d2
  FROM {_eval_sql(['CAST(0.0 AS DOUBLE)'] * 3)} e
  UNION ALL
  SELECT nx.i, nx.l0, nx.l1, nx.l2, e.d0, e.d1, e.d2
  FROM (SELECT i + 1 AS i,
               l0 + ({PARITY_STEP!r} / sqrt(i)) * d0 AS l0, l1 + ({PARITY_STEP!r} / sqrt(i)) * d1 AS l1,
               l2 + ({PARITY_STEP!r} / sqrt(i)) * d2 AS l2
        FROM it, pi WHERE i < {PARITY_ITER} AND greatest(abs(d0), abs(d1), abs(d2)) >= pi.tol) nx,
       LATERAL {_eval_sql(['nx.l0', 'nx.l1', 'nx.l2'])} e
),
best AS (SELECT l0, l1, l2 FROM it ORDER BY greatest(abs(d0), abs(d1), abs(d2)), i LIMIT 1)"""


# The gap that the rule leaves among the rows ``x(grp, c)``.
def _gap_sql(x: str) -> str:
    rate = lambda g, c: f"CAST(count_if(grp = {g} AND c = {c}) AS DOUBLE) / count_if(grp = {g})"
    return f"(SELECT greatest({', '.join(f'abs({rate(1, c)} - {rate(0, c)})' for c in range(K))}) FROM {x})"


def _norm_probs_sql(us) -> str:
    tot = f"(((CAST(0.0 AS DOUBLE) + {us[0]}) + {us[1]}) + {us[2]})"
    return ", ".join(f"{us[c]} / {tot} AS p{c}" for c in range(K))


PARITY_SQL = f"""
WITH RECURSIVE
raw AS (SELECT c_custkey AS user_id, CAST(c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS INTEGER) AS grp,
               {_PU[0]} AS u0, {_PU[1]} AS u1, {_PU[2]} AS u2 FROM customer),
pr AS (SELECT user_id, grp, {_norm_probs_sql(['u0', 'u1', 'u2'])} FROM raw),
{_dual_ctes()}
SELECT pr.user_id, pr.grp, {_argmax_sql(['p0', 'p1', 'p2'])} AS pred_before,
       {_argmax_sql(_shifted_sql(['best.l0', 'best.l1', 'best.l2']))} AS pred_after,
       round({_gap_sql("(SELECT grp, " + _argmax_sql(_shifted_sql(['best.l0', 'best.l1', 'best.l2'])) + " AS c FROM pr, pi, best)")}, 9) AS gap
FROM pr, pi, best"""


_DU = [u_sql(SEED, f"'p{c}'", "doc_id") for c in range(K)]
_R6 = "round({}, 6) AS {}"
_REPORT_COLUMNS_SQL = f"""
SELECT {', '.join(_R6.format(c, c) for c in ['baseline_accuracy', 'accuracy_before', 'accuracy_after',
                                              'acc0_before', 'acc1_before', 'acc0_after', 'acc1_after'])},
       round(abs(acc0_before - acc1_before), 6) AS gap_before, round(abs(acc0_after - acc1_after), 6) AS gap_after,
       round(abs(acc0_before - acc1_before) - abs(acc0_after - acc1_after), 6) AS gap_improvement,
       round(acc0_before - acc0_after, 6) AS loss_group0, round(acc1_before - acc1_after, 6) AS loss_group1,
       round(fit_gap, 6) AS fit_gap
FROM m, bl, fg"""
REPORT_SQL = f"""
WITH RECURSIVE
lab AS (SELECT l.*, {_norm_probs_sql(_DU)},
               CASE WHEN {u_sql(SEED, 'doc_id')} < 0.75 THEN 'train' ELSE 'test' END AS split
        FROM ({LABELLED_SQL}) l),
pr AS (SELECT grp, p0, p1, p2 FROM lab WHERE split = 'train'),
{_dual_ctes()},
te AS (SELECT lab.grp, lab.label, {_argmax_sql(['p0', 'p1', 'p2'])} AS bf,
              {_argmax_sql(_shifted_sql(['best.l0', 'best.l1', 'best.l2']))} AS af
       FROM lab, pi, best WHERE lab.split = 'test'),
m AS (SELECT avg(CAST(bf = label AS DOUBLE)) AS accuracy_before, avg(CAST(af = label AS DOUBLE)) AS accuracy_after,
             avg(CASE WHEN grp = 0 THEN CAST(bf = label AS DOUBLE) END) AS acc0_before,
             avg(CASE WHEN grp = 1 THEN CAST(bf = label AS DOUBLE) END) AS acc1_before,
             avg(CASE WHEN grp = 0 THEN CAST(af = label AS DOUBLE) END) AS acc0_after,
             avg(CASE WHEN grp = 1 THEN CAST(af = label AS DOUBLE) END) AS acc1_after FROM te),
fg AS (SELECT {_gap_sql("(SELECT grp, " + _argmax_sql(_shifted_sql(['best.l0', 'best.l1', 'best.l2'])) + " AS c FROM pr, pi, best)")} AS fit_gap),
bl AS (SELECT CAST(max(n) AS DOUBLE) / sum(n) AS baseline_accuracy
       FROM (SELECT label, count(*) AS n FROM lab GROUP BY label))
{_REPORT_COLUMNS_SQL}"""


@query("fairness_report_seeded", REPORT_SQL)
def q_fairness_report_seeded(spark, d):
    """I20 + I18 + D7-D9 with seeded class probabilities per document: the
    dual is fitted on the training split and applied to the test split, and
    the report is the same as ``fairness_report`` (exactly checkable)."""
    x = split_train_test(labelled(spark, d), ["doc_id"], SEED)
    raw = _seeded_probs("doc_id")
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    scored = x.withColumn("probs", F.transform(raw, lambda v: v / total))
    train = scored.where(F.col("split") == "train")
    fit = fit_parity(train, "probs", "grp", K, max_iter=PARITY_ITER, step=PARITY_STEP, tol=PARITY_TOL)
    r = _report(x, scored.where(F.col("split") == "test").select(
        "grp", "label", argmax(F.col("probs")).alias("before"),
        relabel_expr(F.col("probs"), F.col("grp"), fit["lambda"], fit["pi_a"], fit["pi_b"]).alias("after")), fit)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("parity_relabel", PARITY_SQL)
def q_parity(spark, d):
    """I18 + H7: class per customer with equal class rates in both groups."""
    c = customers_with_probs(spark, d)
    out, fit = parity_relabel(c, "probs", "grp", K, max_iter=PARITY_ITER, step=PARITY_STEP, tol=PARITY_TOL)
    return out.select("user_id", "grp", argmax(F.col("probs")).alias("pred_before"),
                      F.col("pred_fair").alias("pred_after"), F.round(F.lit(fit["gap"]), 9).alias("gap"))


# Probabilities in fifths: many customers share theirs, so ties must be split.
_T5 = [f"floor(5 * {u}) + 1" for u in _PU]
_REGRET = "(CASE x.c WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END) - (CASE dst WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END)"
_MOVES = """
f{n} AS (SELECT grp, src, dst, m FROM flow WHERE nth = {n}),
r{n} AS (SELECT user_id, f{n}.dst, f{n}.m, row_number() OVER (PARTITION BY x.grp, x.c ORDER BY
           {regret}, u) AS rn, x.grp, x.c, {regret} AS regret, u
         FROM x JOIN f{n} ON x.grp = f{n}.grp AND x.c = f{n}.src{skip}),
t{n} AS (SELECT user_id, dst FROM r{n} WHERE rn <= m)""".replace("{regret}", _REGRET)
_MOVED = ("(k{n}.u IS NOT NULL AND (" + _REGRET.replace("x.c", "xa.c").replace("dst", "k{n}.dst") + ", xa.u) <= (k{n}.regret, k{n}.u))")
# Rows that must move between classes for equal rates, and the gap that is left.
_FLOW_CTES = f"""cell AS (SELECT g.grp, k.c, (SELECT count(*) FROM x WHERE x.grp = g.grp AND x.c = k.c) AS have,
                (SELECT count(*) FROM x WHERE x.grp = g.grp) AS ng, (SELECT count(*) FROM x WHERE x.c = k.c) AS nc,
                (SELECT count(*) FROM x) AS n FROM (VALUES (0), (1)) g(grp), range({K}) k(c)),
part AS (SELECT *, ng * nc // n AS fl, row_number() OVER (PARTITION BY grp ORDER BY ng * nc % n DESC, c) AS up FROM cell),
want AS (SELECT grp, c, have, ng, fl + CAST(up <= ng - sum(fl) OVER (PARTITION BY grp) AS BIGINT) AS want FROM part),
side AS (SELECT grp, c, have - want AS d, sum(abs(have - want)) OVER (PARTITION BY grp, have > want ORDER BY c) AS hi FROM want
         WHERE have <> want),
flow AS (SELECT a.grp, a.c AS src, b.c AS dst, least(a.hi, b.hi) - greatest(a.hi - abs(a.d), b.hi - abs(b.d)) AS m,
                row_number() OVER (PARTITION BY a.grp, a.c ORDER BY b.c) AS nth
         FROM side a JOIN side b ON a.grp = b.grp AND a.d > 0 AND b.d < 0
         WHERE least(a.hi, b.hi) > greatest(a.hi - abs(a.d), b.hi - abs(b.d))),
gap AS (SELECT max(abs(CAST(a.want AS DOUBLE) / a.ng - CAST(b.want AS DOUBLE) / b.ng)) AS gap
        FROM want a JOIN want b ON a.c = b.c AND a.grp = 1 AND b.grp = 0)"""
EXACT_SQL = f"""
WITH RECURSIVE
raw AS (SELECT c_custkey AS user_id, CAST(c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS INTEGER) AS grp,
               {_T5[0]} + 2 * grp AS u0, {_T5[1]} AS u1, {_T5[2]} AS u2 FROM customer),
pr AS (SELECT user_id, grp, u0 / (u0 + u1 + u2) AS p0, u1 / (u0 + u1 + u2) AS p1, u2 / (u0 + u1 + u2) AS p2 FROM raw),
{_dual_ctes()},
sc AS (SELECT user_id, grp, {u_sql(SEED, "'t'", 'user_id')} AS u, {_shifted_sql(['best.l0', 'best.l1', 'best.l2'])[0]} AS s0,
              {_shifted_sql(['best.l0', 'best.l1', 'best.l2'])[1]} AS s1, {_shifted_sql(['best.l0', 'best.l1', 'best.l2'])[2]} AS s2
       FROM pr, pi, best),
x AS (SELECT *, {_argmax_sql(['s0', 's1', 's2'])} AS c FROM sc),
{_FLOW_CTES},{_MOVES.format(n=1, skip='')},{_MOVES.format(
             n=2, skip=" WHERE x.user_id NOT IN (SELECT user_id FROM t1)")}
SELECT x.user_id, x.grp, CAST(x.c AS INTEGER) AS pred_rule, CAST(coalesce(t1.dst, t2.dst, x.c) AS INTEGER) AS pred_exact, round(gap, 9) AS gap
FROM x LEFT JOIN t1 USING (user_id) LEFT JOIN t2 USING (user_id), gap"""


@query("parity_exact", EXACT_SQL)
def q_parity_exact(spark, d):
    """I18 on ties: probabilities that many customers share, the dual's rule,
    and the rows that move until both groups' class rates agree to a row."""
    raw = [F.floor(5 * U(SEED, F.lit(f"p{c}"), "user_id")) + 1 for c in range(K)]
    c = t.users(spark, d).select("user_id", F.col("segment").isin("AUTOMOBILE", "BUILDING").cast("int").alias("grp"))
    raw[0] = raw[0] + 2 * F.col("grp")
    total = raw[0] + raw[1] + raw[2]
    c = c.withColumn("probs", F.array(*[r / total for r in raw]))
    out, fit = exact_parity(c, "probs", "grp", K, ["user_id"], SEED, max_iter=PARITY_ITER, step=PARITY_STEP, tol=PARITY_TOL)
    return out.select("user_id", "grp", relabel_expr(F.col("probs"), F.col("grp"), fit["lambda"], fit["pi_a"], fit["pi_b"])
                      .alias("pred_rule"), F.col("pred_fair").alias("pred_exact"), F.round(F.lit(fit["gap"]), 9).alias("gap"))


TREES, DEPTH, BINS = 20, 5, 32
_NEXT_BIN = "CASE z.f " + " ".join(f"WHEN {i} THEN n.b{i}" for i in range(len(FEATURES))) + " END"


def _level_ctes(n: int) -> str:
    """One level of all trees: class weights by bin, the best split of each
    node, and the rows' next nodes."""
    cs = range(K)
    side = lambda p: "(" + " + ".join(f"{p}{c}" for c in cs) + ")"
    pure = lambda p: ("((" + " + ".join(f"CAST({p}{c} AS DOUBLE) * CAST({p}{c} AS DOUBLE)" for c in cs)
                      + f") / CAST({side(p)} AS DOUBLE))")
    here = "PARTITION BY tree, node, f"
    return f"""
h{n} AS (SELECT tree, node, f, b, {', '.join(f'sum(CASE WHEN label = {c} THEN w ELSE 0 END) AS c{c}' for c in cs)}
         FROM (SELECT tree, node, label, w, unnest([0, 1, 2]) AS f, unnest([b0, b1, b2]) AS b FROM n{n}
               WHERE w > 0 AND node >= {(1 << n) - 1}) GROUP BY ALL),
g{n} AS (SELECT tree, node, f, b, {', '.join(f'sum(c{c}) OVER ({here}) AS a{c}, sum(c{c}) OVER ({here} ORDER BY b) AS l{c}' for c in cs)},
                dense_rank() OVER (PARTITION BY tree, node ORDER BY {u_sql(SEED, "'f'", 'tree', 'node', 'f')}, f) AS rk FROM h{n}),
u{n} AS (SELECT *, {', '.join(f'a{c} - l{c} AS r{c}' for c in cs)} FROM g{n} WHERE rk <= 2),
s{n} AS (SELECT tree, node, f, b, {pure('l')} + {pure('r')} AS score, {pure('a')} AS least FROM u{n} WHERE {side('r')} > 0),
z{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY score DESC, f, b) AS rn
                        FROM s{n} WHERE score > least) WHERE rn = 1),
n{n + 1} AS (SELECT n.* REPLACE (CASE WHEN z.f IS NULL THEN n.node ELSE 2 * n.node + 1 + CAST({_NEXT_BIN} > z.b AS INTEGER) END AS node)
         FROM n{n} n LEFT JOIN z{n} z ON n.tree = z.tree AND n.node = z.node)"""


# Oracle for the forest: exact quantile bins, Poisson weights, the levels one
# after another, leaf shares added up in the order of the trees.
FOREST_CTES = f"""
lab AS (SELECT l.*, CASE WHEN {u_sql(SEED, 'doc_id')} < 0.75 THEN 'train' ELSE 'test' END AS split FROM ({LABELLED_SQL}) l),
ed AS (SELECT {', '.join(f"list_distinct(quantile_cont({f}, {[i / BINS for i in range(1, BINS)]})) AS e{i}" for i, f in enumerate(FEATURES))}
       FROM lab WHERE split = 'train'),
bn AS (SELECT doc_id, label, split, {', '.join(f'len(list_filter(e{i}, lambda v: v < {f})) AS b{i}' for i, f in enumerate(FEATURES))} FROM lab, ed),
n0 AS (SELECT bn.*, tr.tree, 0 AS node, CASE WHEN split = 'train' THEN {' + '.join(
    f"CAST({u_sql(SEED, chr(39) + 'w' + chr(39), 'tr.tree', 'doc_id')} >= {p!r} AS INTEGER)" for p in POISSON_POINTS)} ELSE 0 END AS w
       FROM bn, range({TREES}) tr(tree)),{','.join(_level_ctes(n) for n in range(DEPTH))},
leaf AS (SELECT tree, node, sum(w) AS n, {', '.join(f'sum(CASE WHEN label = {c} THEN w ELSE 0 END) AS c{c}' for c in range(K))}
         FROM n{DEPTH} WHERE w > 0 GROUP BY tree, node),
fo AS (SELECT doc_id, {', '.join(f'list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(CAST(c{c} AS DOUBLE) / n ORDER BY tree)), lambda a, v: a + v) / {float(TREES)!r} AS p{c}'
                                 for c in range(K))}
       FROM n{DEPTH} JOIN leaf USING (tree, node) GROUP BY doc_id),
pl AS (SELECT lab.doc_id, grp, label, split, p0, p1, p2 FROM lab JOIN fo USING (doc_id))"""


def labelled_forest(x):
    """The forest fitted on the training documents."""
    return fit_forest(x.where(F.col("split") == "train"), FEATURES, "label", ["doc_id"], K, seed=SEED, trees=TREES,
                      depth=DEPTH, bins=BINS)


@query("classifier_probabilities", f"""
WITH {FOREST_CTES}
SELECT doc_id, grp, label, [p0, p1, p2] AS probs FROM pl WHERE split = 'test'""")
def q_classifier(spark, d):
    """I16: random-forest class probabilities for the test documents."""
    x = split_train_test(labelled(spark, d), ["doc_id"], SEED)
    return labelled_forest(x).apply(x.where(F.col("split") == "test")).select("doc_id", "grp", "label", "probs")


_BEST = ["best.l0", "best.l1", "best.l2"]
# A move of training rows ends at a row's (regret, draw); test rows up to it move too.
_CUT = """
k{n} AS (SELECT r{n}.grp, r{n}.c AS src, dst, regret, u FROM r{n} WHERE rn = m)"""
FOREST_REPORT_SQL = f"""
WITH RECURSIVE {FOREST_CTES},
pr AS (SELECT doc_id, grp, p0, p1, p2 FROM pl WHERE split = 'train'),
{_dual_ctes()},
sc AS (SELECT doc_id AS user_id, label, split, grp, {u_sql(SEED, "'t'", 'doc_id')} AS u, {_argmax_sql(['p0', 'p1', 'p2'])} AS bf,
              {', '.join(f'{_shifted_sql(_BEST)[c]} AS s{c}' for c in range(K))} FROM pl, pi, best),
xa AS (SELECT *, {_argmax_sql(['s0', 's1', 's2'])} AS c FROM sc),
x AS (SELECT * FROM xa WHERE split = 'train'),
{_FLOW_CTES},{_MOVES.format(n=1, skip='')},{_MOVES.format(n=2, skip=" WHERE x.user_id NOT IN (SELECT user_id FROM t1)")},{_CUT.format(n=1)},{_CUT.format(n=2)},
af AS (SELECT xa.grp, xa.label, xa.bf, CASE WHEN {_MOVED.format(n=1)} THEN k1.dst WHEN {_MOVED.format(n=2)} THEN k2.dst ELSE xa.c END AS af
       FROM xa LEFT JOIN k1 ON k1.grp = xa.grp AND k1.src = xa.c LEFT JOIN k2 ON k2.grp = xa.grp AND k2.src = xa.c WHERE split = 'test'),
m AS (SELECT avg(CAST(bf = label AS DOUBLE)) AS accuracy_before, avg(CAST(af = label AS DOUBLE)) AS accuracy_after,
             avg(CASE WHEN grp = 0 THEN CAST(bf = label AS DOUBLE) END) AS acc0_before,
             avg(CASE WHEN grp = 1 THEN CAST(bf = label AS DOUBLE) END) AS acc1_before,
             avg(CASE WHEN grp = 0 THEN CAST(af = label AS DOUBLE) END) AS acc0_after,
             avg(CASE WHEN grp = 1 THEN CAST(af = label AS DOUBLE) END) AS acc1_after FROM af),
fg AS (SELECT gap AS fit_gap FROM gap),
bl AS (SELECT CAST(max(n) AS DOUBLE) / sum(n) AS baseline_accuracy
       FROM (SELECT label, count(*) AS n FROM lab GROUP BY label))
{_REPORT_COLUMNS_SQL}"""


@query("fairness_report", FOREST_REPORT_SQL)
def q_fairness_report(spark, d):
    """I20 (+ I16, I18, D7-D9): classifier probabilities, dual relabelling
    fitted on the training rows and applied to the test rows, metrics before
    and after."""
    x = checkpointed(split_train_test(labelled(spark, d), ["doc_id"], SEED))
    scored = checkpointed(labelled_forest(x).apply(x).select("doc_id", "grp", "label", "split", "probs"))
    # trees give many rows the same probabilities: the rows of a tie are split
    _, fit = exact_parity(scored.where(F.col("split") == "train"), "probs", "grp", K, ["doc_id"], SEED,
                          max_iter=PARITY_ITER, step=PARITY_STEP, tol=PARITY_TOL)
    test = apply_primal(scored.where(F.col("split") == "test"), fit, "probs", "grp", K, ["doc_id"], SEED, out_col="after")
    r = _report(x, test.withColumn("before", argmax(F.col("probs"))), fit)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def _report(x, test, fit):
    base = baseline_accuracy(x, "label").select("baseline_accuracy").scalar()
    return fairness_metrics(test, base).withColumn("fit_gap", F.lit(fit["gap"]))


def _replicate_ctes(rows: str) -> str:
    """CTEs ending in ``samples(rep, grp, user_id)``: F7 draws in SQL over the
    customers that ``rows`` leaves."""
    return f"""c AS (SELECT c_custkey AS user_id, CAST(c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS INTEGER) AS grp
           FROM customer WHERE {rows}),
sz AS (SELECT grp, count(*) AS N FROM c GROUP BY grp),
tot AS (SELECT CAST(sum(N) AS DOUBLE) AS n, CAST(floor(sqrt(sum(N))) AS BIGINT) AS m FROM sz),
pl AS (SELECT sz.grp, sz.N, CAST(floor(CAST(sz.N AS DOUBLE) / tot.n * tot.m) AS BIGINT) AS take
       FROM sz CROSS JOIN tot),
idx AS (SELECT user_id, grp, row_number() OVER (PARTITION BY grp ORDER BY user_id) - 1 AS i FROM c),
reps AS (SELECT unnest(range(50 * m)) AS rep FROM tot),
w AS (SELECT reps.rep, pl.grp, pl.N, pl.take, unnest(range(2 * pl.take + 64)) AS j FROM reps CROSS JOIN pl WHERE pl.take > 0),
dr AS (SELECT rep, grp, take, {draw_index_sql('N', SEED, "'d'", 'rep', 'grp', 'j')} AS i, j FROM w),
fi AS (SELECT rep, grp, take, i, min(j) AS j FROM dr GROUP BY ALL),
rk AS (SELECT rep, grp, take, i, row_number() OVER (PARTITION BY rep, grp ORDER BY j) AS rn FROM fi),
samples AS (SELECT CAST(rk.rep AS BIGINT) AS rep, rk.grp, idx.user_id FROM rk JOIN idx ON rk.grp = idx.grp AND rk.i = idx.i
            WHERE rn <= take)"""


REPLICATE_SQL = "WITH " + _replicate_ctes("true") + "\nSELECT rep, grp, user_id FROM samples"


@query("replicate_samples", REPLICATE_SQL)
def q_replicate_samples(spark, d):
    """the reference's replicate subsamples (m = floor(sqrt(n)) rows per
    replicate split by group share, R = 50 m replicates)."""
    c = customers_with_probs(spark, d).select("user_id", "grp")
    return replicate_samples(c, "user_id", "grp", None, SEED)


VOTE_ITER = 400


def _rep_eval_sql(rep: str, lam) -> str:
    cnt = lambda g, c: f"CAST(count_if(grp = {g} AND c = {c}) AS DOUBLE)"
    diffs = ", ".join(f"{cnt(1, c)} / max(da) - {cnt(0, c)} / max(db) AS d{c}" for c in range(K))
    return (f"(SELECT {diffs} FROM (SELECT rs.grp, rp.da, rp.db, pi_a, pi_b, "
            f"{_argmax_sql(_shifted_sql(lam))} AS c FROM rs JOIN rp ON rs.rep = rp.rep WHERE rs.rep = {rep}))")


# Oracle for the replicate vote: F7 draws, one recursive dual per replicate
# (same steps as the per-replicate numpy solve), then the vote of all rules.
VOTE_SQL = f"""
WITH RECURSIVE {_replicate_ctes(u_sql(SEED, 'c_custkey') + ' < 0.75')},
raw AS (SELECT c_custkey AS user_id, CAST(c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS INTEGER) AS grp,
               {_PU[0]} AS u0, {_PU[1]} AS u1, {_PU[2]} AS u2 FROM customer),
pr AS (SELECT user_id, grp, u0 / (((CAST(0.0 AS DOUBLE) + u0) + u1) + u2) AS p0,
              u1 / (((CAST(0.0 AS DOUBLE) + u0) + u1) + u2) AS p1,
              u2 / (((CAST(0.0 AS DOUBLE) + u0) + u1) + u2) AS p2 FROM raw),
rs AS (SELECT samples.rep, pr.grp, pr.p0, pr.p1, pr.p2 FROM samples JOIN pr ON samples.user_id = pr.user_id),
rp AS (SELECT rep, CAST(count_if(grp = 1) AS DOUBLE) / count(*) AS pi_a,
              CAST(count(*) - count_if(grp = 1) AS DOUBLE) / count(*) AS pi_b,
              CAST(count_if(grp = 1) AS DOUBLE) AS da, CAST(count(*) - count_if(grp = 1) AS DOUBLE) AS db,
              greatest({PARITY_TOL!r}, {K - 1}.0 / least(count_if(grp = 1), count(*) - count_if(grp = 1))) AS tol
       FROM rs GROUP BY rep),
it(rep, i, l0, l1, l2, d0, d1, d2) AS (
  SELECT r0.rep, 1, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), e.d0, e.d1, e.d2
  FROM rp AS r0, LATERAL {_rep_eval_sql('r0.rep', ['CAST(0.0 AS DOUBLE)'] * 3)} e
  UNION ALL
  SELECT nx.rep, nx.i, nx.l0, nx.l1, nx.l2, e.d0, e.d1, e.d2
  FROM (SELECT it.rep, i + 1 AS i,
               l0 + ({PARITY_STEP!r} / sqrt(i)) * d0 AS l0, l1 + ({PARITY_STEP!r} / sqrt(i)) * d1 AS l1,
               l2 + ({PARITY_STEP!r} / sqrt(i)) * d2 AS l2
        FROM it JOIN rp ON rp.rep = it.rep
        WHERE i < {VOTE_ITER} AND greatest(abs(d0), abs(d1), abs(d2)) >= rp.tol) nx,
       LATERAL {_rep_eval_sql('nx.rep', ['nx.l0', 'nx.l1', 'nx.l2'])} e
),
best AS (SELECT rep, l0, l1, l2 FROM (
           SELECT *, row_number() OVER (PARTITION BY rep ORDER BY greatest(abs(d0), abs(d1), abs(d2)), i) AS rn
           FROM it) WHERE rn = 1),
rules AS (SELECT best.rep, best.l0, best.l1, best.l2, rp.pi_a, rp.pi_b FROM best JOIN rp ON best.rep = rp.rep),
preds AS (SELECT pr.user_id, pr.grp, {_argmax_sql(_shifted_sql(['rules.l0', 'rules.l1', 'rules.l2']))} AS c
          FROM pr CROSS JOIN rules WHERE {u_sql(SEED, 'pr.user_id')} >= 0.75),
cnt AS (SELECT user_id, grp, count_if(c = 0) AS n0, count_if(c = 1) AS n1, count_if(c = 2) AS n2
        FROM preds GROUP BY user_id, grp)
SELECT user_id, grp, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS pred_vote FROM cnt"""


@query("replicate_vote", VOTE_SQL)
def q_replicate_vote(spark, d):
    """All replicate duals, solved in parallel on subsamples of the
    training customers; every rule votes on every test customer."""
    c = split_train_test(customers_with_probs(spark, d), ["user_id"], SEED)
    train, test = (c.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    samples = replicate_samples(train.select("user_id", "grp"), "user_id", "grp", None, SEED)
    rules = replicate_rules(samples, train, "user_id", "grp", "probs", K, max_iter=VOTE_ITER,
                            step=PARITY_STEP, tol=PARITY_TOL)
    return vote_relabel(test, "user_id", "probs", "grp", rules, K).select("user_id", "grp", "pred_vote")
