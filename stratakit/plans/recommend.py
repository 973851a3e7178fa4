"""Recommendation-side queries: top-k by Wilson bound and at random, pair
de-duplication, dense re-coding and the learned response
component."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratakit.functions.rand import draw_index_sql, hash52_sql, normal_sql, u_sql
from stratakit.operators.index import dense_codes, recode
from stratakit.operators.logs import (Z_95, dedup_pairs, random_top_k,
                                      top_k_global_unseen, wilson_scores)
from stratakit.plans.registry import SEED, query
from stratakit.session import checkpointed
from stratakit.sources import tables as t

K = 5
POS_QTY = 25.0


def _binary_history(spark, d):
    return t.history(spark, d).withColumn(
        "relevance", (F.col("relevance") >= F.lit(POS_QTY)).cast("double"))


_zz = Z_95 * Z_95
WILSON_SQL = f"""
WITH h AS (SELECT user_id, item_id, CAST(relevance >= {POS_QTY} AS DOUBLE) AS rel FROM ({t.HISTORY_SQL})),
a AS (SELECT item_id, sum(rel) AS pos, CAST(count(*) AS DOUBLE) AS n FROM h GROUP BY item_id),
s AS (SELECT item_id,
             ((pos / n) + {_zz / 2.0!r} / n - {Z_95!r} * sqrt(((pos / n) * (1.0 - (pos / n)) + {_zz / 4.0!r} / n) / n))
             / (1.0 + {_zz!r} / n) AS score FROM a),
us AS (SELECT DISTINCT user_id FROM h),
seen AS (SELECT DISTINCT user_id, item_id FROM h),
c AS (SELECT us.user_id, s.item_id, s.score FROM us CROSS JOIN s
      WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = us.user_id AND seen.item_id = s.item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM c)
SELECT user_id, item_id, round(score, 9) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= {K}"""


@query("topk_wilson", WILSON_SQL)
def topk_wilson(spark, d):
    """I21 + F9: popularity by Wilson lower bound, k best unseen items per user."""
    # one aggregate, written once, serves scores, users, seen counts and the anti-join
    pairs = checkpointed(_binary_history(spark, d).groupBy("user_id", "item_id").agg(
        F.sum("relevance").alias("relevance"), F.count(F.lit(1)).alias("n")))
    scores = wilson_scores(pairs, "item_id", "relevance", count_col="n")
    out = top_k_global_unseen(pairs.select("user_id"), scores, pairs, "user_id", "item_id", K)
    return out.select("user_id", "item_id", F.round("score", 9).alias("score"),
                      F.col("rank").cast("long").alias("rank"))


# Floyd's method over the unseen ranks as a fold; a rank's item index adds the
# seen indexes below it.
RANDOM_SQL = f"""
WITH h AS ({t.HISTORY_SQL}),
seen AS (SELECT DISTINCT user_id, item_id FROM h),
i AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS iidx FROM part),
s AS (SELECT seen.user_id, i.iidx, i.iidx - row_number() OVER (PARTITION BY seen.user_id ORDER BY i.iidx) + 1 AS gap
      FROM seen JOIN i USING (item_id)),
u AS (SELECT user_id, (SELECT count(*) FROM part) - count(*) AS n FROM s GROUP BY user_id),
f AS (SELECT user_id, list_reduce(range(greatest(n - {K}, 0), n), lambda acc, j: list_append(acc,
        CASE WHEN list_contains(acc, {draw_index_sql('(j + 1)', SEED, "'r'", 'user_id', 'j')}) THEN j
             ELSE {draw_index_sql('(j + 1)', SEED, "'r'", 'user_id', 'j')} END), CAST([] AS BIGINT[])) AS ranks FROM u),
r AS (SELECT user_id, unnest(ranks) AS r FROM f),
p AS (SELECT r.user_id, r.r + (SELECT count(*) FROM s WHERE s.user_id = r.user_id AND s.gap <= r.r) AS iidx FROM r)
SELECT p.user_id, i.item_id,
       CAST(row_number() OVER (PARTITION BY p.user_id ORDER BY {hash52_sql(SEED, "'o'", 'p.user_id', 'i.item_id')}, i.item_id) AS BIGINT) AS rank
FROM p JOIN i USING (iidx)"""


@query("topk_random", RANDOM_SQL)
def topk_random(spark, d):
    """I22 + F9: k random unseen items per user."""
    pairs = checkpointed(t.history(spark, d).select("user_id", "item_id").distinct())
    items = t.read(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    out = random_top_k(pairs.select("user_id"), items, pairs, "user_id", "item_id", K, SEED)
    return out.select("user_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("dedup_pairs", f"""
SELECT user_id, item_id, relevance, timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY timestamp DESC, relevance DESC) AS rn
  FROM ({t.HISTORY_SQL})) WHERE rn = 1""")
def q_dedup_pairs(spark, d):
    """One history row per (user, item), the latest (then largest)."""
    out = dedup_pairs(t.history(spark, d), "user_id", "item_id", ["timestamp", "relevance"])
    return out.select("user_id", "item_id", "relevance", "timestamp")


@query("recode_ids", f"""
WITH h AS ({t.HISTORY_SQL}),
uc AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS code FROM (SELECT DISTINCT user_id FROM h)),
ic AS (SELECT p_partkey AS item_id, dense_rank() OVER (ORDER BY p_partkey) - 1 AS code FROM part)
SELECT CAST(uc.code AS BIGINT) AS user_code, CAST(ic.code AS BIGINT) AS item_code, h.relevance, h.timestamp
FROM h JOIN uc ON h.user_id = uc.user_id JOIN ic ON h.item_id = ic.item_id""")
def q_recode(spark, d):
    """E2 + C10 + C8: users coded over the history, items over the catalogue;
    both applied to the log by key joins."""
    h = t.history(spark, d)
    uc = dense_codes(h, "user_id")
    ic = dense_codes(t.read(spark, d, "part").select(F.col("p_partkey").alias("item_id")), "item_id")
    out = recode(recode(h, "user_id", uc, out_col="user_code"), "item_id", ic, out_col="item_code")
    return out.select("user_code", "item_code", "relevance", "timestamp")


ALS_RANK, ALS_STEPS, ALS_RIDGE = 2, 5, 1.0
USER_FEATS, ITEM_FEATS = ["acctbal"], ["price", "size"]


def _solve_ctes(name: str, start: str, n: int) -> str:
    """CTEs ``{name}0`` to ``{name}{n}``: Gauss-Jordan steps on the rows (i, j, x)
    of ``start``, whose column n is the right side."""
    out = f",\n{name}0 AS MATERIALIZED ({start})"
    for k in range(n):
        out += f""",
{name}{k + 1} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {k} THEN a.x / p.x ELSE a.x - c.x * r.x / p.x END AS x
  FROM {name}{k} a JOIN {name}{k} r ON r.i = {k} AND r.j = a.j JOIN {name}{k} c ON c.i = a.i AND c.j = {k}
  JOIN {name}{k} p ON p.i = {k} AND p.j = {k})"""
    return out


def _als_ctes() -> str:
    """CTEs ending in ``pr(user_id, item_id, prediction)``: sums of products of
    the training rows, then each step's systems solved."""
    feats, r = USER_FEATS + ITEM_FEATS, ALS_RANK
    p, q = len(USER_FEATS) + 1, len(ITEM_FEATS) + 1

    def scaled(f):
        return f"({f} - m_{f}) / s_{f}"

    u, v = ["1.0", *map(scaled, USER_FEATS)], ["1.0", *map(scaled, ITEM_FEATS)]
    z = [f"({a}) * ({b})" for a in u for b in v]
    places = [(i, j) for i in range(p) for j in range(q)]
    out = f"""
tr AS MATERIALIZED (SELECT CAST(h.relevance AS DOUBLE) AS y, {", ".join(feats)} FROM ({t.HISTORY_SQL}) h
  JOIN ({t.USERS_SQL}) u USING (user_id) JOIN ({t.ITEMS_SQL}) i USING (item_id) WHERE {u_sql(SEED, "h.user_id")} < 0.75),
mo AS MATERIALIZED (SELECT {", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in feats)} FROM tr),
ph AS MATERIALIZED (SELECT y, {", ".join(f"{e} AS z{n}" for n, e in enumerate(z))} FROM tr, mo),
mm AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {k} AS k, {l} AS l, sum(z{a} * z{b}) AS x FROM ph"
                                        for a, (i, j) in enumerate(places) for b, (k, l) in enumerate(places))}),
tt AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum(z{a} * y) AS x FROM ph" for a, (i, j) in enumerate(places))}),
fb0 AS (SELECT * FROM (VALUES {", ".join(f"({j}, {c}, {1.0 if j == c else 0.0}::DOUBLE)" for j in range(q) for c in range(r))}) b(j, c, x))"""

    def half(name, known, own, other, far_own, far_other, n):
        return _solve_ctes(name, f"""
  SELECT m.{own} * {r} + b.c AS i, m.{far_own} * {r} + d.c AS j,
         sum(b.x * m.x * d.x) + CASE WHEN m.{own} = m.{far_own} AND b.c = d.c THEN {ALS_RIDGE} ELSE 0 END AS x
  FROM mm m JOIN {known} b ON b.j = m.{other} JOIN {known} d ON d.j = m.{far_other} GROUP BY m.{own}, b.c, m.{far_own}, d.c
  UNION ALL SELECT tt.{own} * {r} + b.c, {n}, sum(tt.x * b.x) FROM tt JOIN {known} b ON b.j = tt.{other} GROUP BY tt.{own}, b.c""", n)

    for s in range(ALS_STEPS):
        out += half(f"ga{s}_", f"fb{s}", "i", "j", "k", "l", p * r)
        out += f",\nfa{s} AS MATERIALIZED (SELECT i // {r} AS j, i % {r} AS c, x FROM ga{s}_{p * r} WHERE j = {p * r})"
        out += half(f"gb{s}_", f"fa{s}", "j", "i", "l", "k", q * r)
        out += f",\nfb{s + 1} AS MATERIALIZED (SELECT i // {r} AS j, i % {r} AS c, x FROM gb{s}_{q * r} WHERE j = {q * r})"
    weight = " + ".join(f"(SELECT sum(a.x * b.x) FROM fa{ALS_STEPS - 1} a JOIN fb{ALS_STEPS} b USING (c) WHERE a.j = {i} AND b.j = {j})"
                        f" * ({u[i]}) * ({v[j]})" for i, j in places)
    return out + f""",
pr AS (SELECT h.user_id, h.item_id, {weight} AS prediction
  FROM (SELECT DISTINCT user_id, item_id FROM ({t.HISTORY_SQL})) h
  JOIN ({t.USERS_SQL}) u USING (user_id) JOIN ({t.ITEMS_SQL}) i USING (item_id), mo)"""


@query("learned_response", f"""
WITH {_als_ctes()}
SELECT user_id, item_id, round(0.25 * greatest(1.0 + {normal_sql(SEED, 'user_id', 'item_id')}, 0.0) + 0.25 + 0.5 * prediction, 6) AS relevance
FROM pr""")
def learned_response(spark, d):
    """I6 with a learned component: a factored response fitted by alternating
    least squares on the history of the training share of users, with user
    and item features, blended with noise and a constant."""
    from stratakit.operators.models import fit_factored_response
    from stratakit.operators.responses import (constant_response, noise_response,
                                               weighted_ensemble)
    from stratakit.operators.sampling import split_train_test
    users, items, log = t.users(spark, d), t.items(spark, d), t.history(spark, d)
    train = split_train_test(log, ["user_id"], SEED).where("split = 'train'")
    model = fit_factored_response(train, users, items, "user_id", "item_id", "relevance", USER_FEATS, ITEM_FEATS,
                                  rank=ALS_RANK, steps=ALS_STEPS, ridge=ALS_RIDGE)
    pred = model.apply(log.select("user_id", "item_id").distinct(), users, items)
    rel = weighted_ensemble([noise_response(SEED, "user_id", "item_id"), constant_response(1.0),
                             F.col("prediction")], [1.0, 1.0, 2.0])
    return pred.select("user_id", "item_id", F.round(rel, 6).alias("relevance"))
