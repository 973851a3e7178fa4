"""Population, sampling, log and response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratakit.functions.rand import bernoulli, draw_index_sql, hash32, hash32_sql, normal_sql, u_sql
from stratakit.operators.index import row_index, row_index_sorted
from stratakit.operators.pools import augment_pool, pool_counts
from stratakit.operators.responses import (append_history, bernoulli_response,
                                           constant_response, noise_response,
                                           score_responses, weighted_ensemble)
from stratakit.operators.logs import get_train_log, random_log, train_log
from stratakit.operators.sampling import (candidate_items, exact_sample, random_pairs,
                                          split_train_test)
from stratakit.plans.registry import SEED, query
from stratakit.sources import tables as t

# Quotas per market segment (-1 = the whole segment); small enough to hold at
# every scale factor, while the whole table is still scanned and binned.
QUOTAS = {"AUTOMOBILE": 10, "BUILDING": 20, "FURNITURE": -1, "HOUSEHOLD": 15, "MACHINERY": 5}
QUOTAS_SQL = ", ".join(f"('{k}', {v})" for k, v in QUOTAS.items())
ITEM_SYNTH, ITEM_REAL = 30, 20
THETA = 0.3


def sampled_users(spark, d):
    return exact_sample(t.users(spark, d), QUOTAS, ["user_id"], SEED, stratum_col="segment")


SAMPLE_SQL = f"""
SELECT user_id, acctbal, nationkey, segment FROM (
  SELECT u.*, q.quota,
         row_number() OVER (PARTITION BY u.segment ORDER BY {hash32_sql(SEED, 'u.user_id')}, u.user_id) AS rn
  FROM ({t.USERS_SQL}) u JOIN (VALUES {QUOTAS_SQL}) q(segment, quota) ON u.segment = q.segment
) WHERE quota = -1 OR rn <= quota"""


@query("stratified_sample", SAMPLE_SQL)
def stratified_sample(spark, d):
    return sampled_users(spark, d)


# ---------------------------------------------------------------- pools
def _pool(spark, d):
    real = t.users(spark, d)
    sup = t.read(spark, d, "supplier").select(
        F.col("s_suppkey"), F.col("s_acctbal").alias("acctbal"),
        F.col("s_nationkey").alias("nationkey"))
    sup = row_index(sup, "s_suppkey", "row_index").drop("s_suppkey")
    nat = t.read(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"))
    nat = row_index(nat, "nationkey", "row_index")
    return augment_pool(real, {"supplier": sup, "nation": nat}, "user_id", fill_missing=True)


POOL_SQL = """
WITH r AS (SELECT c_custkey AS user_id, c_acctbal AS acctbal, c_nationkey AS nationkey,
                  c_mktsegment AS segment, 0 AS __is_synth, 0 AS __cluster, 'real' AS __stratum
           FROM customer),
o1 AS (SELECT coalesce(max(c_custkey) + 1, 0) AS off FROM customer),
g1 AS (SELECT (SELECT off FROM o1) + row_number() OVER (ORDER BY s_suppkey) - 1 AS user_id,
              s_acctbal AS acctbal, s_nationkey AS nationkey, CAST(NULL AS VARCHAR) AS segment,
              1 AS __is_synth, 1 AS __cluster, 'supplier' AS __stratum FROM supplier),
o2 AS (SELECT (SELECT off FROM o1) + count(*) AS off FROM supplier),
g2 AS (SELECT (SELECT off FROM o2) + row_number() OVER (ORDER BY n_nationkey) - 1 AS user_id,
              CAST(NULL AS DOUBLE) AS acctbal, n_nationkey AS nationkey, CAST(NULL AS VARCHAR) AS segment,
              1 AS __is_synth, 2 AS __cluster, 'nation' AS __stratum FROM nation)
SELECT CAST(user_id AS BIGINT) AS user_id, acctbal, nationkey, segment,
       CAST(__is_synth AS INTEGER) AS __is_synth, CAST(__cluster AS INTEGER) AS __cluster, __stratum
FROM (SELECT * FROM r UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2)"""


@query("augment_pool_keys", POOL_SQL)
def augment_pool_keys(spark, d):
    return _pool(spark, d).select("user_id", "acctbal", "nationkey", "segment",
                                  "__is_synth", "__cluster", "__stratum")


@query("pool_counts", f"""
SELECT __stratum, __is_synth, __cluster, CAST(count(*) AS BIGINT) AS n_rows
FROM ({POOL_SQL}) GROUP BY ALL""")
def q_pool_counts(spark, d):
    return pool_counts(_pool(spark, d))


# ------------------------------------------------------------ candidates
@query("candidate_items", f"""
SELECT item_id, price, size FROM (
  SELECT i.*, row_number() OVER (PARTITION BY __is_synth ORDER BY {hash32_sql(SEED, 'item_id')}, item_id) AS rn
  FROM ({t.ITEMS_SQL}) i
) WHERE rn <= CASE WHEN __is_synth = 1 THEN {ITEM_SYNTH} ELSE {ITEM_REAL} END""")
def q_candidate_items(spark, d):
    return candidate_items(t.items(spark, d), ITEM_SYNTH, ITEM_REAL, "item_id", SEED)


# ------------------------------------------------------------- train log
@query("train_log", f"""
SELECT h.* FROM ({t.HISTORY_SQL}) h
WHERE h.user_id IN (SELECT user_id FROM ({SAMPLE_SQL}))
  AND h.item_id IN (SELECT item_id FROM ({t.ITEMS_SQL}) WHERE __is_synth = 0)""")
def q_train_log(spark, d):
    return train_log(t.history(spark, d), sampled_users(spark, d), t.items(spark, d),
                     "user_id", "item_id", use_synth_items=False, use_real_items=True)


def _feature_response():
    """A response that reads the keys and both sides' features."""
    return (bernoulli(SEED, THETA, F.col("user_id"), F.col("item_id")) * (F.lit(1.0) + F.col("price") / F.lit(1000.0))
            + F.col("acctbal") / F.lit(10000.0))


_FEATURE_RESPONSE_SQL = (f"CAST({u_sql(SEED, 's.user_id', 'it.item_id')} >= {THETA} AS INTEGER) * (1.0 + it.price / 1000.0)"
                         " + s.acctbal / 10000.0")


def _fallback_sql(where: str) -> str:
    return f"""
WITH s AS ({SAMPLE_SQL}),
it AS (SELECT item_id, price FROM ({t.ITEMS_SQL}) {where} ORDER BY {hash32_sql(SEED, 'item_id')}, item_id LIMIT 3)
SELECT s.user_id, it.item_id, round({_FEATURE_RESPONSE_SQL}, 9) AS relevance, CAST(0 AS BIGINT) AS timestamp
FROM s CROSS JOIN it"""


@query("train_log_fallback", _fallback_sql(""))
def q_train_log_fallback(spark, d):
    """I2 fallback: random items for the sampled users, scored by a response
    over price and balance."""
    out = random_log(sampled_users(spark, d), t.items(spark, d), "user_id", "item_id", 3, SEED,
                     response=_feature_response())
    return out.withColumn("relevance", F.round("relevance", 9))


@query("train_log_empty_history", _fallback_sql("WHERE __is_synth = 0"))
def q_train_log_empty_history(spark, d):
    """I2 as one call where the users have no history over the allowed items
    (the history is restricted to keys that no user has): the branch falls
    back to random real items with the feature-aware response."""
    none = t.history(spark, d).filter("user_id < 0")
    out = get_train_log(none, sampled_users(spark, d), t.items(spark, d), "user_id", "item_id",
                        response=_feature_response(), use_synth_items=False, seed=SEED)
    return out.withColumn("relevance", F.round("relevance", 9))


@query("get_train_log", f"""
SELECT h.* FROM ({t.HISTORY_SQL}) h
WHERE h.user_id IN (SELECT user_id FROM ({SAMPLE_SQL}))
  AND h.item_id IN (SELECT item_id FROM ({t.ITEMS_SQL}) WHERE __is_synth = 1)""")
def q_get_train_log(spark, d):
    """I2 as one call with a history: no fallback is needed."""
    return get_train_log(t.history(spark, d), sampled_users(spark, d), t.items(spark, d), "user_id", "item_id",
                         response=_feature_response(), use_real_items=False, seed=SEED)


# -------------------------------------------------------------- responses
NOISE_MU, NOISE_SIGMA, CONST = 1.0, 0.5, 2.0
WEIGHTS = [1.0, 1.0, 2.0]


def _responses(spark, d):
    pairs = t.history(spark, d).select("user_id", "item_id").distinct()
    actions = {
        "rated": bernoulli_response(SEED, THETA, "user_id", "item_id"),
        "relevance": F.round(weighted_ensemble(
            [noise_response(SEED, "user_id", "item_id", NOISE_MU, NOISE_SIGMA),
             constant_response(CONST),
             F.col("price") / F.lit(1000.0)], WEIGHTS), 6),
    }
    return score_responses(pairs, t.users(spark, d), t.items(spark, d), "user_id", "item_id",
                           actions)


_W = [w / sum(WEIGHTS) for w in WEIGHTS]
RESP_SQL = f"""
SELECT p.user_id, p.item_id,
       CAST({u_sql(SEED, 'p.user_id', 'p.item_id')} >= {THETA} AS INTEGER) AS rated,
       round(0.0 + {_W[0]!r} * greatest({NOISE_MU!r} + {NOISE_SIGMA!r} * {normal_sql(SEED, 'p.user_id', 'p.item_id')}, 0.0)
             + {_W[1]!r} * {CONST!r} + {_W[2]!r} * (i.price / 1000.0), 6) AS relevance
FROM (SELECT DISTINCT user_id, item_id FROM ({t.HISTORY_SQL})) p
JOIN ({t.USERS_SQL}) u ON p.user_id = u.user_id
JOIN ({t.ITEMS_SQL}) i ON p.item_id = i.item_id"""


@query("score_responses", RESP_SQL)
def q_score_responses(spark, d):
    return _responses(spark, d)


@query("append_history", f"""
SELECT user_id, item_id, CAST(relevance AS DOUBLE) AS relevance, CAST(timestamp AS BIGINT) AS timestamp
FROM ({t.HISTORY_SQL})
UNION ALL
SELECT user_id, item_id, relevance, CAST(0 AS BIGINT) FROM ({RESP_SQL}) WHERE rated = 1""")
def q_append_history(spark, d):
    return append_history(t.history(spark, d), _responses(spark, d), "user_id", "item_id")


# ------------------------------------------------------- positional stack
@query("positional_stack", """
SELECT a.idx AS row_index, a.c_custkey, a.c_acctbal, b.s_suppkey, b.s_acctbal
FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer) a
JOIN (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier) b
  ON a.idx = b.idx""")
def q_positional_stack(spark, d):
    c = row_index(t.read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "row_index")
    s = row_index(t.read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", "row_index")
    return c.join(s, "row_index").select("row_index", "c_custkey", "c_acctbal", "s_suppkey", "s_acctbal")


# ------------------------------------------------------------ random pairs
@query("random_pairs", f"""
WITH u AS (SELECT c_custkey AS user_id, row_number() OVER (ORDER BY c_custkey) - 1 AS uidx FROM customer),
i AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS iidx FROM part),
d AS (SELECT o_orderkey AS draw_id,
             {draw_index_sql("(SELECT count(*) FROM customer)", SEED, "'u'", 'o_orderkey')} AS uidx,
             {draw_index_sql("(SELECT count(*) FROM part)", SEED, "'i'", 'o_orderkey')} AS iidx,
             round({u_sql(SEED, "'s'", 'o_orderkey')}, 9) AS score
      FROM orders)
SELECT d.draw_id, u.user_id, i.item_id, d.score FROM d JOIN u USING (uidx) JOIN i USING (iidx)""")
def q_random_pairs(spark, d):
    draws = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("draw_id"))
    users = t.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    items = t.read(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    out = random_pairs(draws, "draw_id", users, "user_id", items, "item_id", SEED)
    return out.withColumn("score", F.round("score", 9))


# ------------------------------------------------------------------ split
@query("split_train_test", f"""
SELECT c_custkey AS user_id,
       CASE WHEN {u_sql(SEED, 'c_custkey')} < 0.75 THEN 'train' ELSE 'test' END AS split
FROM customer""")
def q_split(spark, d):
    c = t.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return split_train_test(c, ["user_id"], SEED)


# ---------------------------------------------------- flagship (entry)
@query("segment_response_rate", f"""
WITH s AS ({SAMPLE_SQL}),
p AS (SELECT DISTINCT h.user_id, h.item_id FROM ({t.HISTORY_SQL}) h WHERE h.user_id IN (SELECT user_id FROM s))
SELECT s.segment, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(DISTINCT s.user_id) AS BIGINT) AS n_users,
       round(avg(CAST({u_sql(SEED, 'p.user_id', 'p.item_id')} >= {THETA} AS INTEGER)), 6) AS response_rate
FROM p JOIN s ON p.user_id = s.user_id GROUP BY s.segment""")
def segment_response_rate(spark, d):
    """Minimum slice: sample users per segment, take their history, score a
    Bernoulli response per pair, response rate per segment."""
    s = sampled_users(spark, d).select("user_id", "segment")
    # the inner join with the sample is the user restriction (C1) and brings
    # the segment along, so the sample is planned once
    # and comes before the large join: orders are cut to the sample first
    pairs = t.history(spark, d, users=s).select("user_id", "item_id", "segment").distinct()
    scored = pairs.withColumn("rated", bernoulli_response(SEED, THETA, "user_id", "item_id"))
    return scored.groupBy("segment").agg(
        F.count(F.lit(1)).cast("long").alias("n_pairs"),
        F.countDistinct("user_id").cast("long").alias("n_users"),
        F.round(F.avg("rated"), 6).alias("response_rate"))


@query("shuffled_users", f"""
SELECT c_custkey AS user_id,
       CAST(row_number() OVER (ORDER BY {hash32_sql(SEED, 'c_custkey')}, c_custkey) - 1 AS BIGINT) AS position
FROM customer""")
def q_shuffled_users(spark, d):
    """F1 + E1: a repeatable random order of all customers (global sort on
    (hash, key)) with each row's 0-based position in it."""
    c = t.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    c = c.withColumn("_h", hash32(SEED, "user_id"))
    return row_index_sorted(c, [F.col("_h"), F.col("user_id")], "position").select("user_id", "position")
