"""Training logs, random logs and top-k recommendations
(C1 C2 C4 I2 F9 I21 I22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions.rand import draw_index, hash32, hash52
from stratakit.operators.pools import origin_filter
from stratakit.operators.responses import attach_features
from stratakit.operators.sampling import top_random
from stratakit.session import parameter_broadcast


def restrict_log(history: DataFrame, users: DataFrame | None, items: DataFrame | None,
                 user_key: str, item_key: str) -> DataFrame:
    """History of a user subset over an item subset (left-semi joins;
    set semantics, duplicates in the subsets do not multiply rows)."""
    out = history
    if users is not None:
        out = out.join(users.select(user_key), user_key, "left_semi")
    if items is not None:
        out = out.join(items.select(item_key), item_key, "left_semi")
    return out


def train_log(history: DataFrame, users: DataFrame, items: DataFrame, user_key: str,
              item_key: str, use_synth_items: bool = True, use_real_items: bool = True) -> DataFrame:
    """I2 (history branch): B3 origin filter on items, then C1 and C2."""
    allowed = origin_filter(items, use_synth_items, use_real_items)
    return restrict_log(history, users, allowed, user_key, item_key)


def random_log(users: DataFrame, items: DataFrame, user_key: str, item_key: str,
               k: int, seed: int, response: Column | None = None,
               value_col: str = "relevance") -> DataFrame:
    """I2 fallback (F3 + C4): the same ``k`` random items for every user, each
    pair scored by ``response`` (a Column over keys and the users' and items'
    features, which are attached first), timestamp 0.

    The k items are numbered 0..k-1 and every user row is exploded into k
    slots, so the pairing is an equi-join against a k-row parameter table."""
    picked = top_random(items, k, [item_key], seed)
    slots = picked.select(item_key, (F.row_number().over(
        Window.orderBy(hash32(seed, item_key), item_key)) - 1).alias("_slot"))
    u = users.select(user_key).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    pairs = u.join(parameter_broadcast(slots, k), "_slot").drop("_slot")
    resp = response if response is not None else F.lit(1.0)
    return attach_features(pairs, users, items, user_key, item_key).select(
        user_key, item_key, resp.cast("double").alias(value_col), F.lit(0).cast("long").alias("timestamp"))


def top_k_per_user(scored: DataFrame, user_key: str, item_key: str, score_col: str,
                   k: int) -> DataFrame:
    """k best items per user, ties to the lower item key.  The literal k
    lets Spark insert a partial WindowGroupLimit before the shuffle, so even a
    hot user sends at most k rows per partition."""
    w = Window.partitionBy(user_key).orderBy(F.col(score_col).desc(), F.col(item_key))
    return (scored.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.lit(k)))


# Fixed value: two-sided 95 % normal quantile used by the Wilson bound.
Z_95 = 1.959963984540054


def wilson_scores(log: DataFrame, item_key: str, value_col: str, z: float = Z_95,
                  count_col: str | None = None) -> DataFrame:
    """Wilson lower bound of the positive share per item (binary values).
    Partial aggregation before the shuffle; one row per item.  A log that is
    already summed up names its row counts by ``count_col``."""
    rows = F.count(F.lit(1)) if count_col is None else F.sum(count_col)
    agg = log.groupBy(item_key).agg(F.sum(F.col(value_col).cast("double")).alias("_pos"),
                                    rows.cast("double").alias("_n"))
    p = F.col("_pos") / F.col("_n")
    n = F.col("_n")
    zz = z * z
    score = ((p + F.lit(zz / 2.0) / n
              - F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + F.lit(zz / 4.0) / n) / n))
             / (F.lit(1.0) + F.lit(zz) / n))
    return agg.select(item_key, score.alias("score"))


def top_k_global_unseen(users: DataFrame, scores: DataFrame, seen: DataFrame | None,
                        user_key: str, item_key: str, k: int,
                        chunk: int = 256) -> DataFrame:
    """F9 for a score shared by all users (popularity models): k best items
    per user, excluding items the user has seen.

    Only the first ``k + seen_u`` items of the global ranking can qualify, so
    each user is joined to exactly that prefix: the ranked items are cut into
    chunks of ``chunk`` ranks, each user row is exploded into the chunk ids it
    needs and equi-joined on the chunk id.  Work is linear in
    ``sum_u (k + seen_u)``; no user-by-all-items product is formed."""
    from stratakit.operators.index import row_index_sorted
    ranked = row_index_sorted(scores, [F.col("score").desc(), F.col(item_key)], "_rank")
    ranked = ranked.withColumn("_chunk", F.floor(F.col("_rank") / F.lit(chunk)).cast("long"))
    u = users.select(user_key).distinct()
    if seen is not None:
        s = (seen.select(user_key, item_key).distinct()
             .groupBy(user_key).agg(F.count(F.lit(1)).alias("_seen")))
        u = u.join(s, user_key, "left").fillna(0, ["_seen"])
    else:
        u = u.withColumn("_seen", F.lit(0).cast("long"))
    from stratakit.operators.index import explode_range
    u = u.withColumn("_need", F.lit(k) + F.col("_seen"))
    # every user needs the first chunk, a table of at most ``chunk`` rows; it is no join key that all users share
    head = parameter_broadcast(ranked.where(F.col("_rank") < chunk), chunk)
    cand = u.withColumn("_chunk", F.lit(0).cast("long")).join(head, "_chunk")
    if seen is not None or k > chunk:
        rest = u.withColumn("_more", F.floor((F.col("_need") - 1) / F.lit(chunk)).cast("long")).where(F.col("_more") > 0)
        rest = explode_range(rest, "_more", "_at", spread_cols=[user_key]).withColumn("_chunk", F.col("_at") + 1)
        cand = cand.unionByName(rest.join(ranked, "_chunk").select(*cand.columns))
    cand = cand.where(F.col("_rank") < F.col("_need")).select(user_key, item_key, "score", "_rank")
    if seen is not None:
        cand = cand.join(seen.select(user_key, item_key), [user_key, item_key], "left_anti")
    w = Window.partitionBy(user_key).orderBy("_rank")
    return (cand.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.lit(k)).drop("_rank"))


def random_top_k(users: DataFrame, items: DataFrame, seen: DataFrame | None,
                 user_key: str, item_key: str, k: int, seed: int) -> DataFrame:
    """K random unseen items per user, uniform over all k-subsets of the
    user's unseen items, in random order.

    With u unseen items a user draws k different ranks in [0, u) by Floyd's
    method (k steps, 52-bit draws).  A rank r among the unseen items is item
    index r + c, where c counts the seen indexes s_i (ascending, i from 0)
    with s_i - i <= r.  So a user costs k rows for the ranks and k times the
    number of seen items for the counts; items are never enumerated."""
    from stratakit.operators.index import row_index
    idx = row_index(items.select(item_key), item_key, "_iidx")
    n = items.select(F.count(F.lit(1)).cast("long")).scalar()
    u = users.select(user_key).distinct()
    if seen is not None:
        pairs = seen.select(user_key, item_key).distinct().join(idx, item_key).select(user_key, "_iidx")
        order = Window.partitionBy(user_key).orderBy("_iidx")
        gaps = pairs.select(user_key, (F.col("_iidx") - F.row_number().over(order) + 1).alias("_gap"))
        sizes = pairs.groupBy(user_key).agg(F.count(F.lit(1)).alias("_seen"))
        u = u.join(sizes, user_key, "left").fillna(0, ["_seen"])
    else:
        u = u.withColumn("_seen", F.lit(0).cast("long"))
    u = u.select(user_key, (n - F.col("_seen")).alias("_unseen"))

    def step(chosen, j):
        t = draw_index(j + 1, seed, F.lit("r"), F.col(user_key), j)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, t), j).otherwise(t)))

    first = F.greatest(F.col("_unseen") - F.lit(k), F.lit(0))
    steps = F.filter(F.sequence(first, F.greatest(F.col("_unseen") - 1, first)), lambda j: j < F.col("_unseen"))
    ranks = F.aggregate(steps, F.array().cast("array<bigint>"), step)
    drawn = u.select(user_key, F.explode(ranks).alias("_r"))
    if seen is not None:
        before = (drawn.join(gaps, user_key).filter(F.col("_gap") <= F.col("_r"))
                  .groupBy(user_key, "_r").agg(F.count(F.lit(1)).alias("_c")))
        drawn = drawn.join(before, [user_key, "_r"], "left").fillna(0, ["_c"])
    else:
        drawn = drawn.withColumn("_c", F.lit(0).cast("long"))
    picked = (drawn.withColumn("_iidx", F.col("_r") + F.col("_c")).join(idx, "_iidx")
              .withColumn("_o", hash52(seed, F.lit("o"), user_key, item_key)))
    w = Window.partitionBy(user_key).orderBy("_o", item_key)
    return (picked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(k))
            .select(user_key, item_key, "rank"))


def dedup_pairs(log: DataFrame, user_key: str, item_key: str, order_cols: list[str]) -> DataFrame:
    """One row per (user, item) - the one with the largest ``order_cols``
    - via a partial aggregate of a struct (no window, map-side combine)."""
    rest = [c for c in log.columns if c not in (user_key, item_key)]
    keep = order_cols + [c for c in rest if c not in order_cols]
    agg = log.groupBy(user_key, item_key).agg(F.max(F.struct(*keep)).alias("_best"))
    return agg.select(user_key, item_key, *[F.col("_best")[c].alias(c) for c in rest])


def get_train_log(history: DataFrame, users: DataFrame, items: DataFrame, user_key: str,
                  item_key: str, response: Column | None = None, use_synth_items: bool = True,
                  use_real_items: bool = True, k: int = 3, seed: int = 42,
                  value_col: str = "relevance") -> DataFrame:
    """I2 as one call: the users' history over the allowed items; when that
    is empty, ``k`` random allowed items per user scored by ``response``.
    The branch is chosen with ``isEmpty()`` (a one-row job), not a count.  An
    empty user table and ``k`` below 1 are errors (B10)."""
    if k < 1:
        raise ValueError(f"k has to be 1 or more, not {k}")
    if users.isEmpty():
        raise ValueError("the user table is empty")
    allowed = origin_filter(items, use_synth_items, use_real_items)
    log = restrict_log(history, users, allowed, user_key, item_key)
    if not log.isEmpty():
        return log
    return random_log(users, allowed, user_key, item_key, k, seed, response, value_col)
