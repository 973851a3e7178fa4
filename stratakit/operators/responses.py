"""Response scoring for (user, item) pairs.

A response *component* is a Column built from the joined pair row (user
features, item features, keys).  Components are combined with a weighted mean
and evaluated in one projection, so scoring stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stratakit.functions.rand import bernoulli, normal

Builder = Callable[[DataFrame], Column] | Column


def bernoulli_response(seed: int, theta: float, user_key: str, item_key: str) -> Column:
    """I4: 1 when U(seed, user, item) >= theta, so P(1) = 1 - theta (Q19)."""
    return bernoulli(seed, theta, F.col(user_key), F.col(item_key))


def noise_response(seed: int, user_key: str, item_key: str, mu: float = 1.0,
                   sigma: float = 1.0, clip_negative: bool = True) -> Column:
    """normal(mu, sigma) per pair, clipped at 0 when asked (honours mu and
    sigma, Q6)."""
    z = F.lit(mu) + F.lit(sigma) * normal(seed, F.col(user_key), F.col(item_key))
    return F.greatest(z, F.lit(0.0)) if clip_negative else z


def constant_response(value: float = 0.0) -> Column:
    """Constant heuristic."""
    return F.lit(float(value))


def weighted_ensemble(components: list[Column], weights: list[float]) -> Column:
    """sum(w_i * r_i) / sum(w_i)."""
    if len(components) != len(weights):
        raise ValueError(f"{len(components)} components need as many weights, got {len(weights)}")
    total = float(sum(weights))
    if total == 0:
        raise ValueError("weights sum to zero")
    acc = F.lit(0.0)
    for c, w in zip(components, weights):
        acc = acc + F.lit(float(w) / total) * c
    return acc


def vectorised_response(fn: Callable, *cols: str, returns: str = "double") -> Builder:
    """SURVEY 2.10's escape hatch: ``fn`` takes the named columns of the joined
    pair row as a pandas frame (an Arrow batch of rows) and returns a series.
    A Column builder is faster wherever the formula can be written as one."""
    def over_frame(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(fn(frame))
    scored = F.pandas_udf(over_frame, returns)
    return lambda joined: scored(F.struct(*[joined[c] for c in cols]))


def attach_features(pairs: DataFrame, users: DataFrame, items: DataFrame,
                    user_key: str, item_key: str, dropped: Observation | None = None) -> DataFrame:
    """Pair -> user features -> item features, keyed inner joins (Q1, Q2);
    AQE chooses the join by the sides' bytes.

    ``dropped`` counts what the joins leave out, in the same pass: after an
    action ``dropped.get`` has ``without_user`` and ``without_item`` (pairs
    with a known user but no item)."""
    own = pairs.select(user_key, item_key)
    if dropped is None:
        return own.join(users, user_key).join(items, item_key)
    known_user, known_item = _fresh("known_user", users, items), _fresh("known_item", users, items)
    j = (own.join(users.withColumn(known_user, F.lit(True)), user_key, "left")
         .join(items.withColumn(known_item, F.lit(True)), item_key, "left"))
    no_user, no_item = F.col(known_user).isNull(), F.col(known_item).isNull()
    j = j.observe(dropped, F.count_if(no_user).alias("without_user"), F.count_if(~no_user & no_item).alias("without_item"))
    return j.where(~no_user & ~no_item).drop(known_user, known_item)


def _fresh(name: str, *tables: DataFrame) -> str:
    taken = {c for df in tables for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def score_responses(pairs: DataFrame, users: DataFrame, items: DataFrame,
                    user_key: str, item_key: str, actions: Mapping[str, Builder],
                    keep_features: bool = False, dropped: Observation | None = None) -> DataFrame:
    """One column per named action over the feature-joined pairs."""
    joined = attach_features(pairs, users, items, user_key, item_key, dropped)
    cols = {name: (b(joined) if callable(b) else b) for name, b in actions.items()}
    out = joined.withColumns(cols)
    if keep_features:
        return out
    return out.select(user_key, item_key, *actions.keys())


def append_history(history: DataFrame, responses: DataFrame, user_key: str, item_key: str,
                   flag_col: str = "rated", value_col: str = "relevance",
                   timestamp: int = 0) -> DataFrame:
    """Positive responses (flag == 1) appended to the history with a
    constant timestamp.  The value column name is a parameter (Q18)."""
    add = (responses.where(F.col(flag_col) == 1)
           .select(user_key, item_key, F.col(value_col).cast("double").alias(value_col),
                   F.lit(timestamp).cast("long").alias("timestamp")))
    base = history.select(user_key, item_key, F.col(value_col).cast("double").alias(value_col),
                          F.col("timestamp").cast("long").alias("timestamp"))
    return base.unionByName(add)
