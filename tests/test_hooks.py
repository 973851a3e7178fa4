"""User-supplied responses and generators, and counts of dropped rows."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from stratakit.operators.features import genre_index, mean_sparse, sparse_genres
from stratakit.operators.generators import CopulaGenerator, ResamplingGenerator
from stratakit.operators.index import dense_codes, recode
from stratakit.operators.pools import augment_pool
from stratakit.operators.responses import attach_features, score_responses, vectorised_response
from stratakit.sources import tables as t
from tests.conftest import SF001


def test_vectorised_response_equals_the_column_builder(spark):
    pairs = t.history(spark, SF001).select("user_id", "item_id").distinct()
    actions = {"column": F.col("acctbal") / 2 + F.col("price"),
               "built": lambda j: j["acctbal"] / 2 + j["price"],
               "arrow": vectorised_response(lambda f: f["acctbal"] / 2 + f["price"], "acctbal", "price")}
    out = score_responses(pairs, t.users(spark, SF001), t.items(spark, SF001), "user_id", "item_id", actions)
    assert out.count() == pairs.count()
    assert out.where("column <> built OR abs(column - arrow) > 1e-9 OR arrow IS NULL").count() == 0


def test_dropped_pairs_are_counted(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 9), (2, 1), (8, 1), (8, 9), (None, 1)], "u long, i long")
    users = spark.createDataFrame([(1, 5), (2, 6)], "u long, known_user int")
    items = spark.createDataFrame([(1, 0.5)], "i long, price double")
    seen = Observation()
    out = attach_features(pairs, users, items, "u", "i", seen)
    plain = attach_features(pairs, users, items, "u", "i")
    assert out.columns == plain.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
    assert seen.get == {"without_user": 3, "without_item": 1}
    lost = Observation()
    rows = recode(pairs, "i", dense_codes(items, "i"), dropped=lost).collect()
    assert len(rows) == 4 and lost.get == {"without_code": 2}
    none = Observation()
    assert recode(pairs.where("u > 99"), "i", dense_codes(items, "i"), dropped=none).collect() == [] and none.get == {"without_code": 0}


def test_generators_join_the_pool(spark):
    users = t.users(spark, SF001).select("user_id", "acctbal", "segment")
    again = ResamplingGenerator(["user_id"], ["acctbal", "segment"], seed=3).fit(users)
    copula = CopulaGenerator(["acctbal"], ["segment"], seed=3, exact=True).fit(users)

    class Constant:
        def generate(self, spark, n):
            return spark.range(n).selectExpr("id AS row_index", "1.0D AS acctbal", "'X' AS segment")
    pool = augment_pool(users, {"again": (again, 40), "copula": (copula, 30), "mine": (Constant(), 5)}, "user_id")
    n = users.count()
    assert {r["__stratum"]: r["count"] for r in pool.groupBy("__stratum").count().collect()} == \
        {"real": n, "again": 40, "copula": 30, "mine": 5}
    assert pool.select("user_id").distinct().count() == n + 75
    drawn = pool.where("__stratum = 'again'")
    assert drawn.join(users.select("acctbal", "segment").distinct(), ["acctbal", "segment"], "left_semi").count() == 40
    assert drawn.select("acctbal").distinct().count() > 20
    with pytest.raises(ValueError, match="not been fitted"):
        augment_pool(users, {"c": (CopulaGenerator(["acctbal"]), 3)}, "user_id")


def test_sparse_genres_with_a_million_genres(spark):
    n = 1_000_000
    one = spark.range(n).selectExpr("id", "concat('g', id, '|all|g', id) AS genres")
    more = spark.createDataFrame([(-1, "(no genres listed)"), (-2, ""), (-3, None)], "id long, genres string")
    df = one.unionByName(more)
    vocabulary = genre_index(df, "genres")
    got = sparse_genres(df, "id", "genres", vocabulary)
    stats = got.agg(F.sum(F.size("genres_at")).alias("n"), F.max(F.array_max("genres_at")).alias("top"),
                    F.count_if(F.size("genres_at") == 0).alias("none"), F.count(F.lit(1)).alias("rows")).first()
    assert (stats["n"], stats["top"], stats["none"], stats["rows"]) == (2 * n, n, 3, n + 3)
    shares = mean_sparse(got.selectExpr("id % 2 AS half", "genres_at").where("half >= 0"), "half", "genres_at")
    top = shares.where("index = 0").collect()
    assert len(top) == 2 and all(0.99 < r["share"] <= 1.0 for r in top)


def test_items_that_share_vectors_count_once_each(spark):
    """Pairs meet vectors after they are counted by group; items without a group or a vector are zeros."""
    from stratakit.operators.features import user_vectors, user_vectors_shared
    log = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 3), (2, 4), (2, 9), (3, 9), (3, 5)], "u int, i int")
    groups = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 8), (5, None)], "i int, g int")
    vectors = spark.createDataFrame([(7, [1.0, 2.0])], "g int, vec array<double>")
    got = user_vectors_shared(log, groups, vectors, "u", "i", "g", 2)
    want = user_vectors(log, groups.join(vectors, "g").select("i", "vec"), "u", "i", 2)
    own = {r["u"]: [round(x, 9) for x in r["vec"]] for r in got.collect()}
    assert own == {r["u"]: [round(x, 9) for x in r["vec"]] for r in want.collect()} and len(own) == 3


def test_ratings_are_read_once_for_genre_means(spark):
    from stratakit.operators.features import sparse_counts, sparse_shares
    rows = spark.createDataFrame([(1, [0, 2]), (1, []), (1, None), (2, [1]), (3, None)], "k int, at array<bigint>")
    counts = sparse_counts(rows, "k", "at")
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()          # written
    assert sorted(map(tuple, sparse_shares(counts, "k").collect())) == [(1, 0, 1 / 3), (1, 2, 1 / 3), (2, 1, 1.0)]
    assert counts.where("index = -1").count() == 3
