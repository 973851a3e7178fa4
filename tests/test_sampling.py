"""Property tests: exact quota sizes, validation, contiguous indexes."""

import pytest
from pyspark.sql import functions as F

from stratakit.operators.index import dense_codes, row_index, row_index_sorted
from stratakit.operators.pools import augment_pool, pool_counts
from stratakit.operators.sampling import exact_sample, top_random
from tests.conftest import SF01


def test_exact_sample_sizes(spark):
    c = spark.read.parquet(f"{SF01}/customer.parquet")
    quotas = {"AUTOMOBILE": 17, "BUILDING": 0, "FURNITURE": -1, "HOUSEHOLD": 250}
    s = exact_sample(c, quotas, ["c_custkey"], 3, stratum_col="c_mktsegment", bits=4)
    got = {r[0]: r[1] for r in s.groupBy("c_mktsegment").count().collect()}
    full = {r[0]: r[1] for r in c.groupBy("c_mktsegment").count().collect()}
    assert got.get("AUTOMOBILE") == 17 and "BUILDING" not in got
    assert got["FURNITURE"] == full["FURNITURE"] and got["HOUSEHOLD"] == 250
    assert "MACHINERY" not in got
    assert s.select("c_custkey").distinct().count() == s.count()


def test_exact_sample_same_as_window(spark):
    c = spark.read.parquet(f"{SF01}/customer.parquet")
    from stratakit.functions.rand import hash32
    from pyspark.sql import Window
    s = exact_sample(c, {"MACHINERY": 40}, ["c_custkey"], 11, stratum_col="c_mktsegment", bits=2)
    w = Window.partitionBy("c_mktsegment").orderBy(hash32(11, "c_custkey"), "c_custkey")
    ref = (c.where(F.col("c_mktsegment") == "MACHINERY").withColumn("rn", F.row_number().over(w))
           .where("rn <= 40"))
    assert sorted(r[0] for r in s.select("c_custkey").collect()) == \
        sorted(r[0] for r in ref.select("c_custkey").collect())


def test_quota_larger_than_stratum_raises(spark):
    c = spark.read.parquet(f"{SF01}/customer.parquet")
    with pytest.raises(Exception, match="quota larger"):
        exact_sample(c, {"AUTOMOBILE": 10**6}, ["c_custkey"], 1, stratum_col="c_mktsegment").collect()


def test_top_random_k(spark):
    p = spark.read.parquet(f"{SF01}/part.parquet")
    assert top_random(p, 3, ["p_partkey"], 5).count() == 3
    assert exact_sample(p, {0: 20_000 // 10}, ["p_partkey"], 5).count() == 2000


def test_row_index_contiguous(spark):
    df = spark.createDataFrame([(k,) for k in [10, 30, 20, 30, 500, -7]], "k long")
    got = sorted((r["k"], r["i"]) for r in row_index(df.distinct(), "k", "i").collect())
    assert got == [(-7, 0), (10, 1), (20, 2), (30, 3), (500, 4)]
    codes = dense_codes(spark.createDataFrame([(10,), (30,), (20,), (30,)], "id long"), "id")
    assert sorted((r["id"], r["code"]) for r in codes.collect()) == [(10, 0), (20, 1), (30, 2)]
    s = row_index_sorted(spark.createDataFrame([("b",), ("a",), ("c",)], "t string"), [F.col("t")], "i")
    assert sorted((r["t"], r["i"]) for r in s.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_augment_pool_contiguous_keys(spark):
    real = spark.createDataFrame([(0, 1.0), (1, 2.0), (5, 3.0)], "user_id long, f double")
    g1 = spark.range(4).withColumnRenamed("id", "row_index").withColumn("f", F.lit(9.0))
    g2 = spark.range(2).withColumnRenamed("id", "row_index").withColumn("f", F.lit(8.0))
    pool = augment_pool(real, {"a": g1, "b": g2}, "user_id")
    keys = sorted(r[0] for r in pool.where("__is_synth = 1").select("user_id").collect())
    assert keys == [6, 7, 8, 9, 10, 11]
    counts = {r["__stratum"]: r["n_rows"] for r in pool_counts(pool).collect()}
    assert counts == {"real": 3, "a": 4, "b": 2}


def test_explode_range_two_levels(spark):
    from stratakit.operators.index import explode_range
    df = spark.createDataFrame([(1, 10), (2, 0), (3, 3)], "u long, n long")
    out = explode_range(df, "n", "j", block=4, spread_cols=["u"])
    got = sorted((r["u"], r["j"]) for r in out.collect())
    assert got == [(1, j) for j in range(10)] + [(3, j) for j in range(3)]


def test_get_train_log_falls_back_when_history_is_empty(spark):
    from stratakit.operators.logs import get_train_log
    from stratakit.operators.pools import empty_log
    from stratakit.sources import tables as t
    users = t.users(spark, SF01).limit(7)
    items = t.items(spark, SF01)
    out = get_train_log(empty_log(spark), users, items, "user_id", "item_id",
                        response=F.col("price") + F.col("acctbal"), use_synth_items=False)
    assert out.count() == 21 and out.select("item_id").distinct().count() == 3
    assert out.columns == ["user_id", "item_id", "relevance", "timestamp"]
    hist = t.history(spark, SF01)
    real = get_train_log(hist, users, items, "user_id", "item_id")
    assert real.count() == hist.join(users.select("user_id"), "user_id", "left_semi").count()


def test_row_index_sparse_and_clustered_keys(spark):
    keys = list(range(1000)) + [10**15, 10**15 + 7, -(10**12)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r["k"] for r in row_index(df, "k", "i").orderBy("i").collect()]
    assert got == sorted(keys)
    idx = sorted(r["i"] for r in row_index(df, "k", "i").collect())
    assert idx == list(range(len(keys)))


def test_row_index_numbers_nulls_and_a_hot_key(spark):
    rows = [(None, 1), (None, 2)] + [(5, i) for i in range(600)] + [(i + 10, 0) for i in range(1200)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    out = row_index(df, "k", "i")
    got = [(r["k"], r["v"]) for r in out.orderBy("i").collect()]
    assert got == rows
    assert sorted(r["i"] for r in out.collect()) == list(range(len(rows)))
    # the hot key's rows are spread: the sort ranges over the whole order
    parts = out.where("k = 5").groupBy(F.floor(F.col("i") / 100)).count().count()
    assert parts == 7


def test_recode_reads_the_history_at_most_twice(spark):
    import __spark_entry__ as se
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        se.queries()["recode_ids"](spark, SF01).explain()
    assert buf.getvalue().count("lineitem") <= 1        # the codes come from the shared folder


def test_random_top_k_is_uniform_and_unseen(spark):
    from stratakit.operators.logs import random_top_k
    users = spark.range(3000).select(F.col("id").alias("u"))
    items = spark.createDataFrame([(10 * i,) for i in range(12)], "i long")
    seen = users.select("u", F.explode(F.expr("array(0L, 50L, 110L)")).alias("i"))
    got = random_top_k(users, items, seen, "u", "i", 4, 3).collect()
    assert len(got) == 12_000 and not {r["i"] for r in got} & {0, 50, 110}
    sets = {}
    for r in got:
        sets.setdefault(r["u"], {})[r["rank"]] = r["i"]
    assert all(sorted(v) == [1, 2, 3, 4] and len(set(v.values())) == 4 for v in sets.values())
    free = [10 * i for i in range(12) if 10 * i not in (0, 50, 110)]
    one = {i: sum(r["i"] == i for r in got) for i in free}
    assert all(abs(n - 12_000 / 9) < 6 * (12_000 / 9) ** 0.5 for n in one.values()), one
    pairs = {(a, b): 0 for a in free for b in free if a != b}
    for v in sets.values():
        pairs[v[1], v[2]] += 1                               # ordered pairs: first and second choice
    assert all(abs(n - 3000 / 72) < 6 * (3000 / 72) ** 0.5 for n in pairs.values())
    few = random_top_k(users.limit(2), items.limit(2), None, "u", "i", 4, 3).collect()
    assert len(few) == 4                                     # no more than there are


def test_index_draws_reach_every_row(spark):
    from stratakit.functions.rand import draw_index
    r = spark.range(100_000).select(draw_index(F.lit(2 ** 40), 1, "id").alias("x")).agg(
        F.countDistinct("x"), F.max("x"), F.countDistinct(F.col("x") % 2 ** 20)).first()
    assert r[0] >= 99_990 and 2 ** 40 * 0.999 < r[1] < 2 ** 40 and r[2] > 90_000


def test_empty_users_and_counts_below_one_are_errors(spark):
    from stratakit.operators.copula import CopulaModel, sample_copula
    from stratakit.operators.logs import get_train_log
    from stratakit.sources import tables as t
    users, items, hist = t.users(spark, SF01), t.items(spark, SF01), t.history(spark, SF01)
    with pytest.raises(ValueError, match="empty"):
        get_train_log(hist, users.filter("false"), items, "user_id", "item_id")
    with pytest.raises(ValueError, match="1 or more"):
        get_train_log(hist, users, items, "user_id", "item_id", k=0)
    with pytest.raises(ValueError, match="1 or more"):
        sample_copula(spark, CopulaModel(), 0, 1)


def test_shared_top_k_over_several_chunks(spark):
    from stratakit.operators.logs import top_k_global_unseen
    users = spark.range(5).withColumnRenamed("id", "u")
    scores = spark.range(30).selectExpr("id AS i", "CAST(id % 7 AS DOUBLE) AS score")
    ranking = sorted(range(30), key=lambda i: (-(i % 7), i))
    seen = [(0, i) for i in ranking[:20]] + [(1, i) for i in ranking[3:9]] + [(2, i) for i in range(30)]
    log = spark.createDataFrame(seen, "u long, i long")
    for own in (None, log):
        for k in (2, 6):
            got = top_k_global_unseen(users, scores, own, "u", "i", k, chunk=4).collect()
            want = {(u, i, n) for u in range(5) for n, i in enumerate(
                [i for i in ranking if own is None or (u, i) not in seen][:k], 1)}
            assert {(r["u"], r["i"], r["rank"]) for r in got} == want
