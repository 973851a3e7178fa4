"""Means of shared vectors in blocks of keys: no row is shuffled with a vector,
codes need no join, and the blocks never change what comes out."""

import os

import pytest
from pyspark.sql import functions as F

import stratakit.operators.features as features
from stratakit.operators.index import dense_codes, numbered_blocks
from stratakit.plans.features import DIM, q_user_feature_table, q_user_table
from stratakit.session import SHUFFLE_CLEANUP, written


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    """Null and repeated keys: user 3 rates one item twice, item 9 is in no
    catalogue, item 2 is in it twice, order 5 has no user."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("orders", [(1, 30, None), (2, 10, None), (3, 30, None), (4, 20, None), (5, None, None), (6, 40, None)],
        "o_orderkey long, o_custkey long, o_orderdate timestamp")
    put("lineitem", [(1, 1, 2.0), (1, 2, 4.0), (3, 1, 6.0), (2, 2, 1.0), (2, 9, 3.0), (4, 9, None), (5, 1, 8.0), (4, None, 5.0), (None, 1, 1.0)],
        "l_orderkey long, l_partkey long, l_quantity double")
    put("part", [(1, "red ring", 1), (2, "blue bolt", 2), (2, "blue bolt", 2), (3, "red nut", 3), (None, "old plate", 4)],
        "p_partkey long, p_name string, p_size int")
    put("conversations", [(0, 0, "u", "alpha beta"), (0, 1, "u", "alpha"), (1, 0, "u", "beta Gamma!"), (2, 0, "u", "unknown")],
        "conv_id long, turn long, role string, text string")
    put("benchmark", [(0, "alpha beta gamma")], "item_id long, text string")
    put("embeddings", [(i, [float(i + 1)] * DIM, 0) for i in range(5)], "vec_id long, embedding array<float>, label int")
    return str(tmp_path)


def conversation_values(spark, tables):
    """conv_id -> the one value of its vector (all dimensions are alike)."""
    from stratakit.plans.features import tag_vectors
    return {r["conv_id"]: r["vec"][0] for r in tag_vectors(spark, tables).collect()}


def test_user_tables_shuffle_no_user_rows_for_their_codes(spark, tables, no_broadcast):
    """With no table small enough to be sent, vectors used to travel with the pairs and the users' rows with the codes."""
    for query in (q_user_feature_table, q_user_table):
        plan = plan_of(query(spark, tables))
        assert "hashpartitioning(user_id" not in plan and "hashpartitioning(conv_id" not in plan, plan


def test_user_tables_on_null_and_repeated_keys(spark, tables, no_broadcast):
    value = conversation_values(spark, tables)
    got = {(r["user_code"], r["dim"]): (r["rating_avg"], r["value"]) for r in q_user_feature_table(spark, tables).collect()}
    assert len(got) == 3 * DIM
    one, two = value[1], value.get(2, 0.0)          # of items 1 and 2
    # user 10: item 2 (two copies) and item 9 (zeros); user 20: no item that is known; user 30: items 1 (twice) and 2
    want = {0: (2.0, 2 * two / 3), 1: (5.0, 0.0), 2: (4.0, (one + 2 * two) / 3)}
    for (code, _), (rating, v) in got.items():
        assert rating == pytest.approx(want[code][0]) and v == pytest.approx(want[code][1], abs=1e-6)
    rows = {(r["user_code"], r["feature"]): r["value"] for r in q_user_table(spark, tables).collect()}
    genres = {f for _, f in rows if f.startswith("genre ")}
    assert genres == {"genre red", "genre ring", "genre blue", "genre bolt", "genre nut", "genre old", "genre plate"}
    assert len(rows) == 3 * (DIM + 1) + 2 * len(genres)          # user 20 met no item of the catalogue
    assert rows[2, "rating_avg"] == 4.0 and rows[2, "tag 0"] == pytest.approx(want[2][1], abs=1e-6)
    assert rows[2, "genre red"] == rows[2, "genre ring"] == 0.5 and rows[2, "genre nut"] == 0.0


def test_vectors_meet_rows_in_one_shuffle(spark, no_broadcast):
    log = spark.createDataFrame([(u % 7, u % 11, 1) for u in range(200)], "u int, g int, n int")
    vectors = spark.createDataFrame([(g, [float(g), 1.0]) for g in range(10)], "g int, vec array<double>")
    rows = features.hash_blocks(log, "u", 3)
    got = features.block_means(rows, 3, "u", "g", vectors, 2, "n")
    plan = plan_of(got)
    assert "Join" not in plan and "hashpartitioning(u" not in plan
    want = features.mean_vectors(log.join(vectors, "g"), "u", "vec", "n", dim=2)
    own = {r["u"]: r["vec"] for r in got.collect()}
    assert own == {r["u"]: pytest.approx(r["vec"]) for r in want.collect()} and len(own) == 7


def test_blocks_do_not_change_means_counts_or_codes(spark, monkeypatch, no_broadcast):
    """One block, several, and one key with half of all rows."""
    rows = [(u if i % 2 else 500, (u * i) % 13, float(i % 5), [i % 3], 1 + i % 2) for u in (3, -7, 500, 2**53 + 1, 2**53, 90) for i in range(40)]
    log = written(spark.createDataFrame(rows, "u long, i long, v double, at array<bigint>, _copies long").withColumn("g", F.col("i") % 5))
    vectors = spark.createDataFrame([(g, [g + 0.5, -1.0]) for g in range(4)], "g long, vec array<double>")
    codes = {r["u"]: r["code"] for r in dense_codes(log, "u").collect()}
    seen = []
    for size in (10_000_000, 20):
        monkeypatch.setattr(features, "BLOCK_ROWS", size)
        monkeypatch.setattr(features, "VECTOR_BYTES_A_ROW", 10_000)
        means = features.user_means(log, vectors, "u", "i", "g", "v", 2).collect()
        counts = features.user_counts(log, "u", "at", "_copies").collect()
        assert {r["u"]: r["code"] for r in means} == {r["u"]: r["code"] for r in counts} == codes
        seen.append((sorted((r["u"], r["rating_avg"], *(round(x, 9) for x in r["vec"])) for r in means),
                     sorted((r["u"], r["_n"], tuple(sorted(r["_counts"].items()))) for r in counts)))
    assert seen[0] == seen[1] and len(seen[0][0]) == 6
    assert features.range_blocks(log, "u", 12)[1] > 2


def test_block_count_bounds_rows_keys_and_copies():
    b = features.block_count
    assert b(0, 0, 0, 64, 8) == b(10, 10, 10**6, 64, 8) == 1
    assert b(10**6, 10**4, 10, 64, 8) == 8
    for rows, keys, vectors in ((10**9, 10**7, 10**3), (10**9, 10**8, 10**5), (10**10, 10**9, 10**8)):
        n = b(rows, keys, vectors, 64, 8)
        least = max(rows / features.BLOCK_ROWS_MOST, keys / features.BLOCK_KEYS)
        assert n >= round(least) and (n <= least + 1 or n * vectors * 512 <= 1.1 * rows * features.VECTOR_BYTES_A_ROW)


def test_numbered_blocks_follow_the_key(spark):
    df = spark.createDataFrame([(30, 1), (10, 0), (20, 0), (70, 2)], "k long, _block int")
    assert sorted(map(tuple, numbered_blocks(df, "k").collect())) == [(10, 0), (20, 1), (30, 2), (70, 3)]


def test_written_table_leaves_no_shuffle_files(spark, tmp_path):
    def files():
        top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in top for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before, conf = files(), spark.conf.get(SHUFFLE_CLEANUP, None)
    df = written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    assert df.count() == 10 and spark.conf.get(SHUFFLE_CLEANUP, None) == conf
    if conf is not None:          # Spark 4.1 and later
        import time
        for _ in range(50):
            if not files() - before:
                break
            time.sleep(0.2)
        # the count's own shuffle stays until the driver collects its garbage
        assert len(files() - before) <= 1
