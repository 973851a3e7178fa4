"""Views of the driver's TPC-H-like tables in the roles the operators expect.

Only the columns a role needs are selected, so the parquet scans read just
those columns (see ``ReadSchema`` in ``explain``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark, sf_dir) -> DataFrame:
    """Real user pool: customer."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))


USERS_SQL = ("SELECT c_custkey AS user_id, c_acctbal AS acctbal, c_nationkey AS nationkey, "
             "c_mktsegment AS segment FROM customer")


def items(spark, sf_dir) -> DataFrame:
    """Item pool: part, origin flag from the size (sizes above 25 stand for
    generated items)."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("size"), (F.col("p_size") > 25).cast("int").alias("__is_synth"))


ITEMS_SQL = ("SELECT p_partkey AS item_id, p_retailprice AS price, p_size AS size, "
             "CAST(p_size > 25 AS INTEGER) AS __is_synth FROM part")


def day_number(c) -> F.Column:
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("long")


def history(spark, sf_dir, users: DataFrame | None = None) -> DataFrame:
    """History log: lineitem joined to orders (user = customer, item = part,
    value = quantity, timestamp = yyyymmdd of the order date).  With ``users``
    only theirs, with their other columns; orders are cut to them before the
    join with lineitem."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_orderdate")
    more = []
    if users is not None:
        o = o.join(users, "user_id")
        more = [c for c in users.columns if c != "user_id"]
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "user_id", F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").alias("relevance"), day_number(F.col("o_orderdate")).alias("timestamp"), *more)


HISTORY_SQL = ("SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS relevance, "
               "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) "
               "AS timestamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
