"""Task-set queries: lineitem rows of one supplier form one task set."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratakit.operators.queues import busy_periods, mindl_batch, number_tasks
from stratakit.plans.registry import query
from stratakit.sources import tables as t

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def tasks(spark, d):
    """Task sets: one per supplier; integer arrival (days since 1995-01-01),
    processing 1..6 from the quantity, deadline = arrival + processing +
    2 * line number; task numbers by a full-column order."""
    li = t.read(spark, d, "lineitem")
    arrival = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long")
    processing = (F.floor(F.col("l_quantity") / 10) + 1).cast("long")
    x = li.select(F.col("l_suppkey").cast("string").alias("instance_id"), *ORDER,
                  arrival.alias("arrival"), processing.alias("processing"))
    x = x.withColumn("deadline", F.col("arrival") + F.col("processing") + 2 * F.col("l_linenumber"))
    x = number_tasks(x, "instance_id", ORDER)
    return x.select("instance_id", F.col("task_no").cast("long").alias("task_no"),
                    "arrival", "processing", "deadline")


TASKS_SQL = f"""
SELECT CAST(l_suppkey AS VARCHAR) AS instance_id,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(ORDER)}) AS BIGINT) AS task_no,
       CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS arrival,
       CAST(floor(l_quantity / 10) + 1 AS BIGINT) AS processing,
       CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + floor(l_quantity / 10) + 1
            + 2 * l_linenumber AS BIGINT) AS deadline
FROM lineitem"""

RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


BUSY_SQL = f"""
WITH tk AS ({TASKS_SQL}),
x AS (SELECT *, sum(processing) OVER (PARTITION BY instance_id ORDER BY arrival, task_no {RUN}) - processing AS sprev
      FROM tk),
y AS (SELECT *, greatest(arrival, 0) - sprev AS xx FROM x),
z AS (SELECT *, max(xx) OVER (PARTITION BY instance_id ORDER BY arrival, task_no
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mprev FROM y),
n AS (SELECT *, CASE WHEN mprev IS NULL OR greatest(arrival, 0) >= mprev + sprev THEN 1 ELSE 0 END AS nw FROM z)
SELECT instance_id, task_no, arrival, processing, deadline,
       CAST(sum(nw) OVER (PARTITION BY instance_id ORDER BY arrival, task_no {RUN}) - 1 AS BIGINT) AS period
FROM n"""


@query("busy_periods", BUSY_SQL)
def q_busy_periods(spark, d):
    """E5: busy-period id of every task."""
    return busy_periods(tasks(spark, d))


@query("queue_mindl_batch", f"""
WITH tk AS ({TASKS_SQL}),
f AS (SELECT instance_id, deadline,
             sum(processing) OVER (PARTITION BY instance_id ORDER BY deadline, task_no DESC {RUN}) AS finish
      FROM tk)
SELECT instance_id, CAST(count(*) AS BIGINT) AS n_tasks,
       CAST(sum(greatest(finish - deadline, 0)) AS BIGINT) AS total_lateness
FROM f GROUP BY instance_id""")
def q_mindl_batch(spark, d):
    """D12 with every task present at time 0: MINDL order is a plain
    window, total lateness per instance."""
    f = mindl_batch(tasks(spark, d))
    return f.groupBy("instance_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_tasks"),
        F.sum(F.greatest(F.col("finish") - F.col("deadline"), F.lit(0))).cast("long").alias("total_lateness"))
