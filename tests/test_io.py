"""Round trips of the sources and sinks in a scratch folder."""

import os
import tempfile

import pandas as pd
import pytest

from stratakit.operators.queues import mindl_batch
from stratakit.sources.io import (from_pandas, load_params, read_task_sets, save_params,
                                  write_table)


def test_task_sets_folder_and_csv_sink(spark):
    d = tempfile.mkdtemp(prefix="stratakit-io-")
    os.makedirs(f"{d}/in")
    pd.DataFrame({"line": [30, 10, 20, 40], "arrival": [1, 0, 0, 12], "processing": [8, 4, 2, 1],
                  "deadline": [10, 5, 3, 16]}).to_csv(f"{d}/in/a.csv", index=False)
    pd.DataFrame({"line": [1, 2], "arrival": [0, 0], "processing": [2, 6], "deadline": [4, 7]}).to_csv(
        f"{d}/in/b.csv", index=False)
    tasks = read_task_sets(spark, f"{d}/in", "line")
    got = {(r["instance_id"], r["task_no"]): r["processing"] for r in tasks.collect()}
    assert got == {("a.csv", 1): 4.0, ("a.csv", 2): 2.0, ("a.csv", 3): 8.0, ("a.csv", 4): 1.0,
                   ("b.csv", 1): 2.0, ("b.csv", 2): 6.0}
    write_table(mindl_batch(tasks).select("instance_id", "task_no", "finish"), f"{d}/out", fmt="csv")
    back = {(r["instance_id"], r["task_no"]): float(r["finish"])
            for r in spark.read.option("header", True).csv(f"{d}/out").collect()}
    assert back["a.csv", "2"] == 2.0 and back["a.csv", "4"] == 15.0


def test_task_sets_without_an_order_column(spark):
    d = tempfile.mkdtemp(prefix="stratakit-io-")
    os.makedirs(f"{d}/in")
    n = {"a.csv": 4000, "b.csv": 3}
    for name, rows in n.items():
        with open(f"{d}/in/{name}", "w") as f:
            f.write("arrival,processing,deadline\n" + "".join(f"{i * 7919 % 4001},{i},{i % 5}\n" for i in range(rows)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        tasks = read_task_sets(spark, f"{d}/in")
        assert spark.read.csv(f"{d}/in").rdd.getNumPartitions() > 8                  # the large file has several splits
        assert {(r["instance_id"], r["task_no"], r["processing"]) for r in tasks.collect()} == \
            {(name, i + 1, float(i)) for name, rows in n.items() for i in range(rows)}
        tasks.where("instance_id = 'a.csv'").orderBy("task_no").select("arrival", "processing", "deadline").coalesce(1) \
            .write.option("parquet.block.size", 1024).parquet(f"{d}/p")
        again = read_task_sets(spark, f"{d}/p", fmt="parquet")
        assert [r["processing"] for r in again.orderBy("task_no").collect()] == [float(i) for i in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_from_pandas_and_params(spark):
    with pytest.raises(ValueError):
        from_pandas(spark, pd.DataFrame())
    with pytest.raises(TypeError):
        from_pandas(spark, [1, 2])
    assert from_pandas(spark, pd.DataFrame({"a": [1, 2]})).count() == 2
    d = tempfile.mkdtemp(prefix="stratakit-params-")
    save_params(spark, {"lambda": [0.1, -0.2, 0.1], "edges": [1.0, 2.0]}, f"{d}/p")
    assert load_params(spark, f"{d}/p") == {"lambda": [0.1, -0.2, 0.1], "edges": [1.0, 2.0]}
