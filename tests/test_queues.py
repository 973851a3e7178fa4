"""Busy periods, MINDL totals and task numbers against plain loops, for several
chunk sizes (golden cases of FIXTURES.md section 3)."""

import pytest

from stratakit.operators.queues import busy_periods, mindl_batch, number_tasks
from stratakit.plans.queues import tasks as supplier_tasks
from tests.conftest import SF001

A = [(1, 0, 4, 5), (2, 0, 2, 3), (3, 1, 8, 10), (4, 12, 1, 16)]


def _df(spark, tasks, inst="x"):
    return spark.createDataFrame([(inst, t[0], *map(float, t[1:])) for t in tasks],
                                 "instance_id string, task_no long, arrival double, processing double, deadline double")


def _periods(tasks):
    out, free, period = {}, None, -1
    for no, arrival, processing, _ in sorted(tasks, key=lambda t: (t[1], t[0])):
        arrival = max(arrival, 0)
        if free is None or arrival >= free:
            period, free = period + 1, arrival
        free += processing
        out[no] = period
    return out


def test_busy_periods(spark):
    p = {r["task_no"]: r["period"] for r in busy_periods(_df(spark, A)).collect()}
    assert set(p.values()) == {0}
    moved = [t if t[0] != 4 else (4, 20, 1, 16) for t in A]
    p2 = {r["task_no"]: r["period"] for r in busy_periods(_df(spark, moved)).collect()}
    assert p2 == {1: 0, 2: 0, 3: 0, 4: 1}


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_scans_equal_loops(spark, chunk):
    tk = supplier_tasks(spark, SF001)
    by = {}
    for r in tk.collect():
        by.setdefault(r["instance_id"], []).append((r["task_no"], r["arrival"], r["processing"], r["deadline"]))
    got = {(r["instance_id"], r["task_no"]): r["period"] for r in busy_periods(tk, chunk_rows=chunk).collect()}
    assert got == {(i, no): p for i, tasks in by.items() for no, p in _periods(tasks).items()}
    finish = {(r["instance_id"], r["task_no"]): r["finish"] for r in mindl_batch(tk, chunk_rows=chunk).collect()}
    for i, tasks in by.items():
        clock = 0
        for no, _, processing, _ in sorted(tasks, key=lambda t: (t[3], -t[0])):
            clock += processing
            assert finish[i, no] == clock


def test_number_tasks(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    rows = number_tasks(li, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r["l_suppkey"], []).append((r["task_no"], tuple(r)[1:4]))
    for tasks in by.values():
        tasks.sort()
        assert [n for n, _ in tasks] == list(range(1, len(tasks) + 1))
        assert [k for _, k in tasks] == sorted(k for _, k in tasks)
