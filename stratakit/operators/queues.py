"""Task-set measures that are relational (E5, D12 for MINDL, busy periods).

A task set ("instance") holds tasks ``(task_no, arrival, processing,
deadline)`` for one non-preemptive server.  Every scheduling rule that keeps
the server busy while work waits has the same *busy periods*; they, the task
numbers and the MINDL order of tasks that are all there at time 0 are running
sums and maxima.  These are computed as chunked prefix scans over one globally
sorted index, whatever the size of an instance: windows run inside
(instance, chunk) segments of at most ``CHUNK_ROWS`` rows, and a small
per-segment table carries sums and maxima of earlier segments.

Replaying the rules step by step is a queue simulator and not part of this
package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakit.operators.index import row_index_sorted

CHUNK_ROWS = 100_000


def number_tasks(df: DataFrame, instance: str, order: list[str], out_col: str = "task_no") -> DataFrame:
    """E5: task number 1..n inside each instance in the given order: one global
    index over (instance, order) minus each instance's first index (a partial
    aggregate), so a huge task set is never numbered in a single task."""
    g = row_index_sorted(df, [F.col(instance)] + [F.col(c) for c in order], "_g")
    first = g.groupBy(instance).agg(F.min("_g").alias("_g0"))
    return (g.join(first, instance)
            .withColumn(out_col, (F.col("_g") - F.col("_g0") + 1).cast("long"))
            .drop("_g", "_g0"))


def busy_periods(tasks: DataFrame, instance: str = "instance_id", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Busy-period id (0-based, per instance) for every task.

    In (arrival, task_no) order with S the running processing sum, the work
    queued before task i ends at ``max_{j<i}(a_j - S_{j-1}) + S_{i-1}``; task
    i opens a new period when it arrives at or after that instant."""
    a = F.greatest(F.col("arrival"), F.lit(0))
    cols = tasks.columns
    g = row_index_sorted(tasks, [F.col(instance), F.col("arrival"), F.col("task_no")], "_g")
    g = g.withColumn("_c", F.floor(F.col("_g") / F.lit(chunk_rows)).cast("long"))
    seg = [instance, "_c"]
    w = Window.partitionBy(*seg).orderBy("_g")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # local scan inside a segment
    x = (g.withColumn("_sl", F.sum("processing").over(run))
         .withColumn("_slprev", F.col("_sl") - F.col("processing"))
         .withColumn("_xl", a - F.col("_slprev")))
    # carries from earlier segments of the same instance (one row per segment)
    segs = x.groupBy(*seg).agg(F.sum("processing").alias("_p"), F.max("_xl").alias("_mx"))
    sw = Window.partitionBy(instance).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.withColumn("_sbefore", F.coalesce(F.sum("_p").over(sw), F.lit(0)))
    segs = segs.withColumn("_mbefore", F.max(F.col("_mx") - F.col("_sbefore")).over(sw))
    x = x.join(segs.select(*seg, "_sbefore", "_mbefore"), seg)
    sprev = F.col("_sbefore") + F.col("_slprev")
    x = x.withColumn("_mloc", F.max(F.col("_xl") - F.col("_sbefore")).over(before))
    mprev = F.greatest(F.col("_mbefore"), F.col("_mloc"))   # greatest skips nulls
    x = x.withColumn("_new", F.when(mprev.isNull() | (a >= mprev + sprev), 1).otherwise(0))
    # running count of period starts, with the same carry
    x = x.withColumn("_nl", F.sum("_new").over(run))
    nseg = x.groupBy(*seg).agg(F.sum("_new").alias("_n"))
    nseg = nseg.withColumn("_nbefore", F.coalesce(F.sum("_n").over(sw), F.lit(0)))
    x = x.join(nseg.select(*seg, "_nbefore"), seg)
    return x.select(*cols, (F.col("_nbefore") + F.col("_nl") - 1).cast("long").alias("period"))


def mindl_batch(tasks: DataFrame, instance: str = "instance_id", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """MINDL when every task of an instance is there at time 0: the run order
    is (deadline, larger task_no first), so finish = running sum of
    processing in that order."""
    cols = tasks.columns
    g = row_index_sorted(tasks, [F.col(instance), F.col("deadline"), F.col("task_no").desc()], "_g")
    g = g.withColumn("_c", F.floor(F.col("_g") / F.lit(chunk_rows)).cast("long"))
    seg = [instance, "_c"]
    run = Window.partitionBy(*seg).orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = g.withColumn("_sl", F.sum("processing").over(run))
    segs = x.groupBy(*seg).agg(F.sum("processing").alias("_p"))
    sw = Window.partitionBy(instance).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.withColumn("_before", F.coalesce(F.sum("_p").over(sw), F.lit(0)))
    return (x.join(segs.select(*seg, "_before"), seg)
            .select(*cols, (F.col("_before") + F.col("_sl")).alias("finish")))
