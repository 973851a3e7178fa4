"""Session helpers: a tuned builder, the checkpoint folder and parameter
tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest parameter table (a few narrow columns, so under 1 MB) that is
# broadcast by a hint.
PARAMETER_ROWS = 10_000


def build_session(master: str | None = None, app: str = "stratakit",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with AQE, skew-join and partition coalescing on.

    ``shuffle_partitions`` defaults to 2x the local cores; on a cluster pass a
    value sized so one shuffle partition stays around 128-256 MB.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    cores = os.cpu_count() or 8
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or 2 * cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        # delete checkpoint files once their DataFrame is garbage-collected
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    ``spark.checkpoint.dir`` is read from the session. Only when it is unset and
    the master is local (tests, laptops) do we create our own folder; on a
    cluster an unset folder is an error, because a machine-local folder would
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running operators that cut lineage")
    path = tempfile.mkdtemp(prefix="stratakit-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable, survives
    executor loss) and return a DataFrame with a cut lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Spark 4.1 and later: shuffle files go when the execution that wrote them ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as compressed Parquet into the shared checkpoint folder and
    read it back.  For tables that grow with the log: smaller than
    ``checkpointed``, and the shuffle files that made them are deleted at once
    instead of when the driver next collects its garbage."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def parameter_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table made of call parameters (quota entries, quantile
    positions, ``k`` slots), whose ``rows`` are known when the plan is built.
    Tables that hold data are left to AQE, which decides on bytes at run time."""
    return F.broadcast(df) if rows <= PARAMETER_ROWS else df


def _sql_literal(v) -> str:
    import math
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "CAST('NaN' AS DOUBLE)"
        if math.isinf(v):
            return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
        return repr(v) + "D"          # shortest repr round-trips to the same double
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_table(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A small parameter table (quotas, quantile positions...) as one SQL
    ``VALUES`` relation: a JVM ``LocalRelation`` built in one call, not a
    Python RDD and not thousands of literal expressions."""
    if not rows:
        return spark.createDataFrame([], schema)
    names = [f"c{i}" for i in range(len(schema.fields))]
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST({n} AS {f.dataType.simpleString()}) AS `{f.name}`"
                     for n, f in zip(names, schema.fields))
    return spark.sql(f"SELECT {cols} FROM VALUES {values} AS t({', '.join(names)})")
