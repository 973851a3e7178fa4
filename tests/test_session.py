"""Session helpers: checkpoint folder from the session, hints for parameter
tables only."""

import contextlib
import io

from stratakit.session import PARAMETER_ROWS, ensure_checkpoint_dir, parameter_broadcast


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_checkpoint_dir_is_read_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_only_parameter_tables_are_hinted(spark):
    k = spark.range(10).withColumnRenamed("id", "k")
    facts = spark.range(100_000).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in _plan(facts.join(parameter_broadcast(k, 10), "k"))
    assert parameter_broadcast(k, PARAMETER_ROWS + 1) is k
