"""Score a stream of (user, item) pairs against static pools and append the
positive responses to a history table (I3 + G3 on a stream).

The response components use only the seeded uniform, so a pair gets the same
response whichever micro-batch, partition or retry evaluates it.  The append
sink writes one partition per (stream, batch): a batch that is replayed after a
failure or a restart rewrites its own partition and no other."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_stream(pairs: DataFrame, users: DataFrame, items: DataFrame, user_key: str,
                 item_key: str, actions: Mapping[str, Column]) -> DataFrame:
    """Stream-static inner joins (C3) and one column per action."""
    j = pairs.select(user_key, item_key).join(users, user_key).join(items, item_key)
    return j.withColumns(dict(actions)).select(user_key, item_key, *actions.keys())


def append_positive_responses(scored: DataFrame, history_path: str, user_key: str, item_key: str,
                              stream_id: str, checkpoint_location: str,
                              flag_col: str = "rated", value_col: str = "relevance",
                              trigger_once: bool = True):
    """G3 as a streaming sink: rows with ``flag_col == 1`` are written to
    parquet at ``history_path`` with timestamp 0, in one partition for each
    ``stream_id`` and batch.

    ``checkpoint_location`` is a lasting folder of this stream: a restart that
    names it goes on where the last run ended.  It has no default, because a
    folder that an application makes for itself is a new one after a restart,
    and the source would be read again from its start.  A stream that is meant
    to begin anew (with a new folder) takes a new ``stream_id``, so its batches
    don't overwrite those of the old one."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = (batch.where(F.col(flag_col) == 1)
               .select(user_key, item_key, F.col(value_col).cast("double").alias(value_col),
                       F.lit(0).cast("long").alias("timestamp"),
                       F.lit(stream_id).alias("stream_id"), F.lit(batch_id).cast("long").alias("batch_id")))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("stream_id", "batch_id").parquet(history_path))

    w = scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_location)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
