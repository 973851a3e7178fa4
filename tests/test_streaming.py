"""Streaming scoring equals batch scoring on the same pairs."""

import tempfile

from pyspark.sql import functions as F

from stratakit.operators.responses import bernoulli_response, score_responses
from stratakit.sources import tables as t
from stratakit.streaming.responses import append_positive_responses, score_stream
from tests.conftest import SF001


def test_stream_matches_batch(spark):
    scratch = tempfile.mkdtemp(prefix="stratakit-stream-")
    pairs = t.history(spark, SF001).select("user_id", "item_id").distinct()
    pairs.write.parquet(f"{scratch}/pairs")
    stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/pairs")
    users, items = t.users(spark, SF001), t.items(spark, SF001)
    actions = {"rated": bernoulli_response(42, 0.3, "user_id", "item_id"),
               "relevance": F.col("price") / 1000.0}
    scored = score_stream(stream, users, items, "user_id", "item_id", actions)
    q = append_positive_responses(scored, f"{scratch}/history", "user_id", "item_id",
                                  "replies", f"{scratch}/ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{scratch}/history").select("user_id", "item_id", "relevance")
    want = (score_responses(pairs, users, items, "user_id", "item_id", actions)
            .where("rated = 1").select("user_id", "item_id", "relevance"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() > 0


def _drain(spark, scratch, stream_id, ckpt):
    stream = (spark.readStream.schema("user_id long, item_id long").option("maxFilesPerTrigger", 1)
              .parquet(f"{scratch}/pairs"))
    users = spark.createDataFrame([(i, 1.0) for i in range(9)], "user_id long, a double")
    items = spark.createDataFrame([(i, 1.0) for i in range(9)], "item_id long, b double")
    scored = score_stream(stream, users, items, "user_id", "item_id",
                          {"rated": F.lit(1), "relevance": F.col("a") + F.col("b")})
    append_positive_responses(scored, f"{scratch}/history", "user_id", "item_id", stream_id, ckpt).awaitTermination(120)
    rows = spark.read.parquet(f"{scratch}/history").select("user_id", "item_id").collect()
    return sorted(tuple(r) for r in rows)


def test_restart_with_a_new_application_folder_appends_once(spark):
    """Runs go on from the stream's own folder, whatever checkpoint folder the
    application has; other streams and batches are left alone."""
    scratch = tempfile.mkdtemp(prefix="stratakit-restart-")
    sc, before = spark.sparkContext, spark.sparkContext.getCheckpointDir()

    def add(*rows):
        spark.createDataFrame(rows, "user_id long, item_id long").coalesce(1).write.mode("append").parquet(
            f"{scratch}/pairs")
    try:
        add((1, 1))
        assert _drain(spark, scratch, "s", f"{scratch}/ckpt") == [(1, 1)]
        add((2, 2))
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stratakit-app2-"))
        assert _drain(spark, scratch, "s", f"{scratch}/ckpt") == [(1, 1), (2, 2)]
        add((3, 3))
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stratakit-app3-"))
        assert _drain(spark, scratch, "s", f"{scratch}/ckpt") == [(1, 1), (2, 2), (3, 3)]
        # a new stream over the same source keeps its own partitions
        assert _drain(spark, scratch, "t", f"{scratch}/ckpt-t") == sorted([(1, 1), (2, 2), (3, 3)] * 2)
    finally:
        sc._jsc.sc().setCheckpointDir(before)
