"""Physical-plan properties that the scale design relies on."""

import contextlib
import io
import re

from pyspark.sql import functions as F

import __spark_entry__ as se
from tests.conftest import SF01

Q = se.queries()


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_topk_uses_partial_window_group_limit(spark):
    for name in ("topk_wilson", "topk_random"):
        plan = _plan(Q[name](spark, SF01))
        assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_history_scans_are_pruned_and_filtered(spark):
    plan = _plan(Q["train_log"](spark, SF01))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    li = [s for s in schemas if "l_orderkey" in s]
    assert li and all("l_comment" not in s and "l_extendedprice" not in s for s in li)
    assert "LessThanOrEqual(p_size,25)" in plan


def test_no_python_udf_on_row_paths(spark):
    for name in ("score_responses", "stratified_sample", "text_embedding", "clean_tokens", "user_vectors"):
        plan = _plan(Q[name](spark, SF01))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_stratified_sample_has_no_global_sort_of_the_pool(spark):
    plan = _plan(Q["stratified_sample"](spark, SF01))
    # only range partitioning would indicate a global sort; the sample uses hash bins
    assert "rangepartitioning" not in plan.lower()


def test_rating_features_are_joined_once_for_the_quantiles(spark, monkeypatch):
    from stratakit.plans import strata
    reads, own = [], strata.user_rating_features
    monkeypatch.setattr(strata, "quantile_strata", lambda f, c, q, out: reads.append(
        f._jdf.queryExecution().optimizedPlan().toString()) or f.withColumn(out, F.lit(0)))
    monkeypatch.setattr(strata, "user_rating_features", lambda s, d: own(s, d))
    strata._quantile_subset(spark, SF01)
    assert len(reads) == 2 and not any("Join" in r or "Aggregate" in r for r in reads)
