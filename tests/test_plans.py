"""Physical-plan properties that the scale design relies on."""

import contextlib
import io
import re

import __spark_entry__ as E
from tests.conftest import SF_SMALL

Q = E.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_keep_first_is_partial_aggregate(spark):
    p = plan(Q["dedup_first_per_key"](spark, SF_SMALL))
    assert "partial_min_by" in p
    assert "Window" not in p


def test_lead_runs_in_range_segments(spark):
    p = plan(Q["encounters_adapter"](spark, SF_SMALL))
    # the row-level window is partitioned by (range partition, customer), never
    # by customer alone over all of a customer's rows
    assert re.search(r"lead\(o_orderdate#\d+, 1, null\) windowspecdefinition\(__pid#\d+, o_custkey", p)
    assert not re.search(r"lead\(o_orderdate#\d+, 1, null\) windowspecdefinition\(o_custkey#\d+L, o_orderdate", p)


def test_dashboard_scan_is_pruned(spark):
    p = plan(Q["group_age_gender"](spark, SF_SMALL))
    m = re.search(r"ReadSchema: struct<([^>]*)>", p)
    cols = {c.split(":")[0] for c in m.group(1).split(",")}
    assert cols == {"age_group", "gender", "risk_score", "risk_level"}
    assert "partial_avg" in p


def test_filters_pushed_to_scan(spark):
    p = plan(Q["filters"](spark, SF_SMALL))
    assert "PushedFilters" in p and "EqualTo(risk_level,High)" in p


def test_topk_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(Q["topk_score"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan(Q["hash_sample"](spark, SF_SMALL))


def test_no_exact_percentile_in_warehouse_jobs(spark):
    for name in ("silver_job", "clean_job", "feature_job"):
        p = plan(Q[name](spark, SF_SMALL))
        assert "percentile(" not in p and "median(" not in p, name


def test_pivot_values_given(spark):
    # no extra distinct job over the pivot column: the plan aggregates with fixed values
    p = plan(Q["stacked_pivot"](spark, SF_SMALL))
    assert "pivotfirst" in p.lower() or "count(" in p
