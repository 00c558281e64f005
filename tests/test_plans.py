"""Physical plans: nothing is crossed, and no window gets everything."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry

NAMES = [
    "j1_outer_null_keys", "e23_label_encode", "e24_frequency_encode", "w1_group_stats",
    "w2_group_rank", "w3_lag_by_key", "w3_lag_whole_table", "r3_row_position", "v4_histogram",
    "v5_box", "m19_confusion_matrix", "m23_roc_curve", "t5_association_rules", "t8_sessions",
    "t12_shared_context", "z2_future_calendar",
]


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, name):
    df = entry.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if "Window " in plan:
        assert "SinglePartition" not in plan
