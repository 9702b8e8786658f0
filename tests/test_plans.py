"""Plan guards: no registered query uses a cross join (Cartesian product / nested-loop join)."""

import pytest

from evalspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SKIP = {"k_sweep", "cluster_crosstab", "topic_crosstab", "topic_cluster_labels", "sweep_sizes", "balanced_sample"}  # needs sf>=0.01


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_cross_join(spark, name):
    plan = physical_plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scoring_scan_prunes_columns(spark):
    from evalspark.plans.queries import stub_predictions

    plan = physical_plan(stub_predictions(spark, SF))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    # documents once; labels twice (keys for the broadcast semi-join filter, truth for the narrow join)
    assert len(scans) == 3
    assert all("toxic" not in s for s in scans)  # labels.toxic is never read
    assert sum("ReadSchema: struct<doc_id:bigint>" in s for s in scans) == 1
    assert all("IsNotNull(doc_id)" in s for s in scans)  # the join key filter reaches every scan
