"""Plans keep the properties they were written for."""

import pytest

from faultfold.plans import catalog, fixtures


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["claim_outcome", "signature_running_count", "repeat_candidates", "repeat_scores", "report_upsert",
     "signature_table", "new_events", "pack_batches", "impact_rollup"],
)
def test_no_pairwise_joins(spark, sf_dir, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rollup_shuffles_once_after_combining(spark, sf_dir):
    plan = plan_of(catalog.QUERIES["incident_rollup"](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange") < plan.index("partial_count")


def test_unused_payload_is_not_read(spark, sf_dir):
    plan = plan_of(fixtures.error_logs(spark, sf_dir).select("insert_id"))
    assert "props" not in plan.split("ReadSchema")[1]


def test_redaction_stays_native(spark, sf_dir):
    plan = plan_of(catalog.QUERIES["redact_documents"](spark, sf_dir))
    assert "Python" not in plan and "*(1)" in plan
