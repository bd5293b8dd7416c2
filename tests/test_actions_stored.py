"""The action log is folded from one stored table, not derived anew by every read of it."""

from fleetfold.plans.deadletter_queries import _actions
from fleetfold.schemas import DLQ_ACTIONS, columns


def test_actions_are_stored_once(spark):
    actions = _actions(spark, "/root/testdata/sf0.001")
    assert "Union" not in actions._jdf.queryExecution().optimizedPlan().toString()
    assert actions.columns == columns(DLQ_ACTIONS) and actions.filter("action = 'mark'").count() > 0
