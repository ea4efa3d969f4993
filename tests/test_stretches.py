"""Swaps between the two of a sandwich are looked up by stretches of their block."""

from tests.test_engine import events, swap
from tidemark.operators import sessions


def test_fronts_meet_stretches_not_whole_blocks(spark):
    plan = sessions.sandwiches(events(spark, swap()), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert any(line.count("Join Inner") and "_n#" in line for line in plan.splitlines())
