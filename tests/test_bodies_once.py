"""Bodies are encoded and decoded once, and a message is parsed once, whatever is asked of the result."""

from tidemark.plans import boundary, queries
from tidemark.sources.testdata import exchange_events


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_messages_are_parsed_and_bodies_made_once(spark):
    events = exchange_events(spark, "/root/testdata/sf0.001")
    swaps, moves = plan_of(queries.avro_round_trip(events)), plan_of(boundary.avro_liquidity(events))
    assert swaps.count("ArrowEvalPython") == 2  # one to make bodies, one to read them
    assert moves.count("ArrowEvalPython") == 4  # one for each kind to make bodies, one to read them all
    assert swaps.count("parseJson") == moves.count("parseJson") == 1
