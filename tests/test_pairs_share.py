"""What the pairs of a just-in-time span share is made once, and pairs are not shuffled with it."""

from pyspark.sql import functions as F

from tidemark.operators import sessions
from tidemark.plans.queries import ALERT_COLUMNS, GAP
from tidemark.sources.testdata import exchange_events


def test_texts_go_into_a_sorted_array_once(spark):
    df = spark.createDataFrame([(["b", "d"], "c", "a"), (["b", "d"], "d", "d"), (["b", "d"], "e", "e"), (["b", "d"], None, "c"), ([], None, None)], "known array<string>, x string, y string")
    assert [r[0] for r in df.select(sessions._with(*map(F.col, ("known", "x", "y")))).collect()] == [["a", "b", "c", "d"], ["b", "d"], ["b", "d", "e"], ["b", "c", "d", None], [None]]


def test_swaps_of_a_span_come_to_its_pairs_last(spark):
    found = sessions.jit_liquidity(exchange_events(spark, "/root/testdata/sf0.001"), GAP).select(*ALERT_COLUMNS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_union" not in plan
    joined = plan[: plan.index("Join ")]  # above the last join
    assert "sort_array" in joined
