"""Just-in-time pairs are made after the last shuffle, from lists of mints and burns."""

from pyspark.sql import functions as F

from tidemark.operators import sessions
from tidemark.plans.queries import GAP
from tidemark.sources.testdata import exchange_events


def test_no_pair_is_shuffled(spark):
    found = sessions.jit_liquidity(exchange_events(spark, "/root/testdata/sf0.001"), GAP)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join ")]  # above the last join
    assert "explode(_mints" in top and "explode(_burns" in top and "Repartition" not in top


def test_long_lists_are_cut_and_lose_no_pair(spark, monkeypatch):
    raw = exchange_events(spark, "/root/testdata/sf0.001")
    hot = raw.withColumns({"blockNumber": F.lit(7).cast("long"), "blockTimestamp": F.lit(1_700_000_000).cast("long"), "pairAddress": F.lit("p")})
    ids = lambda: sorted(r.alertId for r in sessions.jit_liquidity(hot, GAP).select("alertId").collect())
    whole = ids()
    count = {(r.eventType, r.who): r["count"] for r in hot.groupBy("eventType", F.lower("sender").alias("who")).count().collect()}
    assert len(whole) == len(set(whole)) == sum(n * count.get(("Burn", who), 0) for (kind, who), n in count.items() if kind == "Mint")
    monkeypatch.setattr(sessions, "LISTED", 7)
    assert ids() == whole
