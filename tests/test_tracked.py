"""Pools and their health are told from events without making their alerts."""

from tests.test_described import rows_of
from tests.test_engine import events, swap
from tidemark.operators import liquidity, sessions, store, trading
from tidemark.plans.queries import GAP, QUERIES, Computed

SF = "/root/testdata/sf0.001"


def test_no_alert_is_made(spark):
    for name in ("tracked_pairs", "leaderboard", "pool_health"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "attackerAddress" not in plan if name == "tracked_pairs" else "collect_set" not in plan


def test_pools_are_those_of_the_tables(spark):
    df = events(spark, swap(), ("Transfer", dict(value="1", pairAddress="b")), ("Mint", dict(sender="p", amount0="1", amount1="1", pairAddress="c")), swap(pairAddress=None), ("Other", dict(pairAddress="d")))
    want = store.tracked_pairs(trading.trading_windows(df), liquidity.liquidity_windows(df), sessions.alerts(df, GAP), trading.market_trends(df))
    assert sorted(map(str, Computed(df).pairs.collect())) == sorted(map(str, want.collect()))


def test_health_counts_what_the_alerts_count(spark):
    t, now = Computed(rows_of(spark)), 1_700_003_600_000
    want = store.pool_health(t.trading, t.liquidity, t.found, t.trends, now).collect()
    assert t.pool_health(now).collect() == want and want[0].recentAlertCount > 50
    assert t.pool_health(now, "nobody").first().recentAlertCount == 0
