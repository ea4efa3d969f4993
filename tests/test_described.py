"""Descriptions and numbers of alerts are told without making what the alerts list."""

import random

from pyspark.sql import functions as F

from tests.test_engine import BUY, SELL, events, swap
from tidemark.operators import sessions
from tidemark.plans.boundary import alert_descriptions
from tidemark.sources.testdata import exchange_events

SAID = ["alertType", "windowStart", "pairAddress", "blockNumber", "attackerAddress", "description"]


def rows_of(spark):
    r = random.Random(4)
    sides = [("Mint", dict(amount0="1", amount1="1")), ("Burn", dict(amount0="1", amount1="1"))]
    out = []
    for _ in range(150):
        kind, fields = r.choice([swap(**BUY), swap(**SELL), swap(**SELL), *sides])
        out.append((kind, fields | dict(sender=r.choice(["a", "B", "b", None]), blockNumber=r.choice([100, 101, 102, 105, None]), blockTimestamp=1_700_000_000 + r.choice([0, 1, 50]))))
    return events(spark, *out)


def test_descriptions_are_those_of_the_alerts(spark, monkeypatch):
    df = rows_of(spark)
    want = sorted(map(str, sessions.alerts(df, 3).select(*SAID).collect()))
    monkeypatch.setattr(sessions, "COPIED", 2)
    assert len(want) > 50 and sorted(map(str, sessions.descriptions(df, 3).select(*SAID).collect())) == want


def test_counts_are_those_of_the_alerts(spark):
    df = rows_of(spark)
    want = {tuple(r) for r in sessions.alerts(df, 3).groupBy("pairAddress", F.col("windowEnd").alias("detectedAt")).count().collect()}
    assert {tuple(r) for r in sessions.alert_counts(df, 3).select("pairAddress", "detectedAt", "alerts").collect()} == want


def test_descriptions_gather_no_swaps(spark):
    plan = alert_descriptions(exchange_events(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan
