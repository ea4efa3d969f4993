"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.operators import liquidity, sessions, store, trading
from tidemark.plans import queries as engine
from tidemark.sources.testdata import exchange_events

#: At this scale a pause of 1800 s would leave three sessions; 300 s keeps many.
GAP = 300


def headline() -> dict:
    on = lambda plan: lambda s, d: plan(exchange_events(s, d))
    return {
        "trading_windows": on(trading.trading_windows),
        "trader_activity": engine.QUERIES["trader_activity"],
        "market_trends": on(trading.market_trends),
        "liquidity_windows": on(liquidity.liquidity_windows),
        "sandwich_attacks": on(lambda e: sessions.sandwiches(e, GAP)),
        "jit_liquidity": on(lambda e: sessions.jit_liquidity(e, GAP)),
        "latest_trading": on(lambda e: store.latest(trading.trading_windows(e))),
        "price_asof": engine.QUERIES["price_asof"],
        "finality_release": engine.QUERIES["finality_release"],
        "envelope_decode": engine.QUERIES["envelope_decode"],
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    exchange_events(spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session
    seconds = {}
    for name, query in headline().items():
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
