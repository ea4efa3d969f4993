"""Reads the driver's `events` table as exchange events, and derives dimension tables from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZEROS = "0000000000000000"


def exchange_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_exchange_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_exchange_events(raw: DataFrame) -> DataFrame:
    """One wide row per event: eventType tells which columns hold values. Works on batch and streaming tables."""
    kind = F.when(F.col("event_type").isin("purchase", "click"), "Swap").when(F.col("event_type") == "signup", "Mint").when(F.col("event_type") == "error", "Burn").when(F.col("event_type") == "view", "Transfer")
    n, user = F.col("event_id"), F.col("user_id")
    cents = F.round(F.col("value") * 100).cast("long")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    amount = lambda k: F.concat((cents + k).cast("string"), F.lit(ZEROS))
    on = lambda kinds, value: F.when(F.col("eventType").isin(*kinds), value)
    swap, both, move = ["Swap"], ["Mint", "Burn"], ["Transfer"]
    half = F.floor(n / 2).cast("long")
    index = F.pmod(half, F.lit(3)).cast("string")
    trader = lambda x: F.concat(F.lit("Trader-"), F.pmod(x, F.lit(4)).cast("string"))
    even = F.pmod(n, F.lit(2)) == 0
    base = raw.withColumn("eventType", kind).where("eventType is not null")
    return base.select(
        F.concat(F.lit("tx-"), half.cast("string"), F.lit(":"), F.pmod(n, F.lit(1000)).cast("string")).alias("eventId"),
        "eventType",
        F.floor(seconds / 3600).cast("long").alias("blockNumber"),
        seconds.alias("blockTimestamp"),
        F.concat(F.lit("tx-"), half.cast("string")).alias("transactionHash"),
        F.pmod(n, F.lit(1000)).cast("int").alias("logIndex"),
        F.concat(F.lit("pool-"), index).alias("pairAddress"),
        F.lit("token-a").alias("token0"),
        F.lit("token-b").alias("token1"),
        F.when(F.pmod(n, F.lit(5)) != 0, F.concat(F.lit("TK"), index)).alias("token0Symbol"),
        F.lit("USDX").alias("token1Symbol"),
        on(["Swap", "Mint", "Burn"], trader(user)).alias("sender"),
        on(["Swap", "Burn"], trader(F.floor(user / 4).cast("long"))).alias("recipient"),
        on(swap, F.when(even, amount(1)).otherwise("0")).alias("amount0In"),
        on(swap, F.when(even, "0").otherwise(amount(2))).alias("amount1In"),
        on(swap, F.when(even, "0").otherwise(amount(1))).alias("amount0Out"),
        on(swap, F.when(even, amount(2)).otherwise("0")).alias("amount1Out"),
        on(swap, F.lit(1.0) + F.pmod(cents, F.lit(500)) / 1000).alias("price"),
        on(swap, F.when(F.pmod(n, F.lit(7)) != 0, cents / 100)).alias("volumeUSD"),
        on(swap, F.lit(21000) + F.pmod(n, F.lit(1000))).cast("long").alias("gasUsed"),
        on(swap, F.concat((F.lit(30) + F.pmod(n, F.lit(50))).cast("string"), F.lit("000000000"))).alias("gasPrice"),
        on(both, amount(3)).alias("amount0"),
        on(both, amount(4)).alias("amount1"),
        on(move, trader(user)).alias("from"),
        on(move, trader(user + 1)).alias("to"),
        on(move, amount(5)).alias("value"),
        seconds.alias("eventTimestamp"),
        n.alias("seq"),
        F.timestamp_seconds(seconds).alias("event_time"),
    )
