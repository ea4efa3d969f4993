"""As-of prices: the latest price round of a token at a time, unless it is older than a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STALE_SECONDS = 86_400


def price_asof(asked: DataFrame, rounds: DataFrame, stale: int = STALE_SECONDS) -> DataFrame:
    """id, token, at and usd for rows (id, token, at in seconds); usd is null without a round in the `stale` seconds before.

    A usable round is of the same span of `stale` seconds or the one before, so rounds are filed under both, and one
    window per (token, span) finds the last one: a token with many rows is spread over its spans.
    """
    span = lambda c: F.floor(F.col(c) / stale)
    priced = rounds.select("token", F.col("updatedAt").alias("at"), (F.col("answer").cast("double") / F.pow(F.lit(10.0), "decimals")).alias("_usd"))
    priced = priced.groupBy("token", "at").agg(F.max("_usd").alias("_usd"))  # of rounds at one time, the greater answer
    filed = priced.select("token", "at", "_usd", F.explode(F.array(span("at"), span("at") + 1)).alias("_span"))
    both = asked.select("id", "token", "at", span("at").alias("_span"), F.lit(True).alias("_asked")).unionByName(filed.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy("token", "_span").orderBy("at", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(~F.col("_asked"), F.struct("at", "_usd")), ignorenulls=True).over(upto)
    found = both.withColumn("_last", last).where("_asked")
    return found.select("id", "token", "at", F.when(F.col("at") - F.col("_last.at") <= stale, F.col("_last._usd")).alias("usd"))


def usd_prices(asked: DataFrame, rounds: DataFrame, stablecoins: list[str]) -> DataFrame:
    """As price_asof, with 1 for stablecoins."""
    found = price_asof(asked, rounds)
    return found.withColumn("usd", F.when(F.col("token").isin(*stablecoins), 1.0).otherwise(F.col("usd"))) if stablecoins else found
