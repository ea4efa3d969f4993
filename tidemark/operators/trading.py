"""Trading windows: price, volume and trader activity per pool and window, and trends over sliding windows.

Sliding windows are put together from panes (tumbling windows of the slide), so each event is aggregated once, not once
per window that holds it. Traders are counted over (window, pool, trader), which bounds what a task holds for a hot pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bigint
from tidemark.functions import scalars as S
from tidemark.functions.joins import null_safe
from tidemark.schemas import TRADING

KEYS = ["window", "pairAddress"]


def swaps_of(events: DataFrame) -> DataFrame:
    return events.where(F.col("eventType") == "Swap")


def _order() -> Column:
    return F.struct("blockTimestamp", "logIndex", "seq")


def partials(swaps: DataFrame, window: Column, by: tuple[str, ...] = (), only: Column | None = None) -> DataFrame:
    """Mergeable states per (window, pool, *by): everything but trader counts. merge() joins them; finish() reads them.

    Rows where `only` is false belong to a group but add nothing to its state; n counts all rows.
    """
    if only is not None:
        swaps = swaps.withColumns({c: F.when(only, F.col(c)) for c in ("price", "volumeUSD", "gasUsed", "amount0In", "amount1In", "amount0Out", "amount1Out", "gasPrice", "token0Symbol", "token1Symbol")})
    counted = F.lit(True) if only is None else only
    vol0 = (bigint.to_double(F.col("amount0In")) + bigint.to_double(F.col("amount0Out"))).alias("vol0")
    sender, recipient = S.address(F.col("sender")), S.address(F.col("recipient"))
    rows = swaps.withColumn("window", window).withColumn("vol0", vol0).withColumn("_order", _order())
    rows = rows.withColumns({f"_{c}": bigint.padded(F.col(c)) for c in ("amount0In", "amount1In", "amount0Out", "amount1Out", "gasPrice")})
    rows = rows.withColumns({f"_{c}": bigint.parsed(f"_{c}") for c in ("amount0In", "amount1In", "amount0Out", "amount1Out", "gasPrice")})
    rows = rows.withColumns({f"_volume{k}": bigint.added(f"_amount{k}In", f"_amount{k}Out") for k in (0, 1)})
    # Without a USD value a swap counts by its token0 volume; the seed (0, no address) wins against none of it.
    by_volume = bigint.sort_key("_volume0")
    rows = rows.withColumn("_rank", F.when(F.col("volumeUSD").isNotNull(), F.struct(F.lit(1).alias("p"), F.col("volumeUSD").alias("u"), F.lit("").alias("v"), (-F.col("seq")).alias("s"))).when(counted & (F.col("vol0") > 0), F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("u"), by_volume.alias("v"), (-F.col("seq")).alias("s"))))
    rows = rows.withColumn("_largest", F.struct("_rank", F.col("volumeUSD").alias("usd"), sender.alias("sender")))
    symbol = lambda k: F.min(F.when(S.not_blank(F.col(f"token{k}Symbol")).isNotNull(), F.struct("seq", F.col(f"token{k}Symbol").alias("v")))).alias(f"symbol{k}")
    return rows.groupBy(*KEYS, *by).agg(
        symbol(0),
        symbol(1),
        F.sum(F.col("price") * F.col("vol0")).alias("weighted"),
        F.sum("vol0").alias("weight"),
        F.min(F.when(counted, F.struct("_order", "price"))).alias("first"),
        F.max(F.when(counted, F.struct("_order", "price"))).alias("last"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        bigint.total("_volume0").alias("volume0"),
        bigint.total("_volume1").alias("volume1"),
        F.sum("volumeUSD").alias("usd"),
        F.count_if(counted).alias("swaps"),
        F.sum("gasUsed").alias("gas"),
        bigint.total("_gasPrice").alias("gasPrice"),
        F.sum((counted & (sender == recipient)).cast("int")).alias("arbitrage"),
        F.max(F.when(F.col("_rank").isNotNull(), F.col("_largest"))).alias("largest"),
        F.count("*").alias("n"),
    )


def merge(states: DataFrame, keys: list[str] | None = None, *more: Column) -> DataFrame:
    """States of the same keys as one: associative, and any split of the swaps gives the same result. more: further aggregates."""
    return states.groupBy(*(keys or KEYS)).agg(
        F.min("symbol0").alias("symbol0"), F.min("symbol1").alias("symbol1"),
        F.sum("weighted").alias("weighted"), F.sum("weight").alias("weight"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"),
        bigint.merged("volume0"), bigint.merged("volume1"), F.sum("usd").alias("usd"), F.sum("swaps").alias("swaps"), F.sum("gas").alias("gas"),
        bigint.merged("gasPrice"), F.sum("arbitrage").alias("arbitrage"), F.max("largest").alias("largest"),
        *more,
    )


def trader_states(swaps: DataFrame, window: Column) -> DataFrame:
    """States per (window, pool, trader), n with the trader's swaps. A swap stands under each of its traders and adds to the state
    under the first of them only."""
    both = F.array_distinct(F.array(S.address(F.col("sender")), S.address(F.col("recipient"))))
    return partials(swaps.select("*", F.posexplode(both).alias("_at", "trader")), window, ("trader",), F.col("_at") == 0)


def with_traders(states: DataFrame) -> DataFrame:
    """States per (window, pool, trader) rolled up to (window, pool), with uniqueTraders and repeatedTraders (three swaps or more, sorted)."""
    often = F.array_sort(F.collect_list(F.when(F.col("n") >= 3, F.col("trader"))))
    return merge(states, None, F.count("*").cast("int").alias("uniqueTraders"), often.alias("repeatedTraders"))


def windows_with_traders(swaps: DataFrame, window: Column) -> DataFrame:
    """States with traders per (window, pool) from one pass, for streams, which cannot join an aggregate with another: over
    (window, pool, trader) first, which splits a hot pool, and then over (window, pool)."""
    return with_traders(trader_states(swaps, window))


def traders(swaps: DataFrame, window: Column) -> DataFrame:
    """(window, pool, trader) with the number of swaps the trader is in, once per swap."""
    both = F.explode(F.array_distinct(F.array(S.address(F.col("sender")), S.address(F.col("recipient"))))).alias("trader")
    return swaps.select(window.alias("window"), "pairAddress", both).groupBy(*KEYS, "trader").agg(F.count("*").alias("n"))


def trader_activity(counted: DataFrame) -> DataFrame:
    """uniqueTraders and repeatedTraders (three swaps or more, sorted) per (window, pool)."""
    return counted.groupBy(*KEYS).agg(F.count("*").cast("int").alias("uniqueTraders"), F.array_sort(F.collect_list(F.when(F.col("n") >= 3, F.col("trader")))).alias("repeatedTraders"))


def _prices(state: DataFrame) -> DataFrame:
    close = F.col("last.price")
    return state.withColumn("_twap", F.when(F.col("weight") > 0, F.col("weighted") / F.col("weight")).otherwise(close))


def finish(state: DataFrame, *keep: str) -> DataFrame:
    """Results of merged states, with window bounds in milliseconds."""
    start, end = S.millis(F.col("window.start")), S.millis(F.col("window.end"))
    largest = F.col("largest")
    volatility = F.when(F.col("_twap") > 0, (F.col("high") - F.col("low")) / F.col("_twap")).otherwise(F.lit(0.0))
    by_volume = F.substring_index(largest["_rank"]["v"], ":", -1)
    return _prices(state).select(
        S.window_id(F.col("pairAddress"), start, end).alias("windowId"),
        start.alias("windowStart"),
        end.alias("windowEnd"),
        "pairAddress",
        F.col("symbol0.v").alias("token0Symbol"),
        F.col("symbol1.v").alias("token1Symbol"),
        S.round8(F.col("_twap")).alias("twap"),
        S.round8(F.col("first.price")).alias("openPrice"),
        S.round8(F.col("last.price")).alias("closePrice"),
        S.round8(F.col("high")).alias("highPrice"),
        S.round8(F.col("low")).alias("lowPrice"),
        S.round8(volatility).alias("priceVolatility"),
        bigint.to_text("volume0").alias("totalVolume0"),
        bigint.to_text("volume1").alias("totalVolume1"),
        S.round8(F.col("usd")).alias("volumeUSD"),
        F.col("swaps").cast("int").alias("swapCount"),
        F.when(largest.isNull(), "0").when(largest["usd"].isNotNull(), S.usd_text(largest["usd"])).otherwise(by_volume).alias("largestSwapValue"),
        F.coalesce(largest["sender"], F.lit("")).alias("largestSwapAddress"),
        F.col("gas").alias("totalGasUsed"),
        bigint.divided("gasPrice", F.col("swaps")).alias("averageGasPrice"),
        F.col("arbitrage").cast("int").alias("arbitrageCount"),
        "window",
        *keep,
    )


def trading_windows(events: DataFrame, minutes: int = 5) -> DataFrame:
    """One row per pool and tumbling window that has swaps: one narrow aggregate of the swaps and one of their traders, joined by
    window. (One wide aggregate by trader, as on streams, would carry each window's whole state once for every trader.)"""
    swaps, window = swaps_of(events), F.window("event_time", f"{minutes} minutes")
    return finish(null_safe(partials(swaps, window), trader_activity(traders(swaps, window)), KEYS), "uniqueTraders", "repeatedTraders").drop("window")


def empty_windows(windows: DataFrame, minutes: int = 5) -> DataFrame:
    """The records of windows without swaps between the first and the last window of each pool; grouped plans never make one."""
    size = minutes * 60_000
    spans = windows.groupBy("pairAddress").agg(F.min("windowStart").alias("_a"), F.max("windowStart").alias("_b"))
    all_of = spans.select("pairAddress", F.explode(F.sequence("_a", "_b", F.lit(size))).alias("windowStart"))
    gaps = all_of.join(windows.select("pairAddress", "windowStart"), ["pairAddress", "windowStart"], "left_anti").withColumn("windowEnd", F.col("windowStart") + size)
    known = {"windowId": S.window_id(F.col("pairAddress"), F.col("windowStart"), F.col("windowEnd")), **{c: F.col(c) for c in ("windowStart", "windowEnd", "pairAddress")}, "largestSwapAddress": F.lit(""), "volumeUSD": F.lit(None), "repeatedTraders": F.array(), "token0Symbol": F.lit(None), "token1Symbol": F.lit(None)}
    return gaps.select(*[known.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name) for f in TRADING.fields if f.name != "processedAt"])


def empty_window(spark: SparkSession, pair: str, start: int, end: int) -> DataFrame:
    """The record of one window without swaps, bounds in milliseconds."""
    around = spark.createDataFrame([(pair, start - (end - start)), (pair, end)], "pairAddress string, windowStart long")
    return empty_windows(around, (end - start) // 60_000)


def market_trends(events: DataFrame, minutes: int = 30, slide: int = 5) -> DataFrame:
    """One row per pool and sliding window that has swaps: average price, change in percent and its class."""
    swaps, pane = swaps_of(events), F.window("event_time", f"{slide} minutes")
    whole = F.explode(F.transform(F.sequence(F.lit(0), F.lit(minutes // slide - 1)), lambda k: _shifted(k, minutes, slide))).alias("window")
    panes = partials(swaps, pane)
    state = merge(panes.withColumnRenamed("window", "pane").select("*", whole).drop("pane"))
    seen = traders(swaps, pane).withColumnRenamed("window", "pane").select(whole, "pairAddress", "trader").groupBy(*KEYS, "trader").agg(F.lit(1).alias("n"))
    count = seen.groupBy(*KEYS).agg(F.count("*").cast("int").alias("uniqueTraders"))
    return trend_rows(null_safe(finish(state), count, KEYS))


def _shifted(k: Column, minutes: int, slide: int) -> Column:
    start = F.col("pane.start") - F.make_dt_interval(mins=k * slide)
    return F.struct(start.alias("start"), (start + F.make_dt_interval(mins=F.lit(minutes))).alias("end"))


def trend_rows(windows: DataFrame) -> DataFrame:
    """Trends from finished windows; change and volatility follow from the rounded prices."""
    opening, close, twap = F.col("openPrice"), F.col("closePrice"), F.col("twap")
    change = F.when(opening > 0, (close - opening) / opening).otherwise(F.lit(0.0))
    volatility = F.when(twap > 0, (F.col("highPrice") - F.col("lowPrice")) / twap).otherwise(F.lit(0.0))
    return windows.select(
        S.window_id(F.col("pairAddress"), F.col("windowStart"), F.col("windowEnd"), "trend").alias("windowId"),
        "windowStart", "windowEnd", "pairAddress", "token0Symbol", "token1Symbol",
        F.col("twap").alias("avgPrice"), "openPrice", "closePrice",
        S.round8(change * 100).alias("priceChangePercent"),
        "volumeUSD", "swapCount", "uniqueTraders",
        S.round8(volatility).alias("volatility"),
        S.trend_of(change).alias("trend"),
    )
