"""Liquidity windows: what providers add and take out, with pool-token transfers matched by transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bigint
from tidemark.functions import scalars as S
from tidemark.functions.joins import null_safe


def liquidity_windows(events: DataFrame, minutes: int = 60) -> DataFrame:
    """One row per pool and window that has a mint, burn or transfer.

    First per transaction, then per window: a transfer counts as minted (burned) if its transaction has a mint (burn) in
    the window, once however many it has, and in both if it has both. No join is needed, and a hot pool is spread over
    its transactions before the last step.
    """
    window = F.window("event_time", f"{minutes} minutes")
    rows = events.where(F.col("eventType").isin("Mint", "Burn", "Transfer")).withColumn("window", window)
    rows = rows.withColumns({f"_{c}": bigint.padded(F.col(c)) for c in ("amount0", "amount1", "value")})
    rows = rows.withColumns({c: bigint.parsed(c) for c in ("_amount0", "_amount1", "_value")})
    is_kind = lambda kind: F.col("eventType") == kind
    either = is_kind("Mint") | is_kind("Burn")
    symbol = lambda k: F.min(F.when(either & S.not_blank(F.col(f"token{k}Symbol")).isNotNull(), F.struct("seq", F.col(f"token{k}Symbol").alias("v")))).alias(f"symbol{k}")
    amount = lambda k, kind: bigint.total(f"_amount{k}", f"eventType = '{kind}'").alias(f"{kind}{k}")
    keys = ["window", "pairAddress"]
    per_tx = rows.groupBy(*keys, "transactionHash").agg(
        F.count_if(is_kind("Mint")).alias("mints"), F.count_if(is_kind("Burn")).alias("burns"), F.count_if(is_kind("Transfer")).alias("transfers"),
        amount(0, "Mint"), amount(1, "Mint"), amount(0, "Burn"), amount(1, "Burn"),
        bigint.total("_value", "eventType = 'Transfer'").alias("moved"), symbol(0), symbol(1),
    )
    per_window = per_tx.groupBy(*keys).agg(
        F.sum("mints").alias("mints"), F.sum("burns").alias("burns"), F.sum("transfers").alias("transfers"),
        *[bigint.merged(c) for c in ("Mint0", "Mint1", "Burn0", "Burn1")],
        bigint.total("moved", "mints > 0").alias("minted"), bigint.total("moved", "burns > 0").alias("burned"),
        F.min("symbol0").alias("symbol0"), F.min("symbol1").alias("symbol1"),
    )
    providers = rows.where(either).groupBy(*keys, S.address(F.col("sender")).alias("provider")).agg(F.max(is_kind("Mint")).alias("m"), F.max(is_kind("Burn")).alias("b"))
    per_provider = providers.groupBy(*keys).agg(F.count_if("m").alias("pm"), F.count_if("b").alias("pb"), F.count("*").alias("pa"), F.count_if(F.col("m") & F.col("b")).alias("pc"))
    start, end = S.millis(F.col("window.start")), S.millis(F.col("window.end"))
    text = bigint.to_text
    net = lambda a, b: bigint.to_text(bigint.less(a, b))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    return null_safe(per_window, per_provider, keys, "left").select(
        S.window_id(F.col("pairAddress"), start, end).alias("windowId"),
        start.alias("windowStart"), end.alias("windowEnd"), "pairAddress",
        F.col("symbol0.v").alias("token0Symbol"), F.col("symbol1.v").alias("token1Symbol"),
        count("mints").alias("mintCount"), count("burns").alias("burnCount"),
        text("Mint0").alias("totalMintAmount0"), text("Mint1").alias("totalMintAmount1"),
        text("Burn0").alias("totalBurnAmount0"), text("Burn1").alias("totalBurnAmount1"),
        net("Mint0", "Burn0").alias("netLiquidityChange0"), net("Mint1", "Burn1").alias("netLiquidityChange1"),
        text("minted").alias("totalLpTokensMinted"), text("burned").alias("totalLpTokensBurned"), net("minted", "burned").alias("netLpTokenChange"),
        count("transfers").alias("transferCount"), count("pm").alias("uniqueMintProviders"), count("pb").alias("uniqueBurnProviders"),
        count("pa").alias("uniqueProviders"), count("pc").alias("churnedProviders"),
    )
