"""Contract logs to exchange events: dispatch, parsing, checks, and enrichment by equi-joins and an as-of price join.

Tables (addresses in lower case): logs(blockNumber, transactionHash, logIndex, address, topics array, data), all
hexadecimal texts with 0x; blocks(blockNumber, blockTimestamp); receipts(transactionHash, gasUsed, effectiveGasPrice);
tokens(token, symbol); pairs(pairAddress, token0, token1, decimals0, decimals1);
price_rounds(token, updatedAt, answer, decimals).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as S
from tidemark.operators.prices import usd_prices

#: Event signatures (fixed values): the Keccak-256 hash of each event's declaration.
SIGNATURES = {
    "Swap": "0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822",
    "Mint": "0x4c209b5fc8ad50758f13e2e1088ba56a560dff690a1c6fef26394f4c03821c4f",
    "Burn": "0xdccd412f0b1252819cb1fd330b93224ca42612892bb3f4f789976e6d81936496",
    "Transfer": "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef",
}
#: Tokens that count as one US dollar (fixed values).
STABLECOINS = ["0x2791bca1f2de4661ed88a30c99a7a9449aa84174", "0xc2132d05d31c914a87c6611c10748aeb04b58e8f", "0x8f3cf7ad23cd3cadbd9735aff958023239c6a063"]
#: Token and price feed (fixed values).
FEEDS = {
    "0x0d500b1d8e8ef31e21c99d1db9a6444d3adf1270": "0xab594600376ec9fd91f8e885dadf0ce036862de0",
    "0x7ceb23fd6bc0add59e62ac25578270cff1b9f619": "0xf9680d99d6c9589e2a93a78a04a279e509205945",
    "0x1bfd67037b42cf73acf2047067bd4f2c47d9bfd6": "0xc907e116054ad103354f2d350fd2514433d57f6f",
    "0x2791bca1f2de4661ed88a30c99a7a9449aa84174": "0xfe4a8cc5b5b2366c1b58bea3858e81843581b2f7",
    "0xc2132d05d31c914a87c6611c10748aeb04b58e8f": "0x0a6513e40db6eb1b165753ad52e80663aea50545",
    "0x8f3cf7ad23cd3cadbd9735aff958023239c6a063": "0x4746dec9e833a82ec7c2c1356372ccf2cfcd2f3d",
}
ZERO_ADDRESS = "0x" + "0" * 40
#: Topics that a log must have, and 32-byte words of its data.
TOPICS = {"Swap": 3, "Mint": 2, "Burn": 3, "Transfer": 3}
WORDS = {"Swap": 4, "Mint": 2, "Burn": 2}
#: Bytes of the longest symbol.
SYMBOL_BYTES = 20


@F.pandas_udf(T.StringType())
def hex_to_decimal(words: pd.Series) -> pd.Series:
    """Hexadecimal digits of an unsigned integer of any size as decimal text; null where there are none, or other characters."""

    def number(x: str | None) -> str | None:
        try:
            return str(int(x, 16)) if x else None
        except ValueError:
            return None

    return words.map(number)


def of_pools(logs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Logs of known pools and signatures."""
    known = pairs.select(F.col("pairAddress").alias("address"))
    return logs.where(F.get("topics", 0).isin(*SIGNATURES.values())).join(known, "address", "left_semi")


def rounds_of_feeds(rounds: DataFrame, feeds: dict[str, str] = FEEDS) -> DataFrame:
    """Price rounds by feed (feed, updatedAt, answer, decimals) as rounds by token; those of unknown feeds are left out."""
    token = F.element_at(F.create_map(*[F.lit(x) for t, feed in feeds.items() for x in (feed, t)]), F.lower("feed"))
    return rounds.select(token.alias("token"), "updatedAt", "answer", "decimals").where("token is not null")


def subscribed(logs: DataFrame, pairs: DataFrame, backfill: int = 500) -> DataFrame:
    """Logs of known pools and signatures from `backfill` blocks before the latest one on."""
    start = logs.agg(F.greatest(F.max("blockNumber") - backfill, F.lit(0)).alias("_from"))
    return of_pools(logs, pairs).join(F.broadcast(start)).where(F.col("blockNumber") >= F.col("_from")).drop("_from")  # one row


def event_type(topics: Column) -> Column:
    first = F.get(topics, 0)
    out = None
    for kind, signature in SIGNATURES.items():
        out = F.when(first == signature, kind) if out is None else out.when(first == signature, kind)
    return out


def parse_logs(logs: DataFrame) -> DataFrame:
    """logs with eventType, addresses, amounts, and error: why a log is no event (null if it is one)."""
    digits = F.regexp_replace("data", "^0x", "")
    address = lambda k: F.lower(F.concat(F.lit("0x"), F.right(F.get("topics", k), F.lit(40))))
    word = lambda k: hex_to_decimal(F.substring(digits, 64 * k + 1, 64))
    kind = F.col("eventType")
    typed = logs.withColumn("eventType", event_type(F.col("topics")))
    need = F.when(kind == "Swap", 3).when(kind == "Mint", 2).when(kind == "Burn", 3).when(kind == "Transfer", 3)
    words = F.when(kind == "Swap", 4).when(kind.isin("Mint", "Burn"), 2).otherwise(0)
    one, two = address(1), F.when(kind != "Mint", address(2))
    error = (
        F.when(kind.isNull(), "unknown event")
        .when(F.size("topics") < need, "missing topics")
        .when(F.length(digits) < words * 64, "short data")
        .when(~digits.rlike("^[0-9a-fA-F]*$"), "data is not hexadecimal")
        .when((one == ZERO_ADDRESS) | F.coalesce(two == ZERO_ADDRESS, F.lit(False)), "zero address")
    )
    checked = typed.withColumn("error", error)
    ok = F.col("error").isNull()
    on = lambda kinds, value: F.when(ok & kind.isin(*kinds), value)
    return checked.select(
        "*",
        on(["Swap", "Mint", "Burn"], one).alias("sender"), on(["Swap", "Burn"], address(2)).alias("recipient"), on(["Transfer"], one).alias("from"), on(["Transfer"], address(2)).alias("to"),
        on(["Swap"], word(0)).alias("amount0In"), on(["Swap"], word(1)).alias("amount1In"), on(["Swap"], word(2)).alias("amount0Out"), on(["Swap"], word(3)).alias("amount1Out"),
        on(["Mint", "Burn"], word(0)).alias("amount0"), on(["Mint", "Burn"], word(1)).alias("amount1"), on(["Transfer"], F.coalesce(hex_to_decimal(digits), F.lit("0"))).alias("value"),  # no data is 0
    )


def symbols_of(tokens: DataFrame) -> DataFrame:
    """token, symbol; symbols that are empty or too long are unknown."""
    return tokens.select("token", F.when(F.octet_length("symbol").between(1, SYMBOL_BYTES), F.col("symbol")).alias("symbol"))


def arrival(block: Column, log_index: Column) -> Column:
    """A number by which events come in the order of the chain."""
    return block * 1_000_000 + log_index


def enrich(parsed: DataFrame, blocks: DataFrame, receipts: DataFrame, tokens: DataFrame, pairs: DataFrame, price_rounds: DataFrame, stablecoins: list[str] = STABLECOINS) -> DataFrame:
    """Events of parsed logs: block time, gas (swaps), symbols, price and USD volume (swaps). Logs with errors, and those of unknown blocks, are left out."""
    located = parsed.where("error is null").join(blocks, "blockNumber").join(receipts, "transactionHash", "left")
    return described(located, named_pools(tokens, pairs), price_rounds, stablecoins)


def named_pools(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with the symbols of their tokens."""
    symbols = symbols_of(tokens)
    of = lambda k: symbols.select(F.col("token").alias(f"token{k}"), F.col("symbol").alias(f"token{k}Symbol"))
    return pairs.join(of(0), "token0", "left").join(of(1), "token1", "left")


def described(located: DataFrame, pools: DataFrame, price_rounds: DataFrame, stablecoins: list[str] = STABLECOINS) -> DataFrame:
    """Events of parsed logs that have blockTimestamp, gasUsed and effectiveGasPrice: with pools, symbols, prices and volumes."""
    rows = located.withColumn("pairAddress", F.lower("address")).join(pools, "pairAddress")
    rows = rows.withColumn("seq", arrival(F.col("blockNumber"), F.col("logIndex")))
    # One price for each token and time, whatever number of logs asks for it; both prices of a pool's tokens reach its logs by one join.
    moments = rows.select(F.col("token0").alias("_token0"), F.col("token1").alias("_token1"), F.col("blockTimestamp").alias("_at")).distinct()
    asked = moments.select(F.explode(F.array("_token0", "_token1")).alias("token"), F.col("_at").alias("at")).distinct().withColumn("id", F.lit(0))
    prices = usd_prices(asked, price_rounds, stablecoins)
    for k in (0, 1):
        of_token = prices.select(F.col("token").alias(f"_token{k}"), F.col("at").alias("_at"), F.col("usd").alias(f"_usd{k}"))
        moments = moments.join(of_token, [f"_token{k}", "_at"], "left")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("token0", "_token0"), ("token1", "_token1"), ("blockTimestamp", "_at"))]
    rows = rows.join(moments, same[0] & same[1] & same[2], "left")
    amounts = [F.col(c) for c in ("amount0In", "amount1In", "amount0Out", "amount1Out")]
    swap = F.col("eventType") == "Swap"
    price = S.price_from_amounts(*amounts, F.col("decimals0"), F.col("decimals1"))
    usd = S.usd_volume(*amounts, F.col("decimals0"), F.col("decimals1"), F.col("_usd0"), F.col("_usd1"), price)
    return rows.select(
        S.event_id(F.col("transactionHash"), F.col("logIndex")).alias("eventId"), "eventType", "blockNumber", "blockTimestamp", "transactionHash", F.col("logIndex").cast("int").alias("logIndex"), "pairAddress",
        "token0", "token1", "token0Symbol", "token1Symbol", "sender", "recipient", "amount0In", "amount1In", "amount0Out", "amount1Out",
        F.when(swap, price).alias("price"), F.when(swap, usd).alias("volumeUSD"), F.when(swap, F.coalesce("gasUsed", F.lit(0))).cast("long").alias("gasUsed"), F.when(swap, F.coalesce("effectiveGasPrice", F.lit("0"))).alias("gasPrice"),
        "amount0", "amount1", "from", "to", "value", F.col("blockTimestamp").alias("eventTimestamp"), "seq", F.timestamp_seconds("blockTimestamp").alias("event_time"),
    )


def released(events: DataFrame, depth: int = 64) -> DataFrame:
    """Events that are `depth` blocks below the latest block of their pool, by block, then by arrival; depth 0 releases all."""
    if depth == 0:
        return events.orderBy("pairAddress", "blockNumber", "seq")
    tip = events.groupBy("pairAddress").agg(F.max("blockNumber").alias("_tip"))
    final = events.join(tip, "pairAddress").where((F.col("_tip") >= depth) & (F.col("blockNumber") <= F.col("_tip") - depth)).drop("_tip")
    return final.orderBy("pairAddress", "blockNumber", "seq")
