"""The query surface over result tables: one function per question."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import store


class NotFound(LookupError):
    """A question that has no rows to answer it."""


class BadRequest(ValueError):
    """Parameters that make no sense."""


def parse_range(pair: str | None, start: str | None = None, end: str | None = None, now: int | None = None) -> tuple[str, int, int]:
    """A pool is required; bounds that are no numbers mean the last hour up to now; a start after the end is refused."""
    if not pair or not pair.strip():
        raise BadRequest("a pool is required")
    now = int(time.time() * 1000) if now is None else now

    def number(text, default):
        try:
            return int(text)
        except (TypeError, ValueError):
            return default

    a, b = number(start, now - store.HOUR), number(end, now)
    if a > b:
        raise BadRequest("the range ends before it starts")
    return pair, a, b


def some(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise NotFound("no rows in this range")
    return rows


@dataclass
class Analytics:
    """Questions about pools, answered from the four result tables. Ranges are in milliseconds, both ends included."""

    trading: DataFrame
    liquidity: DataFrame
    found: DataFrame
    trends: DataFrame

    def trading_rows(self, pair, start, end) -> DataFrame:
        return store.in_range(self.trading, pair, start, end)

    def twap(self, pair, start, end) -> DataFrame:
        return self.trading_rows(pair, start, end).select("windowId", "windowStart", "windowEnd", "twap")

    def ohlc(self, pair, start, end) -> DataFrame:
        prices = [F.col(f"{k}Price").alias(k) for k in ("open", "high", "low", "close")]
        return self.trading_rows(pair, start, end).select("windowId", "windowStart", "windowEnd", *prices)

    def volume(self, pair, start, end) -> DataFrame:
        return self.trading_rows(pair, start, end).select("windowId", "windowStart", "windowEnd", "volumeUSD", "totalVolume0", "totalVolume1", "swapCount")

    def latest_trading(self, pair) -> DataFrame:
        return store.latest(self.trading.where(F.col("pairAddress") == pair))

    def liquidity_rows(self, pair, start, end) -> DataFrame:
        return store.in_range(self.liquidity, pair, start, end)

    def latest_liquidity(self, pair) -> DataFrame:
        return store.latest(self.liquidity.where(F.col("pairAddress") == pair))

    def liquidity_flows(self, pair, start, end) -> DataFrame:
        return flows(self.liquidity_rows(pair, start, end))

    def alerts(self, pair, start, end) -> DataFrame:
        return store.alerts_in_range(self.found, pair, start, end)

    def trend_rows(self, pair, start, end) -> DataFrame:
        return store.in_range(self.trends, pair, start, end)

    def pool_health(self, now, pair=None) -> DataFrame:
        spark = self.trading.sparkSession
        pairs = None if pair is None else spark.createDataFrame([(pair,)], "pairAddress string")
        return store.pool_health(self.trading, self.liquidity, self.found, self.trends, now, pairs)

    def leaderboard(self, now) -> DataFrame:
        return store.leaderboard(self.pool_health(now))

    def summary(self) -> DataFrame:
        return store.summary(self.trading, self.liquidity)

    def pair_summaries(self, now) -> DataFrame:
        return store.pair_summaries(self.trading, now)


FLOWS = ["windowId", "windowStart", "windowEnd", "netLiquidityChange0", "netLiquidityChange1", "totalLpTokensMinted", "totalLpTokensBurned", "netLpTokenChange", "mintCount", "burnCount"]


def flows(liquidity: DataFrame) -> DataFrame:
    return liquidity.select(*FLOWS)
