"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import bigint


def address(col: Column) -> Column:
    """Lower case; null is the empty address. Blanks stay."""
    return F.coalesce(F.lower(col), F.lit(""))


def round8(x: Column) -> Column:
    """Half up at eight decimals of the shortest decimal form. NaN and infinities give null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(F.round(x, 8)).cast("double")


def not_blank(col: Column) -> Column:
    """The text if it has any character that is not white space, else null."""
    return F.when(~col.rlike(r"\A\p{javaWhitespace}*\z"), col)


def prefer_symbol(current: Column, candidate: Column) -> Column:
    return F.coalesce(not_blank(current), not_blank(candidate))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def window_id(pair: Column, start: Column, end: Column, kind: str | None = None) -> Column:
    """pair:start:end in milliseconds, with the kind after the pair if there is one."""
    return F.concat_ws(":", pair, *([F.lit(kind)] if kind else []), start.cast("string"), end.cast("string"))


def event_id(tx: Column, log_index: Column) -> Column:
    return F.concat_ws(":", tx, log_index.cast("string"))


def cloud_event_type(kind: Column) -> Column:
    return F.concat(F.lit("com.dex.events."), F.lower(kind))


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hex_preview(raw: Column, size: int = 16) -> Column:
    return F.lower(F.hex(F.substring(raw, 1, size)))


def usd_text(x: Column) -> Column:
    return F.format_string("%.2f USD", x)


def swap_direction(in0: Column, in1: Column, out0: Column, out1: Column) -> Column:
    """By which token comes in and which goes out; both ways or neither is UNKNOWN."""
    sells0 = (bigint.signum(in0) > 0) & (bigint.signum(out1) > 0)
    sells1 = (bigint.signum(in1) > 0) & (bigint.signum(out0) > 0)
    return F.when(sells1 & ~sells0, "BUY_TOKEN0").when(sells0 & ~sells1, "BUY_TOKEN1").otherwise("UNKNOWN")


def adjusted(amount: Column, decimals: Column) -> Column:
    """The amount in whole tokens."""
    return bigint.to_double(amount) / F.pow(F.lit(10.0), decimals)


def price_from_amounts(in0: Column, in1: Column, out0: Column, out1: Column, decimals0: Column, decimals1: Column) -> Column:
    """Token1 per token0: out1 / in0, else in1 / out0, in whole tokens; 0 if neither pair of amounts is positive."""
    positive = lambda a, b: (bigint.signum(a) > 0) & (bigint.signum(b) > 0)
    return F.when(positive(in0, out1), adjusted(out1, decimals1) / adjusted(in0, decimals0)).when(positive(in1, out0), adjusted(in1, decimals1) / adjusted(out0, decimals0)).otherwise(F.lit(0.0))


def usd_volume(in0: Column, in1: Column, out0: Column, out1: Column, decimals0: Column, decimals1: Column, usd0: Column, usd1: Column, price: Column) -> Column:
    """By a token at exactly 1 USD (token1 first), else by the price of token0, then of token1, then the swap's own price."""
    moved = lambda a, b: F.when(bigint.signum(a) > 0, a).otherwise(b)
    vol0, vol1 = adjusted(moved(in0, out0), decimals0), adjusted(moved(in1, out1), decimals1)
    return F.when(usd1 == 1.0, vol1).when(usd0 == 1.0, vol0).when(usd0 > 0, vol0 * usd0).when(usd1 > 0, vol1 * usd1).when(price > 0, vol0 * price)


def trend_of(change: Column) -> Column:
    return F.when(change > 0.01, "BULLISH").when(change < -0.01, "BEARISH").otherwise("NEUTRAL")


def severity_of(profit: Column) -> Column:
    return F.when(profit > 100.0, "HIGH").when(profit > 10.0, "MEDIUM").otherwise("LOW")
