"""Every query over the driver's tables by name, with DuckDB SQL written independently of the plans."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import decode, liquidity, prices, sessions, store, trading
from tidemark.plans import api
from tidemark.sources import chain
from tidemark.sources.testdata import exchange_events

#: The pause that ends a session, and the moment that "now" means, since the tables end in January 2024.
GAP = 1800
NOW = 1_706_659_200_000  # 2024-01-31 00:00 UTC
POOL = "pool-1"
FROM, TO = 1_704_844_800_000, 1_705_017_600_000  # two days from 2024-01-10

EV = """
WITH ev AS (
  SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id, CAST(round(value * 100) AS BIGINT) AS cents,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'Swap' WHEN event_type = 'signup' THEN 'Mint' WHEN event_type = 'error' THEN 'Burn' WHEN event_type = 'view' THEN 'Transfer' END AS kind,
    CAST(event_id % 1000 AS INTEGER) AS li, 'tx-' || (event_id // 2) AS tx, 'pool-' || ((event_id // 2) % 3) AS pair,
    CASE WHEN event_id % 5 <> 0 THEN 'TK' || ((event_id // 2) % 3) END AS sym0, 'USDX' AS sym1, event_id % 2 = 0 AS even
  FROM events),
e AS (
  SELECT *, t // 3600 AS block, 'trader-' || (user_id % 4) AS sender, 'trader-' || ((user_id // 4) % 4) AS recipient,
    CAST(cents + 1 AS HUGEINT) * 10000000000000000 AS a0, CAST(cents + 2 AS HUGEINT) * 10000000000000000 AS a1,
    1.0::DOUBLE + (cents % 500) / 1000.0::DOUBLE AS price, CASE WHEN seq % 7 <> 0 THEN cents / 100.0::DOUBLE END AS usd, 21000 + seq % 1000 AS gas, CAST(30 + seq % 50 AS HUGEINT) * 1000000000 AS gasprice
  FROM ev WHERE kind IS NOT NULL),
s AS (SELECT * FROM e WHERE kind = 'Swap')
"""


def _windows(minutes: int, where: str = "TRUE", name: str = "tw") -> str:
    """Trading windows as CTEs, over rows of s with window starts ws and ends we."""
    return f"""
{name}_in AS (SELECT *, (t // {minutes * 60}) * {minutes * 60000} AS ws, (t // {minutes * 60} + 1) * {minutes * 60000} AS we FROM s WHERE {where}),
{_aggregated(name)}"""


def _aggregated(name: str) -> str:
    return f"""{name}_tr AS (
  SELECT pair, ws, count(*)::INTEGER AS uniq, list_sort(list(trader) FILTER (WHERE n >= 3)) AS often
  FROM (SELECT pair, ws, trader, count(*) AS n FROM (
    SELECT pair, ws, sender AS trader FROM {name}_in UNION ALL SELECT pair, ws, recipient FROM {name}_in WHERE recipient <> sender) GROUP BY ALL) GROUP BY pair, ws),
{name}_agg AS (
  SELECT pair, ws, we, arg_min(sym0, seq) FILTER (WHERE sym0 IS NOT NULL) AS sym0, arg_min(sym1, seq) AS sym1,
    sum(price * a0::DOUBLE) / sum(a0::DOUBLE) AS twap, arg_min(price, (t, li, seq)) AS o, arg_max(price, (t, li, seq)) AS c, max(price) AS h, min(price) AS l,
    sum(a0) AS v0, sum(a1) AS v1, sum(usd) AS usd, count(*)::INTEGER AS n, sum(gas)::BIGINT AS gas, sum(gasprice) AS gp, count(*) FILTER (WHERE sender = recipient)::INTEGER AS arb,
    arg_max((usd, a0, sender), (usd IS NOT NULL, coalesce(usd, 0), CASE WHEN usd IS NULL THEN a0 ELSE 0 END, -seq)) AS big
  FROM {name}_in GROUP BY pair, ws, we),
{name} AS (
  SELECT pair || ':' || ws || ':' || we AS "windowId", ws AS "windowStart", we AS "windowEnd", pair AS "pairAddress", sym0 AS "token0Symbol", sym1 AS "token1Symbol",
    round(twap, 8) AS twap, round(o, 8) AS "openPrice", round(c, 8) AS "closePrice", round(h, 8) AS "highPrice", round(l, 8) AS "lowPrice", round((h - l) / twap, 8) AS "priceVolatility",
    v0::VARCHAR AS "totalVolume0", v1::VARCHAR AS "totalVolume1", round(usd, 8) AS "volumeUSD", n AS "swapCount", uniq AS "uniqueTraders",
    CASE WHEN big[1] IS NOT NULL THEN printf('%.2f USD', big[1]) ELSE big[2]::VARCHAR END AS "largestSwapValue", big[3] AS "largestSwapAddress", gas AS "totalGasUsed",
    (gp // n)::VARCHAR AS "averageGasPrice", arb AS "arbitrageCount", coalesce(often, []) AS "repeatedTraders"
  FROM {name}_agg JOIN {name}_tr USING (pair, ws))"""


LIQUIDITY = """
lw_in AS (SELECT *, (t // 3600) * 3600000 AS ws FROM e WHERE kind <> 'Swap'),
lw_tx AS (SELECT pair, ws, tx, bool_or(kind = 'Mint') AS m, bool_or(kind = 'Burn') AS b, coalesce(sum(CAST(cents + 5 AS HUGEINT) * 10000000000000000) FILTER (WHERE kind = 'Transfer'), 0) AS moved FROM lw_in GROUP BY ALL),
lw_lp AS (SELECT pair, ws, coalesce(sum(moved) FILTER (WHERE m), 0) AS lm, coalesce(sum(moved) FILTER (WHERE b), 0) AS lb FROM lw_tx GROUP BY ALL),
lw_pr AS (SELECT pair, ws, count(*) FILTER (WHERE m) AS pm, count(*) FILTER (WHERE b) AS pb, count(*) AS pa, count(*) FILTER (WHERE m AND b) AS pc
  FROM (SELECT pair, ws, sender, bool_or(kind = 'Mint') AS m, bool_or(kind = 'Burn') AS b FROM lw_in WHERE kind IN ('Mint', 'Burn') GROUP BY ALL) GROUP BY ALL),
lw_ag AS (
  SELECT pair, ws, arg_min(sym0, seq) FILTER (WHERE sym0 IS NOT NULL AND kind <> 'Transfer') AS sym0, arg_min(sym1, seq) FILTER (WHERE kind <> 'Transfer') AS sym1,
    count(*) FILTER (WHERE kind = 'Mint') AS nm, count(*) FILTER (WHERE kind = 'Burn') AS nb, count(*) FILTER (WHERE kind = 'Transfer') AS nt,
    coalesce(sum(a0 + 20000000000000000) FILTER (WHERE kind = 'Mint'), 0) AS m0, coalesce(sum(a1 + 20000000000000000) FILTER (WHERE kind = 'Mint'), 0) AS m1,
    coalesce(sum(a0 + 20000000000000000) FILTER (WHERE kind = 'Burn'), 0) AS b0, coalesce(sum(a1 + 20000000000000000) FILTER (WHERE kind = 'Burn'), 0) AS b1
  FROM lw_in GROUP BY pair, ws),
lw AS (
  SELECT pair || ':' || ws || ':' || (ws + 3600000) AS "windowId", ws AS "windowStart", ws + 3600000 AS "windowEnd", pair AS "pairAddress", sym0 AS "token0Symbol", sym1 AS "token1Symbol",
    nm::INTEGER AS "mintCount", nb::INTEGER AS "burnCount", m0::VARCHAR AS "totalMintAmount0", m1::VARCHAR AS "totalMintAmount1", b0::VARCHAR AS "totalBurnAmount0", b1::VARCHAR AS "totalBurnAmount1",
    (m0 - b0)::VARCHAR AS "netLiquidityChange0", (m1 - b1)::VARCHAR AS "netLiquidityChange1", lm::VARCHAR AS "totalLpTokensMinted", lb::VARCHAR AS "totalLpTokensBurned", (lm - lb)::VARCHAR AS "netLpTokenChange",
    nt::INTEGER AS "transferCount", coalesce(pm, 0)::INTEGER AS "uniqueMintProviders", coalesce(pb, 0)::INTEGER AS "uniqueBurnProviders", coalesce(pa, 0)::INTEGER AS "uniqueProviders", coalesce(pc, 0)::INTEGER AS "churnedProviders"
  FROM lw_ag JOIN lw_lp USING (pair, ws) LEFT JOIN lw_pr USING (pair, ws))"""

TRENDS = f"""
mt_in AS (SELECT s.*, (t // 300 - k) * 300000 AS ws, (t // 300 - k) * 300000 + 1800000 AS we FROM s, range(6) r(k)),
{_aggregated("mtw")}""".replace("mtw_in", "mt_in") + """,
mt AS (
  SELECT "pairAddress" || ':trend:' || "windowStart" || ':' || "windowEnd" AS "windowId", "windowStart", "windowEnd", "pairAddress", "token0Symbol", "token1Symbol", twap AS "avgPrice", "openPrice", "closePrice",
    round(("closePrice" - "openPrice") / "openPrice" * 100, 8) AS "priceChangePercent", "volumeUSD", "swapCount", "uniqueTraders", round(("highPrice" - "lowPrice") / twap, 8) AS volatility,
    CASE WHEN ("closePrice" - "openPrice") / "openPrice" > 0.01 THEN 'BULLISH' WHEN ("closePrice" - "openPrice") / "openPrice" < -0.01 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend
  FROM mtw)"""

SESSIONS = f"""
x_lag AS (SELECT *, lag(t) OVER (PARTITION BY pair ORDER BY t, li, seq) AS p FROM e),
x_id AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY t, li, seq ROWS UNBOUNDED PRECEDING) AS sid FROM x_lag),
x AS (SELECT *, min(t) OVER (PARTITION BY pair, sid) * 1000 AS ws, (max(t) OVER (PARTITION BY pair, sid) + {GAP}) * 1000 AS we FROM x_id),
x_sym AS (SELECT pair, ws, arg_min(sym0, (t, li, seq)) FILTER (WHERE sym0 IS NOT NULL) AS sym0, arg_min(sym1, (t, li, seq)) AS sym1 FROM x WHERE kind IN ('Swap', 'Mint') GROUP BY ALL)"""

SANDWICH = SESSIONS + """,
b AS (SELECT *, row_number() OVER (PARTITION BY pair, ws, block ORDER BY li, t, seq) AS at, CASE WHEN even THEN 'BUY_TOKEN1' ELSE 'BUY_TOKEN0' END AS way FROM x WHERE kind = 'Swap'),
b_pairs AS (
  SELECT f.pair, f.ws, f.we, f.block, f.sender, f.at AS i, min(k.at) AS j FROM b f JOIN b k ON f.pair = k.pair AND f.ws = k.ws AND f.block = k.block AND f.sender = k.sender AND k.at >= f.at + 2 AND k.way <> f.way
  WHERE EXISTS (SELECT 1 FROM b v WHERE v.pair = f.pair AND v.ws = f.ws AND v.block = f.block AND v.at > f.at AND v.at < k.at AND v.sender <> f.sender) GROUP BY ALL),
sw AS (
  SELECT p.pair, p.ws, p.we, p.block, p.sender, p.i, p.j, list(v.sender ORDER BY v.at) FILTER (WHERE v.sender <> p.sender) AS victims, list_sort(list_distinct(list(v.tx))) AS txs,
    abs(max(v.usd) FILTER (WHERE v.at = p.j) - max(v.usd) FILTER (WHERE v.at = p.i)) AS pr
  FROM b_pairs p JOIN b v ON v.pair = p.pair AND v.ws = p.ws AND v.block = p.block AND v.at BETWEEN p.i AND p.j GROUP BY ALL),
found AS (
  SELECT 'SANDWICH_ATTACK' AS "alertType", ws AS "windowStart", we AS "windowEnd", pair AS "pairAddress", sym0 AS "token0Symbol", sym1 AS "token1Symbol", block AS "blockNumber", sender AS "attackerAddress", victims AS "victimAddresses",
    coalesce(pr, 0) AS "estimatedProfitUSD", (j - i + 1)::INTEGER AS "involvedSwapCount", (j - i + 1)::INTEGER AS "involvedEventCount", CASE WHEN coalesce(pr, 0) > 100 THEN 'HIGH' WHEN coalesce(pr, 0) > 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity, txs AS "involvedTransactions"
  FROM sw LEFT JOIN x_sym USING (pair, ws))"""

JIT = SESSIONS + """,
jp AS (SELECT m.pair, m.ws, m.we, m.sender, m.block AS mb, k.block AS kb, m.seq AS ms, k.seq AS ks, m.tx AS mtx, k.tx AS ktx FROM x m JOIN x k ON m.pair = k.pair AND m.ws = k.ws AND m.sender = k.sender AND k.block BETWEEN m.block AND m.block + 2 WHERE m.kind = 'Mint' AND k.kind = 'Burn'),
jb AS (SELECT p.pair, p.ws, p.mb, p.kb, list(DISTINCT v.tx) AS txs FROM (SELECT DISTINCT pair, ws, mb, kb FROM jp) p JOIN x v ON v.pair = p.pair AND v.ws = p.ws AND v.kind = 'Swap' AND v.block BETWEEN p.mb AND p.kb GROUP BY ALL),
found AS (
  SELECT 'JIT_LIQUIDITY' AS "alertType", ws AS "windowStart", we AS "windowEnd", pair AS "pairAddress", sym0 AS "token0Symbol", sym1 AS "token1Symbol", mb AS "blockNumber", sender AS "attackerAddress", CAST([] AS VARCHAR[]) AS "victimAddresses",
    0.0::DOUBLE AS "estimatedProfitUSD", 0 AS "involvedSwapCount", len(list_distinct(list_concat(txs, [mtx, ktx])))::INTEGER AS "involvedEventCount", 'MEDIUM' AS severity, list_sort(list_distinct(list_concat(txs, [mtx, ktx]))) AS "involvedTransactions"
  FROM jp JOIN jb USING (pair, ws, mb, kb) LEFT JOIN x_sym USING (pair, ws))"""

ALERT_COLUMNS = ["alertType", "windowStart", "windowEnd", "pairAddress", "token0Symbol", "token1Symbol", "blockNumber", "attackerAddress", "victimAddresses", "estimatedProfitUSD", "involvedSwapCount", "involvedEventCount", "severity", "involvedTransactions"]


class Computed(api.Analytics):
    """Result tables computed from events when a question first needs them."""

    def __init__(self, events: DataFrame):
        self.events = events

    trading = cached_property(lambda self: trading.trading_windows(self.events))
    liquidity = cached_property(lambda self: liquidity.liquidity_windows(self.events))
    found = cached_property(lambda self: sessions.alerts(self.events, GAP))
    trends = cached_property(lambda self: trading.market_trends(self.events))
    counted = cached_property(lambda self: sessions.alert_counts(self.events, GAP))

    @cached_property
    def pairs(self) -> DataFrame:
        """Pools that any table has, without making a table: a swap gives a trading window and any other event a liquidity window;
        trends and alerts are of pools that have swaps."""
        return store.tracked_pairs(self.events.where(F.col("event_time").isNotNull() & F.col("eventType").isin("Swap", "Mint", "Burn", "Transfer")))

    def pool_health(self, now, pair=None) -> DataFrame:
        """As of the tables, but alerts are counted and not made."""
        pairs = self.pairs if pair is None else self.pairs.sparkSession.createDataFrame([(pair,)], "pairAddress string")
        return store.pool_health(self.trading, self.liquidity, self.counted, self.trends, now, pairs)


def _tables(spark: SparkSession, sf_dir: str) -> api.Analytics:
    return Computed(exchange_events(spark, sf_dir))


def _on_events(plan):
    return lambda spark, sf_dir: plan(exchange_events(spark, sf_dir))


def trading_windows_multi(events: DataFrame) -> DataFrame:
    """Windows of several sizes, with the topic that each goes to."""
    out = None
    for minutes in (5, 15, 60):
        rows = trading.trading_windows(events, minutes).withColumn("topic", F.lit(f"dex-trading-analytics-{minutes}m"))
        out = rows if out is None else out.unionByName(rows)
    return out


def trader_activity(events: DataFrame) -> DataFrame:
    counted = trading.trader_activity(trading.traders(trading.swaps_of(events), F.window("event_time", "5 minutes")))
    return counted.select("pairAddress", S.millis(F.col("window.start")).alias("windowStart"), "uniqueTraders", "repeatedTraders")


def directions(events: DataFrame) -> DataFrame:
    way = S.swap_direction(*[F.col(c) for c in ("amount0In", "amount1In", "amount0Out", "amount1Out")])
    return trading.swaps_of(events).select("seq", way.alias("direction"))


def prices_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rounds from line items: a part's number is the token, ship dates the times, and the price an answer of eight decimals."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.concat(F.lit("token-"), F.pmod("l_partkey", F.lit(50)).cast("string")).alias("token"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 3600 + F.pmod("l_orderkey", F.lit(3600))).alias("updatedAt"),
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string").alias("answer"), F.lit(8).alias("decimals"),
    )


def price_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order, the token's price at noon of its date. Of rounds at one time, the greater answer."""
    rounds = prices_table(spark, sf_dir).groupBy("token", "updatedAt", "decimals").agg(F.max(F.col("answer").cast("long")).cast("string").alias("answer"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    asked = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("token-"), F.pmod("o_custkey", F.lit(50)).cast("string")).alias("token"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 43200).alias("at"))
    return prices.price_asof(asked, rounds).select("id", "token", F.round("usd", 8).alias("usd"))


def enriched_swaps(events: DataFrame) -> DataFrame:
    """Price and USD volume of each swap from its amounts alone, with token0 of 18 and token1 of 16 decimals and token1 at 2 USD."""
    amounts = [F.col(c) for c in ("amount0In", "amount1In", "amount0Out", "amount1Out")]
    d0, d1 = F.lit(18), F.lit(16)
    price = S.price_from_amounts(*amounts, d0, d1)
    usd = S.usd_volume(*amounts, d0, d1, F.lit(None).cast("double"), F.lit(2.0), price)
    return trading.swaps_of(events).select("eventId", F.round(price, 6).alias("price"), F.round(usd, 6).alias("volumeUSD"), F.col("gasUsed"), "gasPrice")


def envelope_table(events: DataFrame) -> DataFrame:
    """Envelopes made from events, some of them broken in a known way."""
    n = F.col("seq")
    body = F.base64(F.encode(F.col("transactionHash"), "UTF-8"))
    kind = S.cloud_event_type(F.col("eventType"))
    whole = F.concat(F.lit('{"specversion":"1.0","type":"'), kind, F.lit('","data_base64":"'), body, F.lit('"}'))
    text = F.concat(F.lit('{"specversion":"1.0","type":"'), kind, F.lit('","data":"'), F.col("transactionHash"), F.lit('"}'))
    bad = F.when(F.pmod(n, F.lit(11)) == 0, F.lit("not json")).when(F.pmod(n, F.lit(11)) == 1, F.concat(F.lit('{"type":"'), kind, F.lit('"}'))).when(F.pmod(n, F.lit(11)) == 2, F.concat(F.lit('{"specversion":"1.0","type":"'), kind, F.lit('","data":{"a":1}}'))).when(F.pmod(n, F.lit(11)) == 3, F.lit("")).when(F.pmod(n, F.lit(11)) == 4, text)
    return events.select("seq", F.coalesce(bad, whole).alias("value"))


def envelope_decode(events: DataFrame) -> DataFrame:
    parsed = decode.route(decode.parse_envelopes(envelope_table(events)), "trading")
    return parsed.select("seq", "type", "error", F.decode("body", "UTF-8").alias("body"))


def decode_errors(events: DataFrame) -> DataFrame:
    routed = decode.route(decode.parse_envelopes(envelope_table(events)), "liquidity")
    return decode.error_rows(routed, "liquidity", NOW).groupBy("stream", "reason", "payloadSize", "payloadPreview", "failedAt").agg(F.count("*").alias("n"))


def avro_round_trip(events: DataFrame) -> DataFrame:
    """Swaps through Avro and an envelope and back."""
    swaps = decode.encode_bodies(events, "Swap")
    good, _ = decode.events_from(decode.envelopes(swaps).select("value"), "trading")
    return good.drop("event_time", "eventType")


SWAP_COLUMNS = "eventId blockNumber blockTimestamp transactionHash logIndex pairAddress token0 token1 token0Symbol token1Symbol sender recipient amount0In amount1In amount0Out amount1Out price volumeUSD gasUsed gasPrice eventTimestamp".split()


def channel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What live clients read out of their frames."""
    t = _tables(spark, sf_dir)
    frames = decode.channel_frames({"trading": t.trading, "trends": t.trends, "liquidity": t.liquidity}, "Trading and trends, please")
    of = lambda name: F.get_json_object("frame", f"$.{name}")
    price = F.coalesce(of("data.twap"), of("data.avgPrice")).cast("double")
    return frames.select("channel", "pair", of("channel").alias("named"), of("pair").alias("of"), of("data.windowId").alias("windowId"), price.alias("price"))


QUERIES = {
    "trading_windows_5m": _on_events(trading.trading_windows),
    "trading_windows_multi": _on_events(trading_windows_multi),
    "trader_activity": _on_events(trader_activity),
    "largest_swap": _on_events(lambda e: trading.trading_windows(e, 60).select("windowId", "largestSwapValue", "largestSwapAddress")),
    "market_trends": _on_events(trading.market_trends),
    "liquidity_windows": _on_events(liquidity.liquidity_windows),
    "lp_token_flows": _on_events(lambda e: api.flows(liquidity.liquidity_windows(e))),
    "mev_sessions": _on_events(lambda e: sessions.session_summary(e, GAP)),
    "sandwich_attacks": _on_events(lambda e: sessions.sandwiches(e, GAP).select(*ALERT_COLUMNS)),
    "jit_liquidity": _on_events(lambda e: sessions.jit_liquidity(e, GAP).select(*ALERT_COLUMNS)),
    "all_events_union": _on_events(lambda e: e.where("eventType = 'Swap'").unionByName(e.where("eventType <> 'Swap'")).groupBy("eventType", "pairAddress").agg(F.count("*").alias("n"), F.max("blockTimestamp").alias("latest"))),
    "swap_direction": _on_events(directions),
    "twap_series": lambda s, d: _tables(s, d).twap(POOL, FROM, TO),
    "ohlc_series": lambda s, d: _tables(s, d).ohlc(POOL, FROM, TO),
    "volume_series": lambda s, d: _tables(s, d).volume(POOL, FROM, TO),
    "liquidity_series": lambda s, d: _tables(s, d).liquidity_rows(POOL, FROM, TO),
    "trend_series": lambda s, d: _tables(s, d).trend_rows(POOL, FROM, TO),
    "latest_trading": lambda s, d: store.latest(_tables(s, d).trading),
    "latest_liquidity": lambda s, d: store.latest(_tables(s, d).liquidity),
    "latest_trend": lambda s, d: store.latest(_tables(s, d).trends),
    "alerts_range": lambda s, d: _tables(s, d).alerts(POOL, FROM, TO).select(*ALERT_COLUMNS, "detectedAt"),
    "pool_health": lambda s, d: _health(s, d),
    "leaderboard": lambda s, d: store.leaderboard(_health(s, d)).select("pairAddress", "overallScore", "trend"),
    "analytics_summary": lambda s, d: _tables(s, d).summary(),
    "pair_summaries": lambda s, d: _tables(s, d).pair_summaries(NOW),
    "tracked_pairs": lambda s, d: _tables(s, d).pairs,
    "retention_view": lambda s, d: store.retained(_tables(s, d).trading, NOW, 168),
    "enriched_swaps": _on_events(enriched_swaps),
    "price_asof": price_asof,
    "finality_release": _on_events(lambda e: chain.released(e, 64).select("pairAddress", "blockNumber", "seq", "eventId")),
    "topic_routing": _on_events(lambda e: e.groupBy(decode.topic_of(F.col("eventType")).alias("topic"), F.col("pairAddress").alias("partitionKey")).agg(F.count("*").alias("n"))),
    "envelope_decode": _on_events(envelope_decode),
    "decode_errors": _on_events(decode_errors),
    "avro_round_trip": _on_events(avro_round_trip),
    "channel_frames": channel_frames,
}


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = 1_706_572_800_000  # 2024-01-30, so that the day before it is whole
    scores = ["tradingScore", "liquidityScore", "volumeUSD24h"]
    rows = _tables(spark, sf_dir).pool_health(end)
    return rows.select("pairAddress", *[F.round(c, 6).alias(c) for c in scores], "safetyScore", "trend", "recentAlertCount", "uniqueTraders24h", "overallScore")


TW = EV + "," + _windows(5)
HEALTH = EV + "," + _windows(5) + "," + LIQUIDITY + "," + TRENDS + "," + SANDWICH.replace("found AS", "found_s AS", 1) + JIT.removeprefix(SESSIONS).replace("found AS", "found_j AS", 1) + """,
al AS (SELECT "pairAddress" AS pair, "windowEnd" AS seen FROM found_s UNION ALL SELECT "pairAddress", "windowEnd" FROM found_j),
day AS (SELECT 1706572800000 - 86400000 AS a, 1706572800000 AS b),
pairs AS (SELECT "pairAddress" AS pair FROM tw UNION SELECT "pairAddress" FROM lw UNION SELECT pair FROM al UNION SELECT "pairAddress" FROM mt),
ht AS (SELECT "pairAddress" AS pair, count(*) AS w, sum("volumeUSD") AS usd, max("uniqueTraders") AS u FROM tw, day WHERE "windowStart" BETWEEN a AND b GROUP BY 1),
hl AS (SELECT "pairAddress" AS pair, count(*) AS l FROM lw, day WHERE "windowStart" BETWEEN a AND b GROUP BY 1),
ha AS (SELECT pair, count(*) AS n FROM al, day WHERE seen BETWEEN a AND b GROUP BY 1),
hm AS (SELECT "pairAddress" AS pair, arg_max(trend, ("windowStart", "windowId")) AS trend FROM mt GROUP BY 1),
sc AS (
  SELECT pair, least(coalesce(w, 0) / 24.0::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE + least(coalesce(usd, 0) / 100000.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE + least(coalesce(u, 0) / 10.0::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE AS ts,
    CASE WHEN coalesce(l, 0) = 0 THEN 0.5::DOUBLE ELSE least(l / 12.0::DOUBLE, 1.0::DOUBLE) END AS ls, CASE WHEN coalesce(n, 0) = 0 THEN 1.0::DOUBLE WHEN n <= 2 THEN 0.7::DOUBLE WHEN n <= 5 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS ss,
    coalesce(trend, 'UNKNOWN') AS trend, coalesce(n, 0)::INTEGER AS n, coalesce(usd, 0) AS usd, coalesce(u, 0)::INTEGER AS u
  FROM pairs LEFT JOIN ht USING (pair) LEFT JOIN hl USING (pair) LEFT JOIN ha USING (pair) LEFT JOIN hm USING (pair)),
health AS (
  SELECT pair AS "pairAddress", round(ts, 6) AS "tradingScore", round(ls, 6) AS "liquidityScore", round(usd, 6) AS "volumeUSD24h", ss AS "safetyScore", trend, n AS "recentAlertCount", u AS "uniqueTraders24h",
    floor((ts * 0.35::DOUBLE + ls * 0.35::DOUBLE + ss * 0.30::DOUBLE) * 100 + 0.5) / 100 AS "overallScore" FROM sc)"""
_RANGE = f""" WHERE "pairAddress" = '{POOL}' AND "windowStart" BETWEEN {FROM} AND {TO}"""
_LATEST = """ QUALIFY row_number() OVER (PARTITION BY "pairAddress" ORDER BY "windowStart" DESC, "windowId" DESC) = 1"""
_BAD = """CASE seq % 11 WHEN 0 THEN 'not json' WHEN 1 THEN '{"type":"' || ty || '"}' WHEN 2 THEN '{"specversion":"1.0","type":"' || ty || '","data":{"a":1}}' WHEN 3 THEN ''
  WHEN 4 THEN '{"specversion":"1.0","type":"' || ty || '","data":"' || tx || '"}' ELSE '{"specversion":"1.0","type":"' || ty || '","data_base64":"' || to_base64(encode(tx)) || '"}' END"""
_ENVELOPES = EV + f""", v AS (SELECT *, {_BAD} AS value FROM (SELECT *, 'com.dex.events.' || lower(kind) AS ty FROM e)),
broken AS (SELECT *, CASE WHEN seq % 11 IN (0, 1, 3) THEN 'INVALID_ENVELOPE' WHEN seq % 11 = 2 THEN 'PAYLOAD_EXTRACTION' END AS err FROM v)"""

SQL = {
    "channel_frames": EV + "," + _windows(5) + "," + TRENDS + """SELECT 'trading' AS channel, "pairAddress" AS pair, 'trading' AS named, "pairAddress" AS of, "windowId", twap AS price FROM tw
UNION ALL SELECT 'trends', "pairAddress", 'trends', "pairAddress", "windowId", "avgPrice" FROM mt""",
    "trading_windows_5m": TW + "SELECT * FROM tw",
    "trading_windows_multi": EV + "," + ",".join(_windows(m, name=f"w{m}") for m in (5, 15, 60)) + " " + " UNION ALL ".join(f"SELECT *, 'dex-trading-analytics-{m}m' AS topic FROM w{m}" for m in (5, 15, 60)),
    "trader_activity": TW + 'SELECT "pairAddress", "windowStart", "uniqueTraders", "repeatedTraders" FROM tw',
    "largest_swap": EV + "," + _windows(60) + 'SELECT "windowId", "largestSwapValue", "largestSwapAddress" FROM tw',
    "market_trends": EV + "," + TRENDS + "SELECT * FROM mt",
    "liquidity_windows": EV + "," + LIQUIDITY + "SELECT * FROM lw",
    "lp_token_flows": EV + "," + LIQUIDITY + "SELECT " + ", ".join(f'"{c}"' for c in api.FLOWS) + " FROM lw",
    "mev_sessions": EV + "," + SESSIONS + """SELECT pair AS "pairAddress", ws AS "windowStart", we AS "windowEnd", count(*) AS "eventCount", count(*) FILTER (WHERE kind = 'Swap') AS "swapCount" FROM x GROUP BY pair, ws, we""",
    "sandwich_attacks": EV + "," + SANDWICH + "SELECT * FROM found",
    "jit_liquidity": EV + "," + JIT + "SELECT * FROM found",
    "all_events_union": EV + 'SELECT kind AS "eventType", pair AS "pairAddress", count(*) AS n, max(t) AS latest FROM e GROUP BY ALL',
    "swap_direction": EV + "SELECT seq, CASE WHEN even THEN 'BUY_TOKEN1' ELSE 'BUY_TOKEN0' END AS direction FROM s",
    "twap_series": TW + 'SELECT "windowId", "windowStart", "windowEnd", twap FROM tw' + _RANGE,
    "ohlc_series": TW + 'SELECT "windowId", "windowStart", "windowEnd", "openPrice" AS open, "highPrice" AS high, "lowPrice" AS low, "closePrice" AS close FROM tw' + _RANGE,
    "volume_series": TW + 'SELECT "windowId", "windowStart", "windowEnd", "volumeUSD", "totalVolume0", "totalVolume1", "swapCount" FROM tw' + _RANGE,
    "liquidity_series": EV + "," + LIQUIDITY + "SELECT * FROM lw" + _RANGE,
    "trend_series": EV + "," + TRENDS + "SELECT * FROM mt" + _RANGE,
    "latest_trading": TW + "SELECT * FROM tw" + _LATEST,
    "latest_liquidity": EV + "," + LIQUIDITY + "SELECT * FROM lw" + _LATEST,
    "latest_trend": EV + "," + TRENDS + "SELECT * FROM mt" + _LATEST,
    "alerts_range": EV + "," + SANDWICH.replace("found AS", "found_s AS", 1) + JIT.removeprefix(SESSIONS).replace("found AS", "found_j AS", 1) + f"""SELECT *, "windowEnd" AS "detectedAt" FROM (SELECT * FROM found_s UNION ALL SELECT * FROM found_j) WHERE "pairAddress" = '{POOL}' AND "windowEnd" BETWEEN {FROM} AND {TO}""",
    "pool_health": HEALTH + "SELECT * FROM health",
    "leaderboard": HEALTH + 'SELECT "pairAddress", "overallScore", trend FROM health ORDER BY "overallScore" DESC, "pairAddress"',
    "analytics_summary": EV + "," + _windows(5) + "," + LIQUIDITY + """SELECT (SELECT count(DISTINCT "pairAddress") FROM tw) AS "tradingPairsTracked", (SELECT count(*) FROM tw) AS "totalTradingWindows", (SELECT count(DISTINCT "pairAddress") FROM lw) AS "liquidityPairsTracked", (SELECT count(*) FROM lw) AS "totalLiquidityWindows" """,
    "pair_summaries": TW + f"""SELECT "pairAddress", "token0Symbol", "token1Symbol", twap AS "latestTwap", "volumeUSD" AS "latestVolumeUSD", n AS "windowCount" FROM (SELECT *, count(*) FILTER (WHERE "windowStart" BETWEEN 0 AND {NOW}) OVER (PARTITION BY "pairAddress") AS n FROM tw)""" + _LATEST,
    "tracked_pairs": EV + 'SELECT DISTINCT pair AS "pairAddress" FROM e',
    "retention_view": TW + f'SELECT * FROM tw WHERE "windowStart" > {NOW} - 168 * 3600000',
    "enriched_swaps": EV + """SELECT tx || ':' || li AS "eventId", round((a1::DOUBLE / 1e16) / (a0::DOUBLE / 1e18), 6) AS price, round(a1::DOUBLE / 1e16 * 2, 6) AS "volumeUSD", gas AS "gasUsed", gasprice::VARCHAR AS "gasPrice" FROM s""",
    "price_asof": """WITH r AS (SELECT 'token-' || (l_partkey % 50) AS token, CAST(epoch(CAST(l_shipdate AS TIMESTAMP)) AS BIGINT) + l_linenumber * 3600 + l_orderkey % 3600 AS at, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS answer FROM lineitem GROUP BY ALL),
a AS (SELECT o_orderkey AS id, 'token-' || (o_custkey % 50) AS token, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + 43200 AS at FROM orders)
SELECT a.id, a.token, CASE WHEN a.at - r.at <= 86400 THEN round(r.answer::DOUBLE / 1e8, 8) END AS usd FROM a ASOF LEFT JOIN r ON a.token = r.token AND a.at >= r.at""",
    "finality_release": EV + """SELECT pair AS "pairAddress", block AS "blockNumber", seq, tx || ':' || li AS "eventId" FROM (SELECT *, max(block) OVER (PARTITION BY pair) AS tip FROM e) WHERE tip >= 64 AND block <= tip - 64""",
    "topic_routing": EV + """SELECT CASE WHEN kind = 'Swap' THEN 'dex-trading-events' ELSE 'dex-liquidity-events' END AS topic, pair AS "partitionKey", count(*) AS n FROM e GROUP BY ALL""",
    "envelope_decode": _ENVELOPES + """SELECT seq, CASE WHEN seq % 11 IN (0, 3) THEN '' ELSE ty END AS type, coalesce(err, CASE WHEN kind <> 'Swap' THEN 'UNSUPPORTED_EVENT_TYPE' END) AS error, CASE WHEN err IS NULL THEN tx END AS body FROM broken""",
    "decode_errors": _ENVELOPES + f"""SELECT 'liquidity' AS stream, reason, octet_length(encode(value))::INTEGER AS "payloadSize", lower(hex(encode(value[1:16]))) AS "payloadPreview", {NOW}::BIGINT AS "failedAt", count(*) AS n FROM (SELECT *, coalesce(err, CASE WHEN kind = 'Swap' THEN 'UNSUPPORTED_EVENT_TYPE' END) AS reason FROM broken) WHERE reason IS NOT NULL GROUP BY ALL""",
    "avro_round_trip": EV + """SELECT tx || ':' || li AS "eventId", block AS "blockNumber", t AS "blockTimestamp", tx AS "transactionHash", li AS "logIndex", pair AS "pairAddress", 'token-a' AS token0, 'token-b' AS token1, sym0 AS "token0Symbol", sym1 AS "token1Symbol", replace(sender, 't', 'T')[1:1] || sender[2:] AS sender, 'T' || recipient[2:] AS recipient,
  CASE WHEN even THEN a0::VARCHAR ELSE '0' END AS "amount0In", CASE WHEN even THEN '0' ELSE a1::VARCHAR END AS "amount1In", CASE WHEN even THEN '0' ELSE a0::VARCHAR END AS "amount0Out", CASE WHEN even THEN a1::VARCHAR ELSE '0' END AS "amount1Out", price, usd AS "volumeUSD", gas AS "gasUsed", gasprice::VARCHAR AS "gasPrice", t AS "eventTimestamp" FROM s""",
}
