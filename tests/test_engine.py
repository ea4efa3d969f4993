"""Scenarios of the engine on small tables; values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.config import EngineConfig, check_address, check_endpoint, result_topics
from tidemark.functions import bigint
from tidemark.functions import scalars as S
from tidemark.operators import decode, liquidity, prices, sessions, store, trading
from tidemark.plans import api
from tidemark.sources import chain

WIDE = T.StructType([T.StructField("eventType", T.StringType()), *{f.name: f for s in schemas.EVENTS.values() for f in s.fields}.values(), T.StructField("seq", T.LongType())])
BASE = dict(blockNumber=100, blockTimestamp=1_700_000_000, logIndex=0, pairAddress="0xPair", token0Symbol="A", token1Symbol="B", transactionHash="0xt")


def events(spark, *rows):
    out = []
    for k, (kind, fields) in enumerate(rows):
        row = BASE | {"eventType": kind, "seq": k, "logIndex": k, "transactionHash": f"0xt{k}"} | ({"price": 1.0, "amount0In": "100", "amount1In": "0", "amount0Out": "0", "amount1Out": "100", "gasUsed": 1, "gasPrice": "1", "sender": f"0xs{k}", "recipient": f"0xr{k}"} if kind == "Swap" else {}) | fields
        out.append(tuple(row.get(f.name) for f in WIDE.fields))
    return spark.createDataFrame(out, WIDE).withColumn("event_time", F.timestamp_seconds("blockTimestamp"))


def one(df):
    (row,) = df.collect()
    return row


def swap(**fields):
    return "Swap", fields


def test_big_integers_are_exact(spark):
    r = random.Random(4)
    values = [r.choice([-1, 1, 1]) * r.getrandbits(r.choice([1, 60, 128, 250])) for _ in range(300)] + [0, 10**77, -(10**18), 10**18 - 1]
    df = spark.createDataFrame([(k % 7, str(v), str(values[-1 - k])) for k, v in enumerate(values)], "g int, a string, b string")
    text = df.select("a", "b", bigint.to_text(bigint.plus(bigint.limbs(F.col("a")), bigint.limbs(F.col("b")))).alias("s"), bigint.divided(bigint.limbs(F.col("a")), F.lit(7)).alias("q")).collect()
    assert all(int(x.s) == int(x.a) + int(x.b) for x in text)
    assert all(int(x.q) == int(abs(int(x.a)) // 7) * (1 if int(x.a) >= 0 else -1) for x in text)
    total = df.groupBy("g").agg(bigint.sums(bigint.limbs(F.col("a"))).alias("t")).select("g", bigint.to_text(bigint.of_struct("t")).alias("t")).collect()
    assert {x.g: int(x.t) for x in total} == {g: sum(v for k, v in enumerate(values) if k % 7 == g) for g in range(7)}


@pytest.mark.parametrize(("text", "want"), [(" 12 ", "12"), ("", "0"), (None, "0"), ("-", "0"), ("+1", "0"), ("1.5", "0"), ("0x1", "0"), ("-007", "-7")])
def test_what_counts_as_a_number(spark, text, want):
    df = spark.createDataFrame([(text,)], "a string")
    assert one(df.select(bigint.to_text(bigint.limbs(F.col("a"))).alias("x"))).x == want


@pytest.mark.parametrize(("text", "want"), [("1234567890123456789012\n", "1234567890123456789012"), ("\t12", "12"), ("\x00 12\x1f", "12"), ("1\n2", "0"), ("\u0661\u0662", "12"), ("-\uff11\uff12", "-12"), ("\u00a012", "0"), ("0" * 95 + "7", "7")])
def test_blanks_line_ends_and_digits_of_other_scripts(spark, text, want):
    assert one(spark.createDataFrame([(text,)], "a string").select(bigint.to_text(bigint.limbs(F.col("a"))).alias("x"))).x == want


def test_numbers_of_any_length_sum_exactly(spark):
    r = random.Random(6)
    values = [r.choice([-1, 1]) * r.getrandbits(r.choice([8, 200, 299, 512, 1000])) for _ in range(200)] + [int("9" * 300), -int("9" * 300), 2**512 - 1, 10**90, 10**90 - 1, -(10**90)]
    df = spark.createDataFrame([(k % 5, f" {v}\n", str(values[-1 - k])) for k, v in enumerate(values)], "g int, a string, b string")
    pairs = df.select("a", "b", *[bigint.to_text(f(bigint.limbs(F.col("a")), bigint.limbs(F.col("b")))).alias(n) for n, f in (("s", bigint.plus), ("d", bigint.minus))], bigint.divided(bigint.limbs(F.col("a")), F.lit(7)).alias("q")).collect()
    assert all(int(x.s) == int(x.a) + int(x.b) and int(x.d) == int(x.a) - int(x.b) for x in pairs)
    assert all(int(x.q) == abs(int(x.a)) // 7 * (1 if int(x.a) >= 0 else -1) for x in pairs)
    parts = df.groupBy("g", (F.length("a") % 3).alias("h")).agg(bigint.sums(bigint.limbs(F.col("a"))).alias("t"))
    total = parts.groupBy("g").agg(bigint.merged("t")).select("g", bigint.to_text(bigint.of_struct("t")).alias("t")).collect()
    assert {x.g: int(x.t) for x in total} == {g: sum(v for k, v in enumerate(values) if k % 5 == g) for g in range(5)}
    keys = df.select("b", bigint.sort_key(bigint.limbs(F.translate("b", "-", ""))).alias("k")).collect()
    assert [abs(int(x.b)) for x in sorted(keys, key=lambda x: x.k)] == sorted(abs(v) for v in values)


def test_one_long_number_ends_no_job(spark):
    huge = str(2**512 - 1)
    row = one(liquidity.liquidity_windows(events(spark, ("Mint", dict(sender="p", amount0=huge, amount1="1", transactionHash="a")), ("Burn", dict(sender="p", amount0="5", amount1=huge, transactionHash="a")), ("Transfer", dict(value=huge, transactionHash="a")))))
    assert (row.totalMintAmount0, row.netLiquidityChange0, row.netLiquidityChange1, row.totalLpTokensMinted, row.netLpTokenChange) == (huge, str(2**512 - 6), str(2 - 2**512), huge, "0")
    row = one(trading.trading_windows(events(spark, swap(amount0In=huge, amount0Out="1", gasPrice="9" * 300), swap(amount0In="7", gasPrice="1"))))
    assert (row.totalVolume0, row.largestSwapValue, row.averageGasPrice) == (str(2**512 + 7), str(2**512), str(10**300 // 2))


def test_symbols_of_white_space_are_none(spark):
    df = spark.createDataFrame([(None, "B"), (" \t\n", "B"), ("\u2003", "B"), ("A", "B"), ("", "\x1f"), ("\u00a0", "B")], "a string, b string")
    assert [r.x for r in df.select(S.prefer_symbol(F.col("a"), F.col("b")).alias("x")).collect()] == ["B", "B", "B", "A", None, "\u00a0"]


def test_round8_is_half_up_and_drops_what_is_no_number(spark):
    df = spark.createDataFrame([(1.000000005, float("nan"), float("inf"))], "a double, b double, c double")
    assert tuple(one(df.select(*[S.round8(F.col(c)) for c in "abc"]))) == (1.00000001, None, None)


def test_average_price_is_weighted_by_volume(spark):
    row = one(trading.trading_windows(events(spark, swap(price=1000.0, amount0In="1000"), swap(price=3000.0, amount0In="1000"))))
    assert (row.twap, row.swapCount, row.totalVolume0) == (2000.0, 2, "2000")
    assert one(trading.trading_windows(events(spark, swap(price=9.0, amount0In="0")))).twap == 9.0  # without volume, the close


def test_the_record_of_an_empty_window(spark):
    row = one(trading.empty_window(spark, "p", 0, 300_000))
    assert (row.windowId, row.twap, row.swapCount, row.volumeUSD, row.averageGasPrice, row.repeatedTraders) == ("p:0:300000", 0.0, 0, None, "0", [])


def test_prices_follow_time_then_log_then_arrival(spark):
    same = [swap(price=p, logIndex=0) for p in (100.0, 150.0, 80.0, 120.0)]
    row = one(trading.trading_windows(events(spark, *same)))
    assert (row.openPrice, row.highPrice, row.lowPrice, row.closePrice) == (100.0, 150.0, 80.0, 120.0)
    t = BASE["blockTimestamp"]
    row = one(trading.trading_windows(events(spark, swap(price=200.0, blockTimestamp=t + 20), swap(price=100.0, blockTimestamp=t + 10), swap(price=300.0, blockTimestamp=t + 30))))
    assert (row.openPrice, row.closePrice) == (100.0, 300.0)


def test_traders_gas_and_largest(spark):
    rows = [swap(sender="0xAlice", recipient="0xBob", volumeUSD=500.0, gasUsed=21000, gasPrice="100"), swap(sender="0xALICE", recipient="0xalice", gasUsed=42000, gasPrice="201"), swap(sender="0xalice", recipient=None, volumeUSD=300.0, gasUsed=0, gasPrice="bad")]
    row = one(trading.trading_windows(events(spark, *rows)))
    assert (row.uniqueTraders, row.repeatedTraders, row.arbitrageCount) == (3, ["0xalice"], 1)
    assert (row.totalGasUsed, row.averageGasPrice, row.volumeUSD) == (63000, "100", 800.0)
    assert (row.largestSwapValue, row.largestSwapAddress) == ("500.00 USD", "0xalice")
    row = one(trading.trading_windows(events(spark, swap(amount0In="100"), swap(amount0In="500", sender="0xLarge"))))
    assert (row.largestSwapValue, row.largestSwapAddress, row.volumeUSD) == ("500", "0xlarge", None)
    row = one(trading.trading_windows(events(spark, swap(amount0In="0"))))
    assert (row.largestSwapValue, row.largestSwapAddress) == ("0", "")


def test_states_merge_in_any_split(spark):
    r = random.Random(1)
    rows = [swap(price=r.random(), amount0In=str(r.getrandbits(200)), volumeUSD=r.choice([None, float(r.randint(1, 9))])) for _ in range(30)]
    df, window = events(spark, *rows), F.window("event_time", "5 minutes")
    whole = one(trading.finish(trading.partials(df, window)).drop("window"))
    parts = trading.partials(df.where("seq % 3 = 0"), window).unionByName(trading.partials(df.where("seq % 3 = 1"), window)).unionByName(trading.partials(df.where("seq % 3 = 2"), window))
    merged = one(trading.finish(trading.merge(parts)).drop("window"))
    a, b = whole.asDict(), merged.asDict()
    assert all(a[k] == pytest.approx(b[k]) if isinstance(a[k], float) else a[k] == b[k] for k in a)


def test_a_day_of_the_exchange(spark):
    t = 1_700_000_000
    swaps = [swap(blockTimestamp=t + 20 * i, price=0.8 + 0.01 * i, amount0In=str((i + 1) * 10**18), amount1Out=str(800000 * (i + 1)), volumeUSD=0.8 * (i + 1), gasUsed=150000, gasPrice="30000000000", sender=f"0xsender{i:04d}") for i in range(10)]
    first, second = trading.trading_windows(events(spark, *swaps)).orderBy("windowStart").collect()
    assert (first.windowStart, first.windowEnd, first.swapCount, first.twap, first.volumeUSD) == (1699999800000, 1700000100000, 5, 0.82666667, 12.0)
    assert (first.totalVolume0, first.totalVolume1, first.largestSwapValue) == (str(15 * 10**18), "12000000", "4.00 USD")
    assert (second.twap, second.volumeUSD, second.largestSwapAddress, second.totalGasUsed) == (0.8725, 32.0, "0xsender0009", 750000)
    trends = trading.market_trends(events(spark, *swaps)).orderBy("windowStart").collect()
    assert [x.swapCount for x in trends] == [5, 10, 10, 10, 10, 10, 5]
    assert [x.priceChangePercent for x in trends] == [5.0, *[11.25] * 5, 4.70588235]
    assert {x.trend for x in trends} == {"BULLISH"}


@pytest.mark.parametrize(("prices_", "trend", "percent"), [((1.0, 1.5), "BULLISH", 50.0), ((1.5, 1.0), "BEARISH", -33.33333333), ((1.0, 1.005), "NEUTRAL", 0.5), ((0.0, 1.0), "NEUTRAL", 0.0)])
def test_trend_classes(spark, prices_, trend, percent):
    row = trading.market_trends(events(spark, *[swap(price=p) for p in prices_])).first()
    assert (row.trend, row.priceChangePercent) == (trend, percent)


def test_liquidity_matches_transfers_by_transaction(spark):
    rows = [
        ("Mint", dict(sender="0xP1", amount0="100", amount1="200", transactionHash="a")), ("Mint", dict(sender="0xp2", amount0="50", amount1="100", transactionHash="b")),
        ("Burn", dict(sender="0xp1", amount0="30", amount1="60", transactionHash="c")), ("Burn", dict(sender="0xp3", amount0="20", amount1="40", transactionHash="b")),
        ("Transfer", dict(value="500", transactionHash="a")), ("Transfer", dict(value="7", transactionHash="b")), ("Transfer", dict(value="9", transactionHash="zz")), ("Transfer", dict(value="x", transactionHash="c")),
    ]
    row = one(liquidity.liquidity_windows(events(spark, *rows)))
    assert (row.totalMintAmount0, row.totalMintAmount1, row.totalBurnAmount0, row.netLiquidityChange1) == ("150", "300", "50", "200")
    assert (row.totalLpTokensMinted, row.totalLpTokensBurned, row.netLpTokenChange, row.transferCount) == ("507", "7", "500", 4)
    assert (row.uniqueMintProviders, row.uniqueBurnProviders, row.uniqueProviders, row.churnedProviders) == (2, 2, 3, 1)
    row = one(liquidity.liquidity_windows(events(spark, ("Transfer", dict(value="5")))))
    assert (row.mintCount, row.uniqueProviders, row.netLpTokenChange, row.token0Symbol) == (0, 0, "0", None)


BUY = dict(amount0In="0", amount1In="5", amount0Out="5", amount1Out="0")
SELL = dict(amount0In="5", amount1In="0", amount0Out="0", amount1Out="5")


def test_sandwich_and_its_absence(spark):
    found = one(sessions.sandwiches(events(spark, swap(sender="0xA", volumeUSD=100.0, **BUY), swap(sender="0xV", **BUY), swap(sender="0xa", volumeUSD=130.0, **SELL)), 3))
    assert (found.attackerAddress, found.victimAddresses, found.involvedSwapCount, found.severity, found.estimatedProfitUSD) == ("0xa", ["0xv"], 3, "MEDIUM", 30.0)
    none = [[("A", BUY), ("V", BUY), ("B", SELL)], [("A", BUY), ("A", SELL)], [("A", BUY), ("V", BUY), ("A", BUY)], [("A", BUY), ("A", BUY), ("A", SELL)]]
    for rows in none:
        assert sessions.sandwiches(events(spark, *[swap(sender=w, **way) for w, way in rows]), 3).count() == 0
    unknown = dict(amount0In="0", amount1In="0", amount0Out="0", amount1Out="0")
    assert sessions.sandwiches(events(spark, swap(sender="A", **BUY), swap(sender="V", **BUY), swap(sender="A", **unknown)), 3).count() == 1


def test_sandwiches_agree_with_a_plain_search(spark):
    r = random.Random(9)
    rows = [(r.choice("abc"), r.choice([BUY, SELL, SELL])) for _ in range(60)]
    got = sessions.sandwiches(events(spark, *[swap(sender=w, **way) for w, way in rows]), 3).select("involvedSwapCount", "attackerAddress", "victimAddresses").collect()
    want = []
    for i, (w, way) in enumerate(rows):
        j = next((j for j in range(i + 2, len(rows)) if rows[j][0] == w and rows[j][1] is not way and any(rows[v][0] != w for v in range(i + 1, j))), None)
        if j is not None:
            want.append((j - i + 1, w, [rows[v][0] for v in range(i + 1, j) if rows[v][0] != w]))
    assert sorted(map(tuple, got)) == sorted(want)


def test_just_in_time_liquidity(spark):
    mint, burn = ("Mint", dict(sender="0xP", amount0="1", amount1="1")), ("Burn", dict(sender="0xp", amount0="1", amount1="1"))
    found = one(sessions.jit_liquidity(events(spark, mint, swap(), burn), 3))
    assert (found.alertType, found.severity, found.involvedEventCount, found.attackerAddress) == ("JIT_LIQUIDITY", "MEDIUM", 3, "0xp")
    far = lambda b, n: (b[0], b[1] | dict(blockNumber=n))
    assert sessions.jit_liquidity(events(spark, mint, swap(), far(burn, 105)), 3).count() == 0
    assert sessions.jit_liquidity(events(spark, mint, swap(), far(burn, 99)), 3).count() == 0
    assert sessions.jit_liquidity(events(spark, mint, swap(), ("Burn", dict(sender="0xq"))), 3).count() == 0


def test_a_pause_of_just_the_gap_keeps_a_session(spark):
    t = 86_400 * 19_675 - 3
    times = [t, t + 3, t + 6, t + 10, t + 13]
    got = sessions.session_summary(events(spark, *[swap(blockTimestamp=x) for x in times]), 3).orderBy("windowStart").collect()
    assert [(x.windowStart, x.windowEnd, x.eventCount) for x in got] == [(t * 1000, (t + 9) * 1000, 3), ((t + 10) * 1000, (t + 16) * 1000, 2)]


def test_prices_as_of_a_time(spark):
    rounds = spark.createDataFrame([("a", 1000, "85000000", 8), ("a", 90_000, "200000000000", 8), ("b", 5, "1000000000000000000", 18)], "token string, updatedAt long, answer string, decimals int")
    asked = spark.createDataFrame([(1, "a", 999), (2, "a", 1000), (3, "a", 87_400), (4, "a", 87_401), (5, "a", 95_000), (6, "b", 6), (7, "c", 6)], "id long, token string, at long")
    assert {r.id: r.usd for r in prices.price_asof(asked, rounds).collect()} == {1: None, 2: 0.85, 3: 0.85, 4: None, 5: 2000.0, 6: 1.0, 7: None}
    assert {r.id: r.usd for r in prices.usd_prices(asked, rounds, ["c"]).collect()}[7] == 1.0


def test_scores(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 10)], "n int")
    assert [r[0] for r in df.select(store.safety_score(F.col("n"))).collect()] == [1.0, 0.7, 0.7, 0.4, 0.1]
    full = spark.range(1).select(store.trading_score(F.lit(24), F.lit(100000.0), F.lit(10)), store.trading_score(F.lit(100), F.lit(5e5), F.lit(50)), store.liquidity_score(F.lit(0)), store.liquidity_score(F.lit(3)))
    assert [round(x, 9) for x in one(full)] == [1.0, 1.0, 0.5, 0.25]


def test_the_questions(spark):
    df = events(spark, swap(), ("Mint", dict(sender="p", amount0="1", amount1="1")), ("Transfer", dict(value="1")))
    t = api.Analytics(trading.trading_windows(df), liquidity.liquidity_windows(df), sessions.alerts(df, 3), trading.market_trends(df))
    start = 1_699_999_800_000
    assert one(t.twap("0xPair", start, start)).twap == 1.0
    assert one(t.ohlc("0xPair", 0, start)).asDict().keys() == {"windowId", "windowStart", "windowEnd", "open", "high", "low", "close"}
    assert t.volume("0xPair", 0, start - 1).isEmpty() and t.volume("other", 0, start).isEmpty()
    with pytest.raises(api.NotFound):
        api.some(t.alerts("0xPair", 0, 2 * start))
    health = one(t.pool_health(start + 1000))
    assert (health.trend, health.recentAlertCount, health.uniqueTraders24h) == ("NEUTRAL", 0, 2)
    assert one(t.pool_health(start, "nobody")).overallScore == 0.48
    assert one(t.summary()).totalTradingWindows == 1
    assert one(t.latest_liquidity("0xPair")).mintCount == 1
    assert one(t.pair_summaries(start)).windowCount == 1
    assert t.leaderboard(start).count() == 1 and t.trend_rows("0xPair", 0, 2 * start).count() == 6


def test_parameters():
    assert api.parse_range("p", "x", None, now=10_000_000) == ("p", 6_400_000, 10_000_000)
    with pytest.raises(api.BadRequest):
        api.parse_range("p", "5", "4")
    with pytest.raises(api.BadRequest):
        api.parse_range(" ")
    assert EngineConfig.from_mapping({"TRADING_MINUTES": "5,15"}).trading_minutes == (5, 15)
    for bad in ({"TRADING_MINUTES": "x"}, {"SESSION_GAP_SECONDS": "0"}, {"TREND_SLIDE_MINUTES": "7"}):
        with pytest.raises(ValueError, match="."):
            EngineConfig.from_mapping(bad)
    assert result_topics((5,), "t", False) == {5: "t"} and result_topics((5,), "t", True) == {5: "t-5m"}
    assert check_endpoint("wss://node") and check_address("0x" + "aB" * 20)
    with pytest.raises(ValueError, match="ws"):
        check_endpoint("http://node")


def test_envelopes_and_bodies(spark):
    swaps = events(spark, swap(eventId="t:1", token0="x", token1="y", volumeUSD=2.5, eventTimestamp=5), swap(eventId="t:2", token0="x", token1="y", token0Symbol=None, eventTimestamp=5, amount0In=str(2**255)))
    wire = decode.envelopes(decode.encode_bodies(swaps, "Swap"))
    assert {r.topic for r in wire.collect()} == {decode.TRADING_TOPIC}
    good, bad = decode.events_from(wire.select("value"), "trading")
    names = [f.name for f in schemas.SWAP.fields]
    assert sorted(map(tuple, good.select(*names).collect()), key=str) == sorted(map(tuple, swaps.select(*names).collect()), key=str)
    assert bad.count() == 0
    broken = ["", None, "x", "[]", '{"type":"com.dex.events.swap"}', '{"specversion":"1.0","type":"com.dex.events.swap","data":{}}', '{"specversion":"1.0","type":"com.dex.events.swap"}', '{"specversion":"1.0","type":"com.dex.events.swap","data_base64":"%%"}', '{"specversion":"1.0","type":"com.dex.events.mint","data":"a"}', '{"specversion":"1.0","type":"com.dex.events.swap","data":"a"}']
    df = spark.createDataFrame([(x,) for x in broken], "value string")
    _, bad = decode.events_from(df, "trading")
    want = {"": decode.INVALID, None: decode.INVALID, "x": decode.INVALID, "[]": decode.INVALID, broken[4]: decode.INVALID, broken[5]: decode.PAYLOAD, broken[6]: decode.PAYLOAD, broken[7]: decode.BASE64, broken[8]: decode.TYPE, broken[9]: decode.AVRO}
    assert {r.value: r.error for r in bad.collect()} == want
    routed = decode.route(decode.parse_envelopes(df), "liquidity")
    record = one(decode.error_rows(routed, "liquidity", 7).where("reason = 'UNSUPPORTED_EVENT_TYPE'").limit(1))
    assert (record.stream, record.payloadPreview, record.failedAt) == ("liquidity", b'{"specversion":"'.hex(), 7)


def test_channels_and_results(spark):
    assert decode.wanted_channels("only ALERTS and trends") == ["alerts", "trends"] and decode.wanted_channels("") == list(decode.CHANNELS)
    row = trading.trading_windows(events(spark, swap()))
    text = decode.to_json_records(row)
    wrapped = text.select(F.concat(F.lit('{"data":'), "value", F.lit("}")).alias("value")).unionByName(spark.createDataFrame([("{}",), ("no",)], "value string"))
    good, bad = decode.results_from(wrapped, "trading-analytics")
    assert one(good).windowId == one(row).windowId and sorted(r.error for r in bad.collect()) == ["no data", "not JSON"]


def test_logs_become_events(spark):
    word = lambda n: f"{n:064x}"
    address = lambda c: "0x" + "0" * 24 + c * 40
    top = chain.SIGNATURES
    logs = [
        (100, "0xa", 0, "0xpool", [top["Swap"], address("1"), address("2")], "0x" + word(10**18) + word(0) + word(0) + word(2 * 10**6)),
        (100, "0xa", 1, "0xpool", [top["Transfer"], address("0"), address("2")], "0x" + word(5)),
        (100, "0xb", 2, "0xpool", [top["Mint"], address("1")], "0x" + word(7) + word(2**256 - 1)),
        (100, "0xb", 3, "0xpool", ["0xother"], "0x"), (100, "0xb", 4, "0xpool", [top["Burn"], address("1")], "0x"), (100, "0xb", 5, "0xpool", [top["Swap"], address("1"), address("2")], "0x12"),
        (1, "0xc", 0, "0xpool", [top["Mint"], address("1")], "0x"), (1000, "0xc", 0, "0xelse", [top["Mint"], address("1")], "0x"),
    ]
    df = spark.createDataFrame(logs, "blockNumber long, transactionHash string, logIndex int, address string, topics array<string>, data string")
    pairs = spark.createDataFrame([("0xpool", "0xt0", "0xt1", 18, 6)], "pairAddress string, token0 string, token1 string, decimals0 int, decimals1 int")
    assert chain.subscribed(df, pairs, 950).count() == 5 and chain.subscribed(df, pairs, 0).count() == 0
    parsed = chain.parse_logs(df.where("blockNumber = 100"))
    assert [r.error for r in parsed.orderBy("logIndex").collect()] == [None, "zero address", None, "unknown event", "missing topics", "short data"]
    blocks = spark.createDataFrame([(100, 5000)], "blockNumber long, blockTimestamp long")
    receipts = spark.createDataFrame([("0xa", 21000, None)], "transactionHash string, gasUsed long, effectiveGasPrice string")
    tokens = spark.createDataFrame([("0xt0", "AAA"), ("0xt1", "x" * 21)], "token string, symbol string")
    rounds = spark.createDataFrame([("0xt0", 4000, "300000000", 8)], "token string, updatedAt long, answer string, decimals int")
    rows = {r.eventType: r for r in chain.enrich(parsed, blocks, receipts, tokens, pairs, rounds, []).collect()}
    s, m = rows["Swap"], rows["Mint"]
    assert (s.price, s.volumeUSD, s.gasUsed, s.gasPrice, s.token0Symbol, s.token1Symbol, s.eventId) == (2.0, 3.0, 21000, "0", "AAA", None, "0xa:0")
    assert (m.amount1, m.price, m.blockTimestamp) == (str(2**256 - 1), None, 5000)


def test_blocks_are_released_once_final(spark):
    df = events(spark, *[swap(blockNumber=b) for b in (102, 100, 101, 103)])
    assert [r.blockNumber for r in chain.released(df, 3).collect()] == [100]
    assert chain.released(df, 0).count() == 4 and chain.released(df, 500).count() == 0


def test_retention_and_sets(spark):
    df = spark.createDataFrame([("p", 0, "a"), ("p", 10 * store.HOUR, "b"), ("q", 10 * store.HOUR, "c")], "pairAddress string, windowStart long, windowId string")
    assert store.retained(df, 11 * store.HOUR, 1).count() == 0 and store.retained(df, 11 * store.HOUR, 2).count() == 2
    assert [r.windowId for r in store.latest(df).orderBy("pairAddress").collect()] == ["b", "c"]
    assert store.tracked_pairs(df, df).count() == 2


def test_a_batch_of_results_that_is_written_again_counts_once(spark, tmp_path):
    rows, path = trading.trading_windows(events(spark, swap(), swap(blockTimestamp=1_700_100_000), swap(blockTimestamp=1_700_900_000))), str(tmp_path / "t")
    for part in (rows.limit(2), rows, rows):
        store.write_results(part, path)
    assert store.read_results(spark, path, rows.schema).count() == 3
    assert store.drop_expired(spark, path, 1_700_900_000_000, 24) == 2 and store.read_results(spark, path, rows.schema).count() == 1


def test_prices_do_not_multiply_logs(spark):
    word = lambda n: f"{n:064x}"
    address = "0x" + "0" * 24 + "1" * 40
    log = (100, "0xa", 0, "0xpool", [chain.SIGNATURES["Swap"], address, address], "0x" + word(100) + word(0) + word(0) + word(50))
    logs = spark.createDataFrame([log, log], "blockNumber long, transactionHash string, logIndex int, address string, topics array<string>, data string")
    pairs = spark.createDataFrame([("0xpool", "t0", "t1", 0, 0)], "pairAddress string, token0 string, token1 string, decimals0 int, decimals1 int")
    blocks, receipts = spark.createDataFrame([(100, 5000)], "blockNumber long, blockTimestamp long"), spark.createDataFrame([], "transactionHash string, gasUsed long, effectiveGasPrice string")
    rounds = spark.createDataFrame([("t0", 4000, "300", 2), ("t0", 4000, "200", 2)], "token string, updatedAt long, answer string, decimals int")
    rows = chain.enrich(chain.parse_logs(logs), blocks, receipts, spark.createDataFrame([], "token string, symbol string"), pairs, rounds, []).collect()
    assert [r.volumeUSD for r in rows] == [300.0, 300.0]
    bad = spark.createDataFrame([(*log[:5], "0x" + "z" * 256)], logs.schema)
    assert one(chain.parse_logs(bad)).error == "data is not hexadecimal"


def test_written_results_are_pruned_by_pool_and_day(spark, tmp_path):
    store.write_results(trading.trading_windows(events(spark, swap(), swap(blockTimestamp=1_700_100_000))), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 2 and set(back.columns) >= {"pairAddress", "day", "twap"}
