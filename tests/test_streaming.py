"""A stream over files gives what a batch over the same rows gives, for all windows that have closed."""

from pyspark.sql import functions as F

from tests.test_engine import BUY, SELL, events, swap
from tidemark.operators import liquidity, sessions, trading
from tidemark.streaming import jobs

T0 = 1_700_000_000


def source(spark, tmp_path, df, files=3):
    path = str(tmp_path / "in")
    df.repartitionByRange(files, "blockTimestamp").sortWithinPartitions("blockTimestamp").write.parquet(path)
    return jobs.with_lateness(jobs.read_files(spark, path, df.schema))


def many(spark):
    rows = [swap(blockTimestamp=T0 + 40 * i, price=1.0 + i / 10, sender=f"s{i % 3}", recipient="r", volumeUSD=float(i)) for i in range(30)]
    rows += [("Mint", dict(blockTimestamp=T0 + 100 + i, sender=f"p{i % 2}", amount0="5", amount1="6")) for i in range(4)] + [("Burn", dict(blockTimestamp=T0 + 105, sender="p1", amount0="1", amount1="1"))]
    rows += [swap(blockTimestamp=T0 + 50, blockNumber=7, sender="A", **BUY), swap(blockTimestamp=T0 + 50, blockNumber=7, sender="V", **BUY), swap(blockTimestamp=T0 + 51, blockNumber=7, sender="A", **SELL)]
    return events(spark, *rows, swap(blockTimestamp=T0 + 90_000), swap(blockTimestamp=T0 + 180_000))


def drained(query):
    query.awaitTermination(120)
    assert query.exception() is None


def same(a, b, names):
    key = lambda rows: sorted(map(str, rows))
    assert key(a.select(*names).collect()) == key(b.select(*names).collect())


def closed(df, end="windowEnd"):
    return df.where(F.col(end) < (T0 + 90_000) * 1000)


def test_trading_and_trends(spark, tmp_path):
    df = many(spark)
    stream = source(spark, tmp_path, df, 1)
    for name, plan, batch in (("a", jobs.trading_stream, trading.trading_windows), ("b", jobs.trend_stream, trading.market_trends)):
        out = str(tmp_path / name)
        drained(jobs.start_append(plan(stream), out, str(tmp_path / f"c{name}"), availableNow=True))
        got = spark.read.parquet(out)
        same(closed(got), closed(batch(df)), batch(df).columns)
        assert closed(got).count() > 0


def test_liquidity_and_alerts(spark, tmp_path):
    df = many(spark)
    stream = source(spark, tmp_path, df, 1)
    sink = lambda path: lambda rows, n: rows.write.mode("append").parquet(path)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    later = df.where("eventType <> 'Swap'").unionByName(events(spark, ("Mint", dict(blockTimestamp=T0 + 90_000, sender="z", amount0="1", amount1="1"))))
    (tmp_path / "l").mkdir()
    drained(jobs.start_liquidity(source(spark, tmp_path / "l", later, 1), 60, sink(a), str(tmp_path / "ca"), availableNow=True))
    batch = liquidity.liquidity_windows(df)
    same(closed(spark.read.parquet(a)), closed(batch), batch.columns)
    drained(jobs.start_alerts(stream, 3, sink(b), str(tmp_path / "cb"), availableNow=True))
    batch = sessions.alerts(df, 3)
    same(spark.read.parquet(b), batch, batch.columns)
    assert batch.count() > 0


def test_finality_gate(spark, tmp_path):
    df = events(spark, *[swap(blockNumber=b) for b in (100, 101, 102, 103)])
    stream = jobs.read_files(spark, _written(df, tmp_path), df.schema)
    drained(jobs.start_append(jobs.finality_gate(stream, 3), str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True))
    assert [r.blockNumber for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [100]
    assert jobs.finality_gate(stream, 0) is stream


def test_copies_go_only_if_asked(spark, tmp_path):
    df = events(spark, swap(eventId="a"), swap(eventId="a"), swap(eventId="b"))
    assert jobs.without_copies(df).count() == 2
    stream = jobs.with_lateness(jobs.read_files(spark, _written(df, tmp_path), df.schema))
    drained(jobs.start_append(jobs.without_copies(stream), str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def _written(df, tmp_path):
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    return path


def test_fan_out_reaches_every_sink(spark, tmp_path):
    df = events(spark, swap(), swap())
    stream, seen = jobs.read_files(spark, _written(df, tmp_path), df.schema), []
    drained(jobs.start_fan_out(stream, [lambda b, n: seen.append(("x", b.count())), lambda b, n: seen.append(("y", b.count()))], str(tmp_path / "c"), availableNow=True))
    assert seen == [("x", 2), ("y", 2)]


def test_held_events_keep_all_their_digits_and_a_flush_lets_them_go(spark, tmp_path):
    values = [1.234567890123456, 1.2e-11, 0.1 + 0.2]
    path = tmp_path / "in"
    for k, rows in enumerate([[swap(blockNumber=100, price=values[0]), swap(blockNumber=101, price=values[1], volumeUSD=values[2], token0Symbol=None)], [swap(blockNumber=103)], [("Flush", {})]]):
        events(spark, *rows).coalesce(1).write.parquet(str(path / f"{k}"))
    schema = events(spark, swap()).schema
    stream = jobs.read_files(spark, str(path / "*"), schema, files_per_trigger=1)
    drained(jobs.start_append(jobs.finality_gate(stream, 3), str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True))
    rows = {r.blockNumber: r for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()}
    assert sorted(rows) == [100, 101, 103]
    assert (rows[100].price, rows[101].price, rows[101].volumeUSD, rows[101].token0Symbol) == (*values, None)
    assert rows[101].event_time == events(spark, swap()).first().event_time


def test_a_hot_pool_counts_its_traders_by_trader(spark):
    df = many(spark)
    by_trader = trading.windows_with_traders(trading.swaps_of(df), F.window("event_time", "5 minutes"))
    plan = by_trader._jdf.queryExecution().executedPlan().toString()
    assert "trader" in plan and "Join" not in plan
    same(trading.finish(by_trader, "uniqueTraders", "repeatedTraders"), trading.trading_windows(df), trading.trading_windows(df).columns)


def test_rows_for_a_broker_are_keyed_by_pool(spark):
    row = jobs.broker_rows(trading.trading_windows(events(spark, swap(token0Symbol=None)))).first()
    assert row.key == "0xPair" and '"token0Symbol":null' in row.value
