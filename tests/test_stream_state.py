"""Streams over several triggers and restarts: what they hold, wait for, publish and count."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_engine import BASE, events, one, swap
from tidemark.config import EngineConfig
from tidemark.operators import decode, liquidity, store, trading
from tidemark.sources import chain, log_files
from tidemark.sources.log_files import LOGS
from tidemark.streaming import corrections, jobs, keyed, lookups, sinks


def arriving(spark, path, *parts):
    """A stream of DataFrames, one a trigger."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/{k}")
    return more(spark, path, parts[0].schema)


def more(spark, path, schema):
    return jobs.read_files(spark, f"{path}/*", schema, files_per_trigger=1)


def drained(query):
    query.awaitTermination(180)
    assert query.exception() is None
    return query


def test_the_gate_goes_on_after_a_restart_and_tells_what_it_holds(spark, tmp_path):
    at, out, path = (str(tmp_path / x) for x in "cod")
    first = events(spark, swap(blockNumber=100), swap(blockNumber=102), ("Transfer", {"from": "0xf", "value": "7", "blockNumber": 101, "pairAddress": "other"}), swap(blockNumber=None))
    stream = arriving(spark, path, first, events(spark, swap(blockNumber=100), swap(blockNumber=103)))
    drained(jobs.start_append(jobs.finality_gate(stream, 3), out, at, availableNow=True))
    kept = {r.pairAddress: (r.tip, r.pendingBlocks, r.pendingEvents) for r in keyed.pending(spark, at).collect()}
    assert kept == {"0xPair": (103, 3, 3), "other": (101, 1, 1)}
    got = lambda: sorted(r.blockNumber for r in spark.read.schema(first.schema).parquet(out).where("pairAddress = '0xPair'").collect())
    assert got() == [100, 100]
    events(spark, swap(blockNumber=105)).coalesce(1).write.parquet(f"{path}/2")
    drained(jobs.start_append(jobs.finality_gate(more(spark, path, first.schema), 3), out, at, availableNow=True))
    assert got() == [100, 100, 102]
    kept = {r.pairAddress: (r.tip, r.pendingBlocks, r.pendingEvents) for r in keyed.pending(spark, at).collect()}
    assert kept == {"0xPair": (105, 3, 3), "other": (101, 1, 1)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_prices_of_a_stream(spark, tmp_path):
    rounds, asked = "token string, updatedAt long, answer string, decimals int", "token string, at long"
    day = 86_400
    parts = [
        [("a", 90_000, "200000000000", 8), ("s", 10, "5", 0), ("r", 5_000, "1", 0)],
        [("a", 1_000, "85000000", 8), ("a", 1_000, "84000000", 8), ("b", 5, "1000000000000000000", 18), ("a", None, "1", 0)],
        [("r", 1_200, "7", 0), ("zz", 10 * day, "1", 0)],
    ]
    questions = [
        [("a", 999), ("a", 1_000), ("a", 1_000), ("a", 87_400), ("a", 87_401), ("a", 95_000), ("s", 12)],
        [("b", 6), ("none", 6), (None, 6), ("a", None), ("a", 176_400), ("a", 176_401), ("r", 1_000), ("r", 1_299), ("r", 1_300), ("r", 5_100)],
        [("zz", 11 * day)],
    ]
    streams = [arriving(spark, str(tmp_path / name), *[spark.createDataFrame(p, schema) for p in rows]) for name, schema, rows in (("r", rounds, parts), ("q", asked, questions))]
    found, out = keyed.price_stream(streams[1], streams[0], ["s"], lateness=5 * day), str(tmp_path / "o")
    query = drained(jobs.start_append(found, out, str(tmp_path / "c"), availableNow=True))
    got = {(r.token, r.at): r.usd for r in spark.read.schema(found.schema).parquet(out).collect()}
    assert got == {
        ("a", 999): None, ("a", 1_000): None,  # the miss a second before is remembered
        ("a", 87_400): 0.85, ("a", 87_401): 0.85, ("a", 95_000): 2000.0, ("a", 176_400): 2000.0, ("a", 176_401): 2000.0, ("s", 12): 1.0,
        ("b", 6): 1.0, ("none", 6): None, (None, 6): None, ("r", 1_000): None, ("r", 1_299): None, ("r", 1_300): 7.0, ("r", 5_100): 1.0,
    }
    assert keyed.counters(query)["size"] > 0 and keyed.counters(query)["late"] == 0


def test_nothing_is_remembered_if_so_told(spark, tmp_path):
    rounds = arriving(spark, str(tmp_path / "r"), spark.createDataFrame([("a", 1_000, "2", 0), ("zz", 10**6, "1", 0)], "token string, updatedAt long, answer string, decimals int"))
    asked = arriving(spark, str(tmp_path / "q"), spark.createDataFrame([("a", 999), ("a", 1_000), ("a", 1_000 + 86_400), ("a", 1_001 + 86_400), ("zz", 10**6)], "token string, at long"))
    found = keyed.price_stream(asked, rounds, lateness=60, remembered=0)
    drained(jobs.start_append(found, str(tmp_path / "o"), str(tmp_path / "c"), availableNow=True))
    got = {(r.token, r.at): r.usd for r in spark.read.schema(found.schema).parquet(str(tmp_path / "o")).collect()}
    assert got == {("a", 999): None, ("a", 1_000): 2.0, ("a", 87_400): 2.0, ("a", 87_401): None}


def test_a_log_waits_for_block_and_receipt_and_goes_on_without(spark, tmp_path):
    seen = lambda rows, schema: spark.createDataFrame(rows, f"{schema}, s long").withColumn("seenAt", F.timestamp_seconds("s")).drop("s")
    mint, who = chain.SIGNATURES["Mint"], "0x" + "0" * 24 + "1" * 40
    log = lambda block, tx, s: (block, tx, block, "0xpool", [mint, who], "0x" + f"{block:064x}" * 2, s)
    logs, blocks, gas = "blockNumber long, transactionHash string, logIndex int, address string, topics array<string>, data string", "blockNumber long, blockTimestamp long", "transactionHash string, gasUsed long, effectiveGasPrice string"
    bad = (7, "t7", 7, "0xpool", ["0xother"], "0x", 1_020)
    far = 1_000_000
    streams = [
        arriving(spark, str(tmp_path / "l"), seen([log(1, "t1", 1_000), log(2, "t2", 1_010), bad], logs), seen([log(3, "t3", 1_500), log(4, "t4", 1_510), log(9, "t9", far)], logs)),
        arriving(spark, str(tmp_path / "b"), seen([(4, 44, 1_000)], blocks), seen([(1, 11, 1_300), (3, 33, 1_400), (2, 22, 1_999), (8, 88, far)], blocks)),  # block 2 comes too late
        arriving(spark, str(tmp_path / "r"), seen([("t1", 1, "10", 990)], gas), seen([("t3", 3, None, 1_499), ("t4", 4, "40", 2_600), ("t8", 8, "80", far)], gas)),
    ]
    rows, out = lookups.located(*streams, wait=600, lateness=60), str(tmp_path / "o")
    drained(keyed.started(rows, rows.writeStream.outputMode("append").format("parquet").option("path", out), str(tmp_path / "c"), {"availableNow": True}))
    got = {r.blockNumber: (r.blockTimestamp, r.gasUsed, r.effectiveGasPrice, r.error) for r in spark.read.schema(rows.schema).parquet(out).collect()}
    assert got == {1: (11, 1, "10", None), 2: (None, None, None, None), 3: (33, 3, None, None), 4: (44, None, None, None), 7: (None, None, None, "unknown event")}


def test_a_batch_is_published_once_whatever_fails(spark, tmp_path):
    rows, path = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), str(tmp_path / "t")
    sinks.stage(rows, 0, path, "w")  # an attempt that died here
    assert sinks.committed(spark, path, rows.schema).count() == 0
    assert sinks.commit(rows, 0, path, "w") and not sinks.commit(rows, 0, path, "w")
    with pytest.raises(Exception, match="w-000000000000"):
        sinks.publish(spark, sinks.stage(rows, 0, path, "w"), 0, path, "w")  # two attempts at a time
    assert sinks.commit(rows.limit(1), 1, path, "w") and sinks.commit(rows, 0, path, "other")
    assert sorted(r.k for r in sinks.committed(spark, path, rows.schema).collect()) == [1, 1, 1, 2, 2]
    assert sinks.sweep(spark, path) == 2 and sinks.committed(spark, path, rows.schema).count() == 5
    stream, out = sinks.committed_stream(spark, path, rows.schema), str(tmp_path / "o")
    drained(jobs.start_append(stream, out, str(tmp_path / "c"), availableNow=True))
    assert spark.read.schema(rows.schema).parquet(out).count() == 5


def test_a_ledger_counts_each_batch_once_and_look_ups_are_pruned(spark, tmp_path):
    rows, path = trading.trading_windows(events(spark, swap(), swap(pairAddress=None), swap(blockTimestamp=1_700_100_000), swap(blockTimestamp=1_700_900_000, pairAddress="a/b=c"))), str(tmp_path / "t")
    assert store.counters(spark, path).count() == 0
    for n, part in enumerate([rows.where("pairAddress = '0xPair'"), rows, rows]):
        store.write_results(part, path, batch=("w", n))
        store.write_results(part, path, batch=("w", n))
    counts = {r.pairAddress: r.rows for r in store.counters(spark, path).collect()}
    assert counts == {"0xPair": 6, None: 2, "a/b=c": 2} and store.read_results(spark, path, rows.schema).count() == 4
    day = rows.withColumn("day", F.date_format(F.timestamp_millis("windowStart"), "yyyy-MM-dd")).where("pairAddress = 'a/b=c'")
    missing = store.missing_from(day, path)
    plan = missing._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("PushedFilters")[0]
    assert "2023-11-25" in filters and "(pairAddress#" in filters
    assert missing.count() == 0
    store.write_results(rows, path, batch=("w", 9), keep=(1_700_900_000_000, 24))
    assert {r.pairAddress for r in store.read_results(spark, path, rows.schema).collect()} == {"a/b=c"}


def whole(kind, **fields):
    return kind, {"eventId": f"{kind}:1", "token0": "x", "token1": "y", "eventTimestamp": 5} | fields


def test_messages_are_decoded_once_for_all_results(spark, tmp_path):
    moves = events(spark, whole("Mint", sender="p", amount0="1", amount1="2"), whole("Burn", sender="p", recipient="q", amount0="1", amount1="2"), whole("Transfer", **{"from": "f", "to": "t"}, value="9"))
    wire = decode.envelopes(decode.encoded(moves)).select(F.encode("value", "UTF-8").alias("value")).unionByName(spark.createDataFrame([(bytearray(b"no"),)], "value binary"))
    raw = arriving(spark, str(tmp_path / "in"), wire)
    base = str(tmp_path / "bronze")
    for _ in range(2):  # the second finds nothing new
        drained(jobs.start_bronze(raw, "liquidity", base, str(tmp_path / "c"), availableNow=True))
    out = jobs.bronze_events(spark, base, "liquidity")
    assert "ArrowEvalPython" not in out._jdf.queryExecution().analyzed().toString() and "UDF" not in out._jdf.queryExecution().analyzed().toString()
    drained(jobs.start_append(out, str(tmp_path / "o"), str(tmp_path / "co"), availableNow=True))
    got = {r.eventType: r for r in spark.read.schema(out.schema).parquet(str(tmp_path / "o")).collect()}
    assert len(got) == 3 and (got["Transfer"].value, got["Transfer"]["from"], got["Burn"].recipient, got["Mint"].amount1) == ("9", "f", "q", "2")
    assert got["Mint"].seq == BASE["blockNumber"] * 1_000_000
    bad = one(sinks.committed(spark, f"{base}/liquidity/errors", "stream string, reason string, payloadSize int"))
    assert tuple(bad) == ("liquidity", decode.INVALID, 2)


def test_what_cannot_be_encoded_is_an_error_row(spark, tmp_path):
    rows = events(spark, whole("Transfer", **{"from": "f", "to": "t"}, value=None), whole("Transfer", eventId="ok", **{"from": "f", "to": "t"}, value="1"), whole("Mint", sender=None, amount0="1", amount1="1"))
    made = decode.encoded(rows)
    assert sorted((r.eventType, r.encodeError) for r in made.where("body is null").collect()) == [("Mint", decode.MAPPING), ("Transfer", decode.MAPPING)]
    assert decode.envelopes(made).count() == 1
    seen = {}
    stream = arriving(spark, str(tmp_path / "in"), rows, events(spark, whole("Transfer", eventId="late", blockNumber=500, **{"from": "f", "to": "t"}, value="1")))
    drained(jobs.start_publish(stream, EngineConfig(finality_blocks=10), lambda b, n, topic: seen.setdefault(topic, []).extend(b.collect()), str(tmp_path / "c"), availableNow=True))
    assert [len(seen[t]) for t in (decode.TRADING_TOPIC, decode.LIQUIDITY_TOPIC, sinks.ERRORS)] == [0, 1, 2]


def test_a_transfer_without_data_moves_nothing(spark):
    log = (1, "t", 0, "p", [chain.SIGNATURES["Transfer"], "0x" + "1" * 64, "0x" + "2" * 64], "0x")
    row = one(chain.parse_logs(spark.createDataFrame([log], "blockNumber long, transactionHash string, logIndex int, address string, topics array<string>, data string")))
    assert (row.error, row.value) == (None, "0")


def test_windows_without_swaps(spark):
    t = BASE["blockTimestamp"]
    found = trading.empty_windows(trading.trading_windows(events(spark, swap(), swap(blockTimestamp=t + 900), swap(pairAddress="q")))).collect()
    assert [(r.pairAddress, r.windowStart, r.swapCount, r.volumeUSD, r.repeatedTraders) for r in sorted(found, key=lambda r: r.windowStart)] == [("0xPair", (t // 300 + k) * 300_000, 0, None, []) for k in (1, 2)]


def test_from_logs_to_messages(spark, tmp_path):
    seen = lambda rows, schema: spark.createDataFrame(rows, f"{schema}, s long").withColumn("seenAt", F.timestamp_seconds("s")).drop("s")
    top, who = chain.SIGNATURES, "0x" + "0" * 24 + "1" * 40
    log = lambda kind, block, pool="0xpool", topics=2: (block, f"t{block}", block, pool, [top[kind], *[who] * topics], "0x" + f"{block:064x}" * 4, 1_000 + block)
    logs = arriving(spark, str(tmp_path / "l"), seen([log("Swap", 1), log("Mint", 2), log("Swap", 3, "0xelse"), log("Burn", 4, topics=1)], LOGS), seen([log("Swap", 20), (99, "t", 99, "0xpool", [top["Mint"], who], "0x" + "0" * 128, 10**6)], LOGS))
    blocks = arriving(spark, str(tmp_path / "b"), seen([(1, 501, 1_001), (2, 502, 1_002), (4, 504, 1_004), (20, 520, 1_020), (98, 1, 10**6)], "blockNumber long, blockTimestamp long"))
    receipts = arriving(spark, str(tmp_path / "r"), seen([("t1", 7, "3", 1_001), ("x", 1, "1", 10**6)], "transactionHash string, gasUsed long, effectiveGasPrice string"))
    pairs = spark.createDataFrame([("0xpool", "a", "b", 0, 0)], "pairAddress string, token0 string, token1 string, decimals0 int, decimals1 int")
    feeds = spark.createDataFrame([(chain.FEEDS[next(iter(chain.FEEDS))].upper().replace("0X", "0x"), 400, "2", 0), ("0xunknown", 400, "9", 0)], "feed string, updatedAt long, answer string, decimals int")
    rounds = chain.rounds_of_feeds(feeds)
    assert [r.token for r in rounds.collect()] == [next(iter(chain.FEEDS))]
    tokens, sent = spark.createDataFrame([("a", "AAA")], "token string, symbol string"), {}
    config = EngineConfig(finality_blocks=10)
    for query in lookups.start_ingest(logs, blocks, receipts, tokens, pairs, rounds.withColumn("token", F.lit("a")), config, lambda b, n, topic: sent.setdefault(topic, []).extend(b.collect()), str(tmp_path / "base"), ["b"], availableNow=True):
        drained(query)
    assert [(r.blockNumber, r.error) for r in sent[lookups.LOST]] == [(4, "missing topics")]
    (message,) = sent[decode.TRADING_TOPIC]  # block 20 is not final yet
    good, _ = decode.events_from(spark.createDataFrame([(message.value,)], "value string"), "trading")
    row = one(good)
    assert (row.eventId, row.gasUsed, row.gasPrice, row.token0Symbol, row.volumeUSD, row.blockTimestamp) == ("t1:1", 7, "3", "AAA", 1.0, 501)
    assert [r.key for r in sent[decode.LIQUIDITY_TOPIC]] == ["0xpool"] and not sent[sinks.ERRORS]


def test_the_source_of_logs_counts_blocks(spark, tmp_path):
    log_files.register(spark)
    log = lambda block, pool="p": (block, f"t{block}", block, pool, ["x"] if block % 2 else [], "0x")
    path, out, at = (str(tmp_path / x) for x in ("l", "o", "c"))
    reader = lambda **options: spark.readStream.format(log_files.NAME).options(path=path, backfill=50, blocks=7, **options).load()
    spark.createDataFrame([log(b) for b in range(300)] + [log(299)] * 2, LOGS).write.parquet(path)
    drained(jobs.start_append(reader(), out, at, availableNow=True))
    got = lambda: sorted(r.blockNumber for r in spark.read.schema(LOGS).parquet(out).collect())
    assert got() == [*range(249, 300), 299, 299]
    spark.createDataFrame([log(300), log(350), log(351, "q")], LOGS).write.mode("append").parquet(path)
    drained(jobs.start_append(reader(), out, at, availableNow=True))
    assert got() == [*range(249, 300), 299, 299, 300, 350, 351]
    whole = spark.read.format(log_files.NAME).options(path=path, addresses="q,r").load()
    assert [tuple(r) for r in whole.collect()] == [(351, "t351", 351, "q", ["x"], "0x")]


def test_a_late_subscriber_gets_one_old_frame_and_all_new_ones(spark, tmp_path):
    frames = lambda *rows: spark.createDataFrame(rows, "channel string, pair string, frame string")
    path, bus, at = (str(tmp_path / x) for x in ("in", "bus", "c"))
    assert sinks.subscribe(spark, bus)[0].count() == 0
    source = arriving(spark, path, frames(("trading", "p", "1"), ("alerts", "p", "2")), frames(("trading", "p", "3"), ("trends", "q", "4")), frames(("trends", "q", "5")).where("false"))
    drained(sinks.start_bus(source, bus, at, availableNow=True))
    old, new = sinks.subscribe(spark, bus, "trends and alerts")
    assert [r.frame for r in old.collect()] == ["4"] and sinks.subscribe(spark, bus, "trading")[0].count() == 0
    frames(("trends", "q", "6"), ("trading", "p", "7"), ("alerts", "p", "8")).coalesce(1).write.parquet(f"{path}/9")
    drained(sinks.start_bus(more(spark, path, source.schema), bus, at, availableNow=True))
    drained(jobs.start_append(new, str(tmp_path / "o"), str(tmp_path / "co"), availableNow=True))
    assert sorted(r.frame for r in spark.read.schema(new.schema).parquet(str(tmp_path / "o")).collect()) == ["6", "8"]


def test_events_that_are_removed_leave_their_windows(spark, tmp_path):
    at, base, path = (str(tmp_path / x) for x in "cod")

    def said(*rows):  # (event, removed, stated)
        return events(spark, *[e for e, _, _ in rows]).join(spark.createDataFrame([(k, r, n) for k, (_, r, n) in enumerate(rows)], "seq long, removed boolean, stated long"), "seq")

    made = lambda n, block=100, **more: swap(eventId=f"e{n}", blockNumber=block, price=float(n), **more)
    mint = ("Mint", {"eventId": "m", "sender": "0xp", "amount0": "5", "amount1": "6", "blockNumber": 100})
    parts = [
        said((made(1), False, 1), (made(9), False, 2), (made(9), False, 2), (swap(eventId=None, price=2.0), False, 3), (mint, False, 4)),
        said((made(9), True, 5), (mint, True, 6)),
        said((made(9, 101), False, 7), (made(1), True, 8), (made(1), True, 8), (made(4, pairAddress=None), False, 9), (made(5, 102), True, 9), (made(5, 102), False, 9)),
    ]
    run = lambda s, plan, kinds, name: drained(corrections.start_corrections(s, plan, kinds, 60, f"{base}/{name}", f"{at}/{name}", availableNow=True))
    plans = {"swaps": (lambda e: trading.trading_windows(e, 60), corrections.SWAPS), "moves": (liquidity.liquidity_windows, corrections.MOVES)}
    seen = []
    for k, part in enumerate(parts):  # a restart after each
        part.coalesce(1).write.parquet(f"{path}/{k}")
        for name, (plan, kinds) in plans.items():
            run(more(spark, path, part.schema), plan, kinds, name)
        rows = corrections.windows(spark, f"{base}/swaps", part, plans["swaps"][0]).collect()
        seen.append({r.pairAddress: (r.swapCount, r.lowPrice, r.highPrice) for r in rows})
        seen.append(corrections.windows(spark, f"{base}/moves", part, plans["moves"][0]).count())
    assert seen == [{"0xPair": (3, 1.0, 9.0)}, 1, {"0xPair": (2, 1.0, 2.0)}, 0, {"0xPair": (2, 2.0, 9.0), None: (1, 4.0, 4.0)}, 0]
    gone = corrections.corrected(parts[1].where("removed"), parts[1], *plans["swaps"], 60).collect()
    assert [(r.gone, r.swapCount) for r in gone] == [(True, None)]
    none = parts[0].limit(0)
    assert corrections.corrected(none, none, *plans["swaps"], 60).count() == 0


def test_the_gate_gets_a_row_for_each_pool_and_block(spark):
    batch = pa.RecordBatch.from_pylist(
        [{"pairAddress": p, "eventType": k, "blockNumber": b, "seq": n} for p, k, b, n in [("a", "Swap", 5, 9), (None, "Mint", 5, 3), ("a", "Swap", 4, 2), ("a", None, None, 1), ("a", "Swap", 5, None), ("b", "Flush", None, 0), ("a", "Swap", 5, 7)]],
        pa.schema([("pairAddress", pa.string()), ("eventType", pa.string()), ("blockNumber", pa.int64()), ("seq", pa.int64())]))
    (packed,) = keyed._packed([batch])
    rows = {(r["pairAddress"], r["block"], r["flush"]): r for r in packed.to_pylist()}
    assert {k: r["events"] for k, r in rows.items()} == {("a", 5, False): 3, ("a", 4, False): 1, ("a", keyed.NEVER, False): 1, (None, 5, False): 1, ("b", keyed.NEVER, True): 0}
    twice = pa.RecordBatch.from_pydict({"rows": [2 * rows["a", 5, False]["rows"]]})
    assert [r["seq"] for b in keyed._unpacked([twice]) for r in b.to_pylist()] == [None, None, 7, 7, 9, 9]
